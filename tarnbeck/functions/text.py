"""Text expressions: normalisers, tokens, chunking and clean-up, all as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"""[.!?…]['"\)\]]?(?U:\s)"""
TARGET, LONGEST, OVERLAP, SHORTEST = 1200, 1800, 150, 40


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def normal_query(c: Column) -> Column:
    return F.regexp_replace(normal_text(c), r"[?.! ]+$", "")


def terms(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def search_text(c: Column) -> Column:
    """A query reduced to what a full-text parser always takes."""
    return strip(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "))


def identifiers(c: Column) -> Column:
    """Tokens of four or more characters that start with a letter or digit."""
    return F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z0-9][A-Za-z0-9_.\-]{2,}[A-Za-z0-9_])(?![A-Za-z0-9_])"), F.lit(1))


def distinctive(c: Column) -> Column:
    """Whether a token is an identifier (serial, code, address) and not a word, a year or a small number."""
    core = F.regexp_replace(c, r"^[.\-_]+|[.\-_]+$", "")
    groups = F.regexp_extract_all(core, F.lit("([0-9]+)"), F.lit(1))
    longest = F.array_max(F.transform(groups, lambda g: F.length(g)))
    mixed = c.rlike("[A-Z]") & core.rlike("[A-Za-z]")
    return (F.length(core) >= 5) & core.rlike("[0-9]") & (mixed | (longest >= 4) | (F.size(groups) >= 2))


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, "([^/]+)$", 1)


def parent_name(c: Column) -> Column:
    return F.regexp_extract(c, "(?:^|/)([^/]+)/[^/]+$", 1)


def suffix(c: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(base_name(c), r"^[^/]*[^/.][^/]*?(\.[^./]+)$|^[^/.]+(\.[^./]+)$", 1))


def shown_name(name: Column, path: Column) -> Column:
    return F.coalesce(F.when(name != "", name), base_name(path))


def embed_text(path: Column, text: Column) -> Column:
    """What is embedded for a chunk: its folder and file name, then the text."""
    return F.concat(F.concat_ws("/", F.when(parent_name(path) != "", parent_name(path)), base_name(path)), F.lit("\n"), text)


def safe_name(name: Column, ext: Column) -> Column:
    """A proposed file name without characters that file systems refuse, with its extension."""
    clean = strip(F.regexp_replace(name, r"[^\p{L}\p{N}_\-. ]", ""))
    return F.when(F.lower(clean).endswith(ext), clean).otherwise(F.concat(clean, ext))


def name_in_reply(reply: Column) -> Column:
    """The ``name`` member of the JSON object somewhere in a reply."""
    return F.get_json_object(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "$.name")


def rewritten(reply: Column, question: Column) -> Column:
    """First line of a rewritten query without quotes; the question if that is blank or too long."""
    line = strip(F.substring_index(F.regexp_replace(strip(reply), '^"+|"+$', ""), "\n", 1))
    return F.when(F.length(line).between(1, 400), line).otherwise(question)


def shown_size(n: Column) -> Column:
    """Bytes in powers of 1024: whole bytes, one digit from kilobytes on."""
    out = F.when(n < 1024, F.format_string("%d B", n))
    for power, unit in ((1, "KB"), (2, "MB")):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / F.lit(float(1024**power))))
    return out.otherwise(F.format_string("%.1f GB", n / F.lit(float(1024**3))))


_EMPTY = "cast(array() as array<string>)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"


_SE = r"""[.!?…][\x27"\)\]]?(?U:\s)"""  # the sentence end inside a SQL literal
# Where to cut a line that is too long: after the last sentence end or at the last blank of its second half, else at the limit.
_CUT = rf"""transform(array(substr(t.r, 1, {LONGEST})), w ->
    if(length(regexp_extract(w, r'(?s)^(.*{_SE})', 1)) >= {LONGEST // 2}, length(regexp_extract(w, r'(?s)^(.*{_SE})', 1)),
    if(length(regexp_extract(w, r'(?s)^(.*) ', 1)) >= {LONGEST // 2}, length(regexp_extract(w, r'(?s)^(.*) ', 1)), {LONGEST})))[0]"""
_LINE = rf"""aggregate(sequence(1, cast(greatest(1, ceil(length(l) / {LONGEST // 2})) as int)), named_struct('o', {_EMPTY}, 'r', l), (t, i) ->
    if(length(t.r) > {LONGEST}, transform(array({_CUT}), k -> named_struct('o', concat(t.o, array({_strip("substr(t.r, 1, k)")})), 'r', {_strip("substr(t.r, k + 1)")}))[0], t))"""


def long_pieces_sql(p: str) -> str:
    """An over-long paragraph in pieces: cut lines go out at once, ahead of the lines still being packed."""
    return rf"""aggregate(split({p}, '\n'), named_struct('o', {_EMPTY}, 'c', ''), (s, line) -> transform(array(transform(array(line), l -> {_LINE})[0]), x ->
        if(s.c <> '' and length(s.c) + length(x.r) + 1 > {LONGEST},
            named_struct('o', concat(s.o, x.o, array(s.c)), 'c', x.r),
            named_struct('o', concat(s.o, x.o), 'c', if(s.c <> '', concat(s.c, '\n', x.r), x.r))))[0],
        s -> if(s.c <> '', concat(s.o, array(s.c)), s.o))"""


def tail_sql(x: str) -> str:
    """The end of a text from a sentence start, else from a word start."""
    end = f"substr({x}, greatest(1, length({x}) - {2 * OVERLAP - 1}))"
    last = f"substr({x}, greatest(1, length({x}) - {OVERLAP - 1}))"
    first = rf"r'(?s)^.*?{_SE}(.{{0,{OVERLAP}}})\z'"
    return rf"""if(length({x}) <= {OVERLAP}, {x}, if({end} rlike {first}, {_strip(f"regexp_extract({end}, {first}, 1)")},
        if(instr({last}, ' ') between 1 and length({last}) - 1, {_strip(f"substr({last}, instr({last}, ' ') + 1)")}, {_strip(last)})))"""


def chunks_sql(text: str) -> str:
    """array<string>: the chunks of a text, paragraphs packed to a target size with an overlap."""
    pieces = rf"""flatten(transform(filter(transform(split({_strip(text)}, '\n\n'), q -> {_strip("q")}), q -> q <> ''), p -> if(length(p) <= {LONGEST}, array(p), {long_pieces_sql("p")})))"""
    return rf"""filter(aggregate({pieces}, named_struct('o', {_EMPTY}, 'c', ''), (a, piece) ->
        if(a.c <> '' and length(a.c) + length(piece) + 2 > {TARGET},
            named_struct('o', concat(a.o, array(a.c)), 'c', transform(array({tail_sql("a.c")}), v -> if(v <> '', concat(v, '\n\n', piece), piece))[0]),
            named_struct('o', a.o, 'c', if(a.c <> '', concat(a.c, '\n\n', piece), piece))),
        a -> if(length({_strip("a.c")}) >= {SHORTEST} or size(a.o) = 0, concat(a.o, array(a.c)), a.o)), z -> length({_strip("z")}) >= {SHORTEST})"""
