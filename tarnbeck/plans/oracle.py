"""SQL with the meaning of each query, for an independent engine."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}]"
NOT_WORD, NOT_NAME = r"[^\p{L}\p{N}_\s]", r"[^\p{L}\p{N}_\-. ]"
# Fixed values, stated again so that the SQL stands on its own: extensions that are indexed, folders that never are, the category of an extension.
PLAIN = "txt md markdown rst org tex log csv tsv json jsonl yaml yml toml ini cfg html htm xml py js jsx ts tsx mjs cjs vue svelte java kt c h cpp hpp cc cs go rs rb php swift scala lua r jl sh bash zsh ps1 bat sql pdf docx"
HIDDEN = "['node_modules', '.git', '.svn', '.hg', '__pycache__', '.venv', 'venv', '.tox', '.mypy_cache', '.pytest_cache', '.ruff_cache', 'dist', 'build', 'out', 'target', '.next', '.nuxt', '.cache', '.gradle', '.idea', '.vs', '$RECYCLE.BIN', 'System Volume Information', 'AppData']"
KINDS = (("Documents", "pdf docx doc txt md rtf odt tex"), ("Spreadsheets", "xlsx xls csv tsv ods"), ("Presentations", "pptx ppt key odp"), ("Images", "jpg jpeg png gif webp svg heic bmp tiff"), ("Audio", "mp3 wav flac m4a ogg aac"), ("Video", "mp4 mov mkv avi webm m4v"), ("Archives", "zip rar 7z tar gz bz2 xz"), ("Code", "py js ts tsx jsx java c cpp cs go rs rb php sh ps1 sql html css json yaml yml"), ("Installers", "exe msi dmg pkg deb rpm appimage"))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def normal(x: str) -> str:
    return f"regexp_replace(lower({strip(x)}), '{SPACE}+', ' ', 'g')"


def bare(x: str) -> str:
    return f"regexp_replace({normal(x)}, '[?.! ]+$', '')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


def base(x: str) -> str:
    return f"regexp_extract({x}, '([^/]+)$', 1)"


def parent(x: str) -> str:
    return f"regexp_extract({x}, '(?:^|/)([^/]+)/[^/]+$', 1)"


def ext(x: str) -> str:
    b = base(x)
    return f"CASE WHEN strpos(ltrim({b}, '.'), '.') > 0 AND NOT ends_with({b}, '.') THEN lower('.' || string_split({b}, '.')[-1]) ELSE '' END"


def sql_list(names: str) -> str:
    return "(" + ", ".join(f"'.{n}'" for n in names.split()) + ")"


LATEST = """latest AS (SELECT path, mtime_ns, size, chunk_count FROM files WHERE path IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime_ns DESC NULLS LAST, coalesce(seen_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, coalesce(size, -1) DESC, coalesce(chunk_count, -1) DESC) = 1)"""
ROWS = """rows AS (SELECT * FROM chunks WHERE path IS NOT NULL AND chunk_index IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY path, chunk_index ORDER BY chunk_id) = 1)"""
USABLE = """usable AS (SELECT chunk_id, path, chunk_index, vector::DOUBLE[] AS v FROM rows
    WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
QUESTIONS = """questions AS (SELECT substr(id, 2)::BIGINT AS query_id, min(fact) AS query, min(path) AS path, coalesce(min(topic), 'none') AS category FROM anchors WHERE id IS NOT NULL AND fact IS NOT NULL GROUP BY id)"""


def embedded(name: str, source: str, key: str, value: str) -> str:
    """Vectors of hashed words: {name} has the key and v, null without words."""
    return f"""{name} AS MATERIALIZED (SELECT {key}, CASE WHEN bool_or(s <> 0) THEN list(coalesce(s, 0)::DOUBLE ORDER BY slot) END AS v FROM (
        SELECT k.{key}, g.slot, h.s FROM {source} k CROSS JOIN (SELECT unnest(range(64)) AS slot) g LEFT JOIN (
            SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS s
            FROM (SELECT {key}, unnest({words(f"coalesce({value}, '')")}) AS w FROM {source}) GROUP BY ALL) h ON h.{key} = k.{key} AND h.slot = g.slot) GROUP BY {key})"""


EMBEDDED = embedded("embedded", "rows", "chunk_id", "text")
ASKED = embedded("asking", "questions", "query_id", "query") + """,
asked AS MATERIALIZED (SELECT q.*, a.v AS qv FROM questions q JOIN asking a USING (query_id))"""


def by_cosine(queries: str, vectors: str) -> str:
    return f"""vectors AS MATERIALIZED (SELECT query_id, chunk_id, score, r AS vec_rank FROM (
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM (
        SELECT query_id, chunk_id, round(greatest(list_cosine_similarity(qv, v), 0) + 1e-12, 4) AS score FROM {queries}, {vectors} WHERE qv IS NOT NULL AND v IS NOT NULL)) WHERE r <= 24)"""


VECTORS = by_cosine("asked", "embedded")
BY_EXAMPLE = """examples AS (SELECT q.query_id, u.v AS qv FROM questions q JOIN (SELECT path, v FROM usable QUALIFY row_number() OVER (PARTITION BY path ORDER BY chunk_index, chunk_id) = 1) u ON u.path = q.path)"""


def scores(column: str) -> str:
    return f"""SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25
        FROM (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM (SELECT chunk_id, {words(f"coalesce({column}, '')")} AS w FROM rows)) GROUP BY ALL) p
        JOIN (SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest({words(f"coalesce({column}, '')")}) AS term FROM rows) GROUP BY term) USING (term)
        JOIN (SELECT query_id, unnest(list_distinct({words("query")})) AS term FROM asked) USING (term)
        CROSS JOIN (SELECT count(*) AS n, avg(len({words(f"coalesce({column}, '')")})) AS avgdl FROM rows)
        GROUP BY query_id, chunk_id"""


TEXTS = f"""texts AS MATERIALIZED (SELECT query_id, chunk_id, bm25, r AS fts_rank FROM (
    SELECT query_id, chunk_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS r FROM (
        SELECT query_id, chunk_id, max(bm25) AS bm25 FROM ({scores("text")} UNION ALL {scores("name")}) GROUP BY query_id, chunk_id)) WHERE r <= 24)"""
FUSED = """listed AS MATERIALIZED (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id,
        round(coalesce(1::DOUBLE / (60 + vec_rank), 0) + coalesce(1::DOUBLE / (60 + fts_rank), 0), 8) AS rrf, score, fts_rank
    FROM vectors v FULL JOIN texts t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id),
cosines AS (SELECT l.query_id, l.chunk_id, round(greatest(list_cosine_similarity(a.qv, e.v), 0) + 1e-12, 4) AS c
    FROM listed l JOIN asked a ON a.query_id = l.query_id JOIN embedded e ON e.chunk_id = l.chunk_id WHERE l.score IS NULL AND a.qv IS NOT NULL AND e.v IS NOT NULL),
fused AS (SELECT l.query_id, l.chunk_id, l.rrf, l.fts_rank, coalesce(l.score, c.c, 0) AS score, r.path, r.chunk_index, r.name, r.text, a.query
    FROM listed l JOIN rows r ON r.chunk_id = l.chunk_id JOIN asked a ON a.query_id = l.query_id LEFT JOIN cosines c ON c.query_id = l.query_id AND c.chunk_id = l.chunk_id)"""
POOL = """pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS pool_rank FROM fused
    WHERE score >= 0.3::DOUBLE OR fts_rank <= 3 QUALIFY pool_rank <= 16)"""


def overlap(q: str, d: str) -> str:
    qw = f"list_distinct({words(q)})"
    share = f"coalesce(len(list_intersect({qw}, {words(f'coalesce({d}, {chr(39) * 2})')}))::DOUBLE / nullif(len({qw}), 0), 0)"
    return f"round(1::DOUBLE / (1 + exp(-(12 * {share} - 6))), 4)"


RERANKED = f"""scored AS (SELECT *, {overlap("query", "text")} AS rerank FROM pool),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, pool_rank) AS place FROM scored WHERE rerank >= 0.02::DOUBLE)"""


def capped(source: str, k: int, name: str = "hits") -> str:
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS ref FROM (
        SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY place) <= 3) QUALIFY ref <= {k})"""


SEARCH = [ROWS, QUESTIONS, EMBEDDED, ASKED, VECTORS, TEXTS, FUSED, POOL]
NAME = f"coalesce(nullif(name, ''), {base('path')})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# A sentence end, and the chunker as folds over lists.
SE = r"""[.!?…]['"\)\]]?[\s\p{Z}]""".replace("'", "''")


def tail(x: str) -> str:
    end, last = f"right({x}, 300)", f"right({x}, 150)"
    first = f"'(?s)^.*?{SE}(.{{0,150}})$'"
    return f"""CASE WHEN length({x}) <= 150 THEN {x}
        WHEN regexp_matches({end}, {first}) THEN {strip(f"regexp_extract({end}, {first}, 1)")}
        WHEN instr({last}, ' ') BETWEEN 1 AND length({last}) - 1 THEN {strip(f"substr({last}, instr({last}, ' ') + 1)")}
        ELSE {strip(last)} END"""


def cut(r: str) -> str:
    w = f"substr({r}, 1, 1800)"
    s, b = f"length(regexp_extract({w}, '(?s)^(.*{SE})', 1))", f"length(regexp_extract({w}, '(?s)^(.*) ', 1))"
    return f"CASE WHEN {s} >= 900 THEN {s} WHEN {b} >= 900 THEN {b} ELSE 1800 END"


def long_pieces(p: str) -> str:
    line = f"""list_reduce(range(0, greatest(1, ceil(length(l) / 900.0))::BIGINT), lambda t, i: CASE WHEN length(t.r) > 1800
        THEN {{'o': list_append(t.o, {strip(f"substr(t.r, 1, {cut('t.r')})")}), 'r': {strip(f"substr(t.r, {cut('t.r')} + 1)")}}} ELSE t END, {{'o': []::VARCHAR[], 'r': l}})"""
    fold = f"""list_reduce(list_transform(string_split({p}, chr(10)), lambda l: {line}), lambda s, x: CASE WHEN s.c <> '' AND length(s.c) + length(x.r) + 1 > 1800
        THEN {{'o': list_append(list_concat(s.o, x.o), s.c), 'c': x.r}} ELSE {{'o': list_concat(s.o, x.o), 'c': CASE WHEN s.c <> '' THEN s.c || chr(10) || x.r ELSE x.r END}} END, {{'o': []::VARCHAR[], 'c': ''}})"""
    return f"list_transform([{fold}], lambda z: CASE WHEN z.c <> '' THEN list_append(z.o, z.c) ELSE z.o END)[1]"


def chunks_of(text: str) -> str:
    paras = f"list_filter(list_transform(string_split({strip(text)}, chr(10) || chr(10)), lambda q: {strip('q')}), lambda q: q <> '')"
    pieces = f"flatten(list_transform({paras}, lambda p: CASE WHEN length(p) <= 1800 THEN [p] ELSE {long_pieces('p')} END))"
    join = f"list_transform([{tail('a.c')}], lambda v: CASE WHEN v <> '' THEN v || chr(10) || chr(10) || piece ELSE piece END)[1]"
    fold = f"""list_reduce({pieces}, lambda a, piece: CASE WHEN a.c <> '' AND length(a.c) + length(piece) + 2 > 1200
        THEN {{'o': list_append(a.o, a.c), 'c': {join}}} ELSE {{'o': a.o, 'c': CASE WHEN a.c <> '' THEN a.c || chr(10) || chr(10) || piece ELSE piece END}} END, {{'o': []::VARCHAR[], 'c': ''}})"""
    return f"""list_filter(list_transform([{fold}], lambda z: CASE WHEN length({strip('z.c')}) >= 40 OR len(z.o) = 0 THEN list_append(z.o, z.c) ELSE z.o END)[1], lambda y: length({strip('y')}) >= 40)"""


IDENT = r"\b[A-Za-z0-9][A-Za-z0-9_.\-]{2,}[A-Za-z0-9_]\b"
CORE = "trim(raw, '.-_')"
DIGITS = f"regexp_extract_all({CORE}, '[0-9]+')"
DISTINCTIVE = f"""length({CORE}) >= 5 AND regexp_matches({CORE}, '[0-9]') AND ((regexp_matches(raw, '[A-Z]') AND regexp_matches({CORE}, '[A-Za-z]'))
    OR list_max(list_transform({DIGITS}, lambda g: length(g))) >= 4 OR len({DIGITS}) >= 2)"""
TYPO_DIGIT = "('0x' || substr(md5(q || '{}' || '18'), 1, 7))::BIGINT % {}"
NEG4 = "SELECT * FROM pairs WHERE label = 0 AND query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY pair_id) <= 4"
SCORED = f"scored AS (SELECT pair_id, label, {overlap('query', 'doc')} AS s FROM pairs WHERE query IS NOT NULL AND doc IS NOT NULL AND label IS NOT NULL)"
FLAT = f"""flat AS (SELECT src, dest, CASE WHEN src NOT IN (SELECT path FROM chunks WHERE path IS NOT NULL) THEN 'source missing' WHEN dest IN (SELECT path FROM chunks WHERE path IS NOT NULL) THEN 'destination exists'
        WHEN count(*) OVER (PARTITION BY dest) > 1 THEN 'destination shared' END AS problem
    FROM (SELECT path AS src, 'all/' || {base("path")} AS dest FROM latest))"""
STORED = "stored AS (SELECT path || '#' || doc_id AS path, modified_at AS mtime, strlen(text) AS size, sha256(text) AS hash FROM documents WHERE text IS NOT NULL)"
GROUPS = """grouped AS (SELECT size, hash, first(path ORDER BY mtime NULLS LAST, path) AS keep, count(*) AS n_copies FROM stored WHERE size > 0 AND path IS NOT NULL GROUP BY size, hash HAVING count(*) > 1)"""
CATEGORY = "CASE " + " ".join(f"WHEN {ext('path')} IN {sql_list(e)} THEN '{k}'" for k, e in KINDS) + " ELSE 'Other' END"


def summary(by: str) -> str:
    return f"SELECT {by}, count(*) AS n_rows, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, count(DISTINCT query) AS n_queries, count(DISTINCT path) AS n_docs FROM pairs GROUP BY {by}"


def mean(c: str) -> str:
    return f"round(avg({c}), 6)"


TWO_HOP = with_(*SEARCH, RERANKED, capped("reranked", 8), "two AS (SELECT query_id, path, lead(path) OVER (PARTITION BY category ORDER BY query_id) AS second FROM questions WHERE path IS NOT NULL)",
    """found AS (SELECT query_id, n_found, n_found = 2 AS found FROM (SELECT t.query_id, count(DISTINCT h.path) AS n_found FROM two t LEFT JOIN hits h ON h.query_id = t.query_id AND h.path IN (t.path, t.second)
        WHERE second IS NOT NULL AND second <> t.path GROUP BY t.query_id))""")
TYPOS = f"""chosen AS (SELECT query FROM (SELECT query, row_number() OVER (ORDER BY md5('18|' || query), query) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT query FROM pairs WHERE split = 'train' AND query IS NOT NULL)) WHERE r <= greatest(1, floor(0.3 * n))),
        drawn AS (SELECT pair_id, query AS q, style || '+typo' AS style, string_split(query, ' ') AS w FROM pairs WHERE split = 'train' AND query IN (SELECT query FROM chosen)),
        spot AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: length(w[i]) >= 4) AS longs FROM drawn),
        word AS (SELECT *, longs[{TYPO_DIGIT.format("word", "greatest(len(longs), 1)")} + 1] AS i FROM spot),
        place AS (SELECT *, w[i] AS x, {TYPO_DIGIT.format("place", "greatest(length(w[i]) - 1, 1)")} + 1 AS k, {TYPO_DIGIT.format("kind", "4")} AS kind, substr('abcdefghijklmnopqrstuvwxyz', {TYPO_DIGIT.format("letter", "26")} + 1, 1) AS letter FROM word WHERE i IS NOT NULL),
        done AS (SELECT pair_id, q, style, array_to_string(list_concat(w[:i - 1], [substr(x, 1, k - 1) || CASE kind WHEN 0 THEN substr(x, k + 1, 1) || substr(x, k, 1) WHEN 1 THEN substr(x, k + 1, 1)
            WHEN 2 THEN substr(x, k, 1) || substr(x, k, 1) || substr(x, k + 1, 1) ELSE letter || substr(x, k + 1, 1) END || substr(x, k + 2)], w[i + 1:]), ' ') AS query FROM place),
        typos AS (SELECT pair_id, query, style FROM done WHERE query <> q)"""
EXAMPLES = """examples AS (SELECT query, md5(p) AS positive, md5(n) AS negative FROM (SELECT query, last(doc ORDER BY pair_id) FILTER (label = 1) AS p, last(doc ORDER BY pair_id) FILTER (label = 0) AS n
        FROM pairs WHERE query IS NOT NULL AND doc IS NOT NULL GROUP BY query) WHERE p IS NOT NULL AND n IS NOT NULL)"""

SQL: dict[str, str] = {
    "scan_filter": f"""SELECT path, mtime_ns, size FROM files WHERE path IS NOT NULL AND {ext("path")} IN {sql_list(PLAIN)} AND size > 0
            AND size <= CASE WHEN {ext("path")} = '.pdf' THEN 104857600 ELSE 20971520 END
            AND len(list_filter(string_split(regexp_extract(path, '^(.*/)', 1), '/'), lambda p: (p LIKE '.%' AND p <> '.') OR list_contains({HIDDEN}, p))) = 0
        QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY path, mtime_ns DESC, size) = 1""",
    "walk_filter": f"""SELECT DISTINCT path, mtime_ns, size FROM files WHERE path IS NOT NULL
            AND len(list_filter(string_split(path, '/'), lambda p: (p LIKE '.%' AND p <> '.') OR list_contains({HIDDEN}, p))) = 0""",
    "folder_listing": f"""SELECT folder, count(*) AS n_files, min(name) AS first_name FROM (SELECT DISTINCT regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder, {base("path")} AS name FROM files WHERE path IS NOT NULL)
        WHERE name <> '' AND name NOT LIKE '.%' GROUP BY folder""",
    "ledger_current": with_(LATEST) + "SELECT * FROM latest",
    "ledger_changed": with_(LATEST, LATEST.replace("latest AS", "old AS").replace("path IS NOT NULL", "path IS NOT NULL AND epoch_us(seen_at) < (SELECT avg(epoch_us(seen_at)) FROM files)"))
    + "SELECT path, mtime_ns, size FROM latest l WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.path = l.path AND o.mtime_ns IS NOT DISTINCT FROM l.mtime_ns AND o.size IS NOT DISTINCT FROM l.size)",
    "ledger_stale": with_(LATEST) + "SELECT path, chunk_count FROM latest WHERE path NOT IN (SELECT path FROM chunks WHERE path IS NOT NULL)",
    "stored_counts": with_(LATEST) + f"SELECT {ext('path')} AS suffix, count(*) AS n_files, sum(coalesce(chunk_count, 0)) AS n_chunks FROM latest GROUP BY 1",
    "chunk_count_drift": with_(LATEST, ROWS) + """SELECT coalesce(l.path, c.path) AS path, chunk_count, coalesce(n, 0) AS n_there
        FROM latest l FULL JOIN (SELECT path, count(*) AS n FROM rows GROUP BY path) c ON c.path = l.path WHERE chunk_count IS DISTINCT FROM coalesce(n, 0)""",
    "upsert_result": f"""WITH incoming AS (SELECT path, first(text ORDER BY modified_at DESC NULLS LAST, doc_id DESC) FILTER (text IS NOT NULL) AS text FROM documents WHERE path IS NOT NULL GROUP BY path)
        SELECT path, chunk_index, text FROM chunks WHERE path NOT IN (SELECT path FROM incoming)
        UNION ALL SELECT path, i - 1, c[i] FROM (SELECT path, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT path, {chunks_of("text")} AS c FROM incoming WHERE text IS NOT NULL))""",
    "remove_result": with_(LATEST) + "SELECT chunk_id, path FROM chunks WHERE path IS NULL OR path NOT IN (SELECT path FROM latest WHERE size = 0)",
    "corpus_union": """SELECT path, first(kind ORDER BY kind DESC, moment DESC, id DESC) AS kind, first(id ORDER BY kind DESC, moment DESC, id DESC) AS id, count(*) AS n FROM (
        SELECT path, coalesce(indexed_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') AS moment, chunk_id AS id, 'chunk' AS kind FROM chunks WHERE path IS NOT NULL AND text IS NOT NULL
        UNION ALL SELECT path, coalesce(modified_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), doc_id, 'document' FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) GROUP BY path""",
    "extracted_text": "SELECT doc_id, length(text) AS n_chars, md5(text) AS md5 FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ltrim(text, chr(65279)) WHEN 1 THEN text END AS text FROM documents WHERE text IS NOT NULL)",
    "resumed_lines": "SELECT pair_id, query, label FROM pairs WHERE split = 'val'",
    "json_rows": "SELECT pair_id, path, query, label, md5(doc) AS doc_md5 FROM pairs",
    "chunk_documents": f"SELECT doc_id, i - 1 AS chunk_index, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {chunks_of('text')} AS c FROM documents WHERE text IS NOT NULL))",
    "long_split": f"SELECT doc_id, i - 1 AS piece_index, c[i] AS piece FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, {long_pieces('text')} AS c FROM documents WHERE length(text) > 1800))",
    "clean_tail": f"SELECT doc_id, {tail('text')} AS tail FROM documents WHERE text IS NOT NULL",
    "normalised_queries": rf"SELECT pair_id, {normal('query')} AS normal, {bare('query')} AS bare, {strip("regexp_replace(query, '" + NOT_WORD + "', ' ', 'g')")} AS searched FROM pairs WHERE query IS NOT NULL",
    "distinctive_tokens": f"SELECT lower(raw) AS token, count(*) AS n_texts FROM (SELECT unnest(list_distinct(regexp_extract_all(doc, '{IDENT}'))) AS raw FROM pairs) WHERE {DISTINCTIVE} GROUP BY 1",
    "path_parts": f"SELECT DISTINCT path, {base('path')} AS base, {parent('path')} AS parent, {ext('path')} AS suffix FROM files WHERE path IS NOT NULL",
    "embed_headers": f"SELECT chunk_id, {NAME} AS shown, md5(CASE WHEN {parent('path')} <> '' THEN {parent('path')} || '/' ELSE '' END || {base('path')} || chr(10) || text) AS md5 FROM chunks WHERE path IS NOT NULL AND text IS NOT NULL",
    "safe_names": rf"""SELECT DISTINCT id, CASE WHEN ends_with(lower(n), '.md') THEN n ELSE n || '.md' END AS name FROM (
        SELECT id, {strip("regexp_replace(concat_ws(' ', fact, value), '" + NOT_NAME + "', '', 'g')")} AS n FROM anchors WHERE id IS NOT NULL)""",
    "json_in_text": "SELECT pair_id, query AS name FROM pairs WHERE query IS NOT NULL",
    "rewritten_queries": f"""SELECT pair_id, CASE WHEN length(line) BETWEEN 1 AND 400 THEN line ELSE anchor_id END AS query FROM (
        SELECT pair_id, anchor_id, {strip("string_split(ltrim('" + '"' + "' || query || '" + '"' + "', '" + '"' + "'), chr(10))[1]")} AS line FROM pairs WHERE query IS NOT NULL AND anchor_id IS NOT NULL)""",
    "query_templates": r"""SELECT DISTINCT id, CASE WHEN value IS NOT NULL AND length(value) <= 24 THEN value ELSE array_to_string(w[-4:], ' ') END AS keyword, fact || '?' AS natural,
            'can you remind me ' || regexp_replace(fact, '(what |when |who |which )', '', 'g') AS paraphrase, lower(array_to_string(w[-3:], ' ')) AS partial
        FROM (SELECT *, list_filter(string_split_regex(fact, '\s+'), lambda x: x <> '') AS w FROM anchors WHERE id IS NOT NULL AND fact IS NOT NULL)""",
    "shown_sizes": with_(LATEST) + """SELECT path, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', round(size / 1024.0::DOUBLE, 1)) WHEN size < 1073741824 THEN printf('%.1f MB', round(size / 1048576.0::DOUBLE, 1))
        ELSE printf('%.1f GB', round(size / 1073741824.0::DOUBLE, 1)) END AS shown FROM latest WHERE size IS NOT NULL""",
    "token_stats": with_(ROWS) + f"SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest({words('text')}) AS term FROM rows) GROUP BY term",
    "bm25_topk": with_(ROWS, QUESTIONS, ASKED, TEXTS) + "SELECT * FROM texts",
    "cosine_topk": with_(ROWS, USABLE, QUESTIONS, BY_EXAMPLE, by_cosine("examples", "usable")) + "SELECT * FROM vectors",
    "embedded_topk": with_(*SEARCH[:5]) + "SELECT * FROM vectors",
    "index_totals": with_(ROWS, *(f"{f}s AS (SELECT chunk_id, unnest({words(f'coalesce({f}, {chr(39) * 2})')}) AS term FROM rows)" for f in ("text", "name"))) + " UNION ALL ".join(f"SELECT '{f}' AS field, count(DISTINCT term) AS n_terms, count(DISTINCT (term, chunk_id)) AS n_postings, count(*) AS n_words FROM {f}s" for f in ("text", "name")),
    "hits_for_client": with_(*SEARCH, RERANKED, capped("reranked", 8)) + f'SELECT query_id, path, {NAME} AS name, chunk_index AS "chunkIndex", md5(text) AS md5, score FROM hits',
    "first_citations": with_(*SEARCH, RERANKED, capped("reranked", 8)) + "SELECT query_id, ref, path, printf('%.0f%%', 100 * score) AS shown FROM hits WHERE ref <= 4",
    "rrf_fusion": with_(*SEARCH[:7]) + "SELECT query_id, chunk_id, rrf, score, fts_rank FROM fused",
    "confidence_floor": with_(*SEARCH) + "SELECT query_id, chunk_id, pool_rank FROM pool",
    "rerank_default": with_(*SEARCH, RERANKED) + "SELECT query_id, chunk_id, rerank, place FROM reranked",
    "per_file_cap": with_(*SEARCH, "placed AS (SELECT *, pool_rank AS place FROM pool)", capped("placed", 8)) + "SELECT query_id, ref, chunk_id, path FROM hits",
    "hybrid_search": with_(*SEARCH, RERANKED, capped("reranked", 8)) + f"SELECT query_id, ref, chunk_id, path, {NAME} AS name, score, rrf, fts_rank, rerank FROM hits",
    "hit_citations": with_(*SEARCH, RERANKED, capped("reranked", 8)) + f"SELECT query_id, ref, path, {NAME} AS name, score, substr(text, 1, 240) AS preview FROM hits",
    "context_blocks": with_(*SEARCH, RERANKED, capped("reranked", 8)) + "SELECT query_id, md5(c) AS md5, length(c) AS n_chars FROM (SELECT query_id, string_agg('[' || ref || '] ' || path || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ref) AS c FROM hits GROUP BY query_id)",
    "history_window": f"""SELECT path AS conv_id, pair_id AS turn, CASE label WHEN 1 THEN 'user' ELSE 'assistant' END AS role, substr(query, 1, 2000) AS content FROM pairs
        WHERE path IS NOT NULL AND label IN (0, 1) AND {strip("query")} <> '' QUALIFY row_number() OVER (PARTITION BY path ORDER BY pair_id DESC) <= 8""",
    "metrics_by_category": with_(*SEARCH, RERANKED, capped("reranked", 10), """ranks AS (SELECT a.query_id, a.category, g.file_rank AS r FROM asked a LEFT JOIN (
            SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY min(ref)) AS file_rank FROM hits GROUP BY query_id, path) g ON g.query_id = a.query_id AND g.path = a.path)""")
    + f"""SELECT category, grouping(category) AS overall, count(*) AS n, {mean("CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END")} AS top1, {mean("CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END")} AS recall5,
        {mean("CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END")} AS mrr10, {mean("CASE WHEN r <= 10 THEN 1.0::DOUBLE / log2(r + 1.0::DOUBLE) ELSE 0 END")} AS ndcg10 FROM ranks GROUP BY GROUPING SETS ((category), ())""",
    "probe_rejection": with_(ROWS, f"need AS (SELECT probe_id, category, list_distinct({words('query')}) AS w FROM probes WHERE query IS NOT NULL)", f"has AS (SELECT chunk_id, unnest(list_distinct({words('text')})) AS term FROM rows)",
        "answered AS (SELECT DISTINCT probe_id FROM (SELECT probe_id, chunk_id FROM (SELECT probe_id, len(w) AS n, unnest(w) AS term FROM need) JOIN has USING (term) GROUP BY probe_id, chunk_id, n HAVING count(*) >= n))")
    + f"SELECT category, grouping(category) AS overall, count(*) AS n, {mean('CASE WHEN probe_id NOT IN (SELECT probe_id FROM answered) THEN 1.0::DOUBLE ELSE 0 END')} AS rejected FROM need GROUP BY GROUPING SETS ((category), ())",
    "two_hop": TWO_HOP + "SELECT * FROM found",
    "two_hop_recall": TWO_HOP + f"SELECT count(*) AS n, {mean('found::INT::DOUBLE')} AS recall, {mean('n_found / 2.0::DOUBLE')} AS file_recall FROM found",
    "latency_by_type": f"""SELECT event_type, count(*) AS n, {mean("value")} AS mean, round(1000.0::DOUBLE * count(*) / nullif(sum(value), 0), 6) AS per_second, {", ".join(f"list_sort(list(value))[round_even({p / 100} * (count(*) - 1), 0)::BIGINT + 1] AS p{p}" for p in (50, 95, 99))}
        FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "percentile_nearest": """SELECT style, p, v[greatest(0, round_even(p / 100 * (len(v) - 1), 0))::BIGINT + 1] AS value, len(v) AS n
        FROM (SELECT coalesce(lower(trim(style)), 'none') AS style, list(length(query) ORDER BY length(query)) AS v FROM pairs WHERE query IS NOT NULL GROUP BY 1), (SELECT unnest([50, 95, 99])::DOUBLE AS p)""",
    "floor_sweep": with_(SCORED, """grid AS (SELECT unnest([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.34, 0.5, 0.75, 0.9])::DOUBLE AS floor)""", """swept AS (SELECT floor,
            round(count(*) FILTER (label = 1 AND s >= floor)::DOUBLE / nullif(count(*) FILTER (label = 1), 0), 6) AS kept, round(count(*) FILTER (label = 0 AND s < floor)::DOUBLE / nullif(count(*) FILTER (label = 0), 0), 6) AS rejected
        FROM scored, grid WHERE label IN (0, 1) GROUP BY floor)""")
    + "SELECT *, kept >= 0.5 AND floor = (SELECT floor FROM swept WHERE kept >= 0.5 ORDER BY rejected DESC, floor LIMIT 1) AS chosen FROM swept",
    "calibrate_floor": with_(SCORED) + "SELECT coalesce(greatest(v[greatest(0, round_even(0.05::DOUBLE * (len(v) - 1), 0))::BIGINT + 1], 0.001::DOUBLE), 0.02::DOUBLE) AS floor FROM (SELECT list(s ORDER BY s) AS v FROM scored WHERE label = 1)",
    "dataset_summary": summary("split"),
    "topic_summary": summary("topic, style"),
    "stale_counts": "SELECT count(d) AS n, max(d) AS most, round(avg(d), 6) AS mean FROM (SELECT abs(length(text) - n_chars) AS d FROM documents)",
    "mine_pairs": with_(*SEARCH[:7], """mine AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS pool_rank FROM fused QUALIFY pool_rank <= 30)""",
        """pos AS (SELECT a.query_id, a.path AS gold, coalesce(h.chunk_id, s.chunk_id) AS chunk_id, CASE WHEN h.chunk_id IS NOT NULL THEN h.text ELSE s.text END AS text FROM asked a
            LEFT JOIN (SELECT m.query_id, m.path, m.chunk_id, m.text FROM mine m QUALIFY row_number() OVER (PARTITION BY m.query_id, m.path ORDER BY pool_rank) = 1) h ON h.query_id = a.query_id AND h.path = a.path
            LEFT JOIN (SELECT path, chunk_id, text FROM rows WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY chunk_index, chunk_id) = 1) s ON s.path = a.path
            WHERE a.path IS NOT NULL AND coalesce(h.chunk_id, s.chunk_id) IS NOT NULL)""",
        """neg AS (SELECT m.query_id, m.chunk_id, m.path, m.pool_rank FROM mine m JOIN pos p ON p.query_id = m.query_id WHERE m.path <> p.gold AND m.text <> p.text QUALIFY row_number() OVER (PARTITION BY m.query_id, m.path ORDER BY m.pool_rank) = 1)""")
    + """SELECT query_id, 1 AS label, chunk_id FROM pos UNION ALL SELECT query_id, 0, chunk_id FROM (SELECT * FROM neg QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pool_rank) <= 4)""",
    "drop_known": f"SELECT pair_id FROM pairs WHERE query IS NOT NULL AND {bare('query')} NOT IN (SELECT {bare('query')} FROM probes WHERE query IS NOT NULL)",
    "doc_split": """WITH ranked AS (SELECT path, row_number() OVER (ORDER BY md5('17|' || path), path) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT path FROM pairs WHERE path IS NOT NULL))
        SELECT pair_id, p.path, CASE WHEN r <= greatest(1, floor(0.15 * n)) THEN 'val' ELSE 'train' END AS part FROM pairs p LEFT JOIN ranked USING (path)""",
    "val_unseen": "SELECT pair_id, query FROM pairs WHERE split = 'val' AND query IS NOT NULL AND query NOT IN (SELECT query FROM pairs WHERE split = 'train' AND query IS NOT NULL)",
    "shared_queries": "SELECT query FROM pairs WHERE split = 'train' AND query IS NOT NULL INTERSECT SELECT query FROM pairs WHERE split = 'val' AND query IS NOT NULL",
    "todo_anchors": "SELECT DISTINCT id, style FROM anchors, (SELECT unnest(['keyword', 'natural', 'paraphrase', 'partial']) AS style) WHERE id IS NOT NULL EXCEPT SELECT anchor_id, style FROM pairs",
    "typo_variants": with_(TYPOS) + "SELECT * FROM typos",
    "augmented_train": with_(TYPOS) + """SELECT style, count(*) AS n, count(DISTINCT query) AS n_queries FROM (SELECT query, style FROM pairs WHERE split = 'train' UNION ALL SELECT query, style FROM typos
        UNION ALL SELECT query, 'general' FROM probes WHERE passage IS NOT NULL) GROUP BY style""",
    "capped_negatives": f"SELECT pair_id, label FROM pairs WHERE label = 1 UNION ALL SELECT pair_id, label FROM ({NEG4})",
    "ranking_groups": """WITH g AS (SELECT query, first(doc ORDER BY pair_id) FILTER (label = 1) AS pos, list(doc ORDER BY pair_id) FILTER (label = 0) AS neg FROM pairs WHERE query IS NOT NULL AND doc IS NOT NULL GROUP BY query)
        SELECT query, md5(pos) AS positive, list_transform(range(0, 4), lambda j: md5(neg[j % least(len(neg), 4) + 1])) AS negatives FROM g WHERE pos IS NOT NULL AND len(neg) > 0""",
    "example_triples": with_(EXAMPLES) + "SELECT * FROM examples",
    "shown_examples": with_(EXAMPLES) + "SELECT * FROM examples ORDER BY md5('19|' || query), query LIMIT 6",
    "first_passages": """WITH g AS (SELECT query, first(doc ORDER BY pair_id) FILTER (label = 1) AS yes, coalesce(list(doc ORDER BY pair_id) FILTER (label = 0), []) AS no FROM pairs WHERE query IS NOT NULL AND doc IS NOT NULL GROUP BY query)
        SELECT query, md5(yes) AS doc, 1 AS label FROM g WHERE yes IS NOT NULL UNION ALL SELECT query, md5(unnest(no[1:2])), 0 FROM g WHERE yes IS NOT NULL""",
    "leak_paths": """SELECT path, n_rows, n_items FROM (SELECT path, count(*) AS n_rows FROM chunks WHERE path IS NOT NULL GROUP BY path)
        JOIN (SELECT path, count(DISTINCT query) AS n_items FROM pairs WHERE split = 'val' AND label = 1 AND query IS NOT NULL GROUP BY path) USING (path)""",
    "shared_paths": "SELECT path FROM files WHERE path IS NOT NULL INTERSECT SELECT path FROM chunks",
    "leak_exact": f"SELECT pair_id AS row_id, probe_id AS item_id FROM pairs JOIN probes ON {normal('doc')} = {normal('passage')} WHERE {normal('passage')} <> ''",
    "leak_contained": f"""SELECT row_id, item_id FROM (SELECT pair_id AS row_id, {normal("doc")} AS t FROM pairs WHERE doc IS NOT NULL) JOIN (SELECT probe_id AS item_id, {normal("passage")} AS b FROM probes WHERE length({normal("passage")}) > 40)
        ON contains(t, b) OR contains(b, t) WHERE t <> ''""",
    "leak_tokens": f"""WITH a AS (SELECT DISTINCT pair_id, lower(raw) AS token FROM (SELECT pair_id, unnest(regexp_extract_all(doc, '{IDENT}')) AS raw FROM pairs) WHERE {DISTINCTIVE}),
        b AS (SELECT DISTINCT probe_id, lower(raw) AS token FROM (SELECT probe_id, unnest(regexp_extract_all(passage, '{IDENT}')) AS raw FROM probes) WHERE {DISTINCTIVE})
        SELECT token, n_rows, n_items FROM (SELECT token, count(*) AS n_rows FROM a GROUP BY token) JOIN (SELECT token, count(*) AS n_items FROM b GROUP BY token) USING (token)""",
    "dedupe_groups": with_(STORED, GROUPS) + "SELECT size, hash, keep, n_copies, size * (n_copies - 1) AS wasted FROM grouped",
    "dedupe_plan": with_(STORED, GROUPS) + f"SELECT 'trash' AS kind, path AS src, 'exact duplicate of ' || {base('keep')} || ' (kept oldest copy)' AS reason FROM stored JOIN grouped USING (size, hash) WHERE path <> keep",
    "organise_by_type": with_(LATEST, f"kinds AS (SELECT path, {CATEGORY} AS target FROM latest)")
    + f"SELECT path AS src, regexp_extract(path, '^(.*/)[^/]*$', 1) || target || '/' || {base('path')} AS dest, 'by-type: ' || target || '/' AS reason FROM kinds WHERE {base('path')} <> '' AND {base('path')} NOT LIKE '.%' AND {parent('path')} <> target",
    "organise_by_date": f"""SELECT path AS src, regexp_extract(path, '^(.*/)[^/]*$', 1) || m || '/' || {base("path")} AS dest, 'by-date: ' || m || '/' AS reason
        FROM (SELECT DISTINCT path, modified_at, strftime(modified_at AT TIME ZONE 'UTC', '%Y-%m') AS m FROM documents WHERE path IS NOT NULL AND modified_at IS NOT NULL) WHERE {base("path")} <> '' AND {base("path")} NOT LIKE '.%' AND {parent("path")} <> m""",
    "rename_batches": "SELECT folder, path FROM (SELECT DISTINCT path, regexp_extract(path, '^(.*/)[^/]*$', 1) AS folder FROM files WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY path) <= 50",
    "shown_history": f"SELECT pair_id FROM pairs WHERE label IS NOT NULL AND anchor_id IS NOT NULL AND {strip('query')} <> ''",
    "selected_moves": with_(LATEST, f"kinds AS (SELECT path, {CATEGORY} AS target FROM latest WHERE size >= 1024)")
    + f"SELECT path AS src, regexp_extract(path, '^(.*/)[^/]*$', 1) || target || '/' || {base('path')} AS dest, 'by-type: ' || target || '/' AS reason FROM kinds WHERE {base('path')} <> '' AND {base('path')} NOT LIKE '.%' AND {parent('path')} <> target",
    "plan_validation": with_(LATEST, FLAT) + "SELECT src, dest, problem FROM flat",
    "plan_outcome": with_(LATEST, FLAT) + "SELECT regexp_extract(src, '^([^/]*)/', 1) AS folder, count(*) FILTER (problem IS NULL) AS ok, count(*) AS total FROM flat GROUP BY 1",
    "change_debounce": "SELECT time_bucket(INTERVAL 2 SECONDS, ts) AS start, user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL",
}
SQL["stream_debounce"] = SQL["change_debounce"]
