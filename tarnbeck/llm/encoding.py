"""Text that was decoded with the wrong encoding: finding it and undoing it.

A hidden Markov model labels characters. Its states are clean text and one per
encoding pair (the bytes' encoding, the one they were read as). A state emits
a character given the one before it; plain ASCII is told apart by kind only,
and only where a character beyond ASCII stands next to it. Clean emissions
are counted on a bounded sample of the documents, those of a pair on the same
sample put through the pair. Every labelled span gets its pair's inverse.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.lineage import spread

# Encoding pairs (bytes in the first, read as the second), each a state.
UTF8_READ_AS = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8_r", "gbk", "shift_jis", "utf_16_le", "utf_16_be")
READ_AS_WESTERN = ("cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "iso8859_5", "cp1253", "iso8859_7", "shift_jis", "euc_jp", "gbk", "big5", "mac_roman", "cp437", "cp850")
OTHERS = (("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1252", "utf_8"), ("shift_jis", "utf_8"), ("gbk", "utf_8"), ("cp1251", "utf_8"), ("cp1250", "utf_8"))
PAIRS: tuple[tuple[str, ...], ...] = (
    *(("utf_8", d) for d in UTF8_READ_AS),
    ("utf_8", "cp1252", "utf_8", "cp1252"),
    ("utf_8", "latin_1", "utf_8", "latin_1"),
    *((s, "cp1252") for s in READ_AS_WESTERN),
    *OTHERS,
)
MARKED = {("utf_8", d) for d in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251")}  # pairs that also learn a byte order mark
STAY, LEAVE = np.log(0.97), np.log(0.03)
ENTER = np.log([1e-3 if p[0] == "utf_8" else 1e-5 for p in PAIRS])  # bytes of UTF-8 leave a form that can be checked, so a weak sign is enough
PRIOR = 3.0  # weight of a character's own probability against its probability after the one before
_C1 = {i: None for i in range(0x80, 0xA0)}


@lru_cache(maxsize=None)
def _windows(name: str) -> tuple[dict[int, str], dict[int, str]]:
    """Translations from and to latin-1. Bytes that a Windows code page leaves undefined become control characters, as most readers have it."""
    read = {b: bytes([b]).decode(name, "ignore") or chr(b) for b in range(0x80, 0x100)}
    return read, {ord(c): chr(b) for b, c in read.items()}


def decode(data: bytes, name: str, errors: str = "replace") -> str:
    return data.decode("latin_1").translate(_windows(name)[0]) if name.startswith("cp125") else data.decode(name, errors)


def encode(text: str, name: str, errors: str = "strict") -> bytes:
    """The inverse of ``decode``; raises on characters that the encoding lacks."""
    if not name.startswith("cp125"):
        return text.encode(name, errors)
    table = _windows(name)[1]
    return "".join([c if c < "\x80" else table.get(ord(c)) or ("" if errors == "ignore" else "\u0100") for c in text]).encode("latin_1", errors)


def garble(text: str, pair: tuple[str, ...]) -> str:
    for source, target in zip(pair[::2], pair[1::2]):
        text = decode(encode(text, source, "ignore"), target)
    return text


def ungarble(text: str, pair: tuple[str, ...]) -> str | None:
    """The original of a span, None if it can't be recovered whole (a replacement character stands for lost bytes)."""
    if "\ufffd" in text:
        return None
    try:
        for source, target in zip(pair[-2::-2], pair[::-2]):
            text = decode(encode(text, target), source, "strict")
        return text
    except (UnicodeError, ValueError):
        return None


_REFERENCE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});|\\u[0-9a-fA-F]{4}")


def unescaped(text: str) -> str:
    """The text with character references and escapes of characters beyond ASCII resolved; others, and halves of surrogates, stay."""

    def resolve(m: re.Match) -> str:
        c = chr(int(m[0][2:], 16)) if m[0][0] == "\\" else html.unescape(m[0])
        return m[0] if c.isascii() or any(x == "\ufffd" or "\ud800" <= x <= "\udfff" for x in c) else c

    return _REFERENCE.sub(resolve, text)


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|\xe2[\x80\x82]")  # the last: punctuation whose third byte was lost


def well_formed(text: str, pair: tuple[str, ...]) -> bool:
    """Whether half of the span's bytes beyond ASCII form characters of UTF-8, as it is or before its case was changed."""
    for t in (text, text.upper(), text.lower(), text.title()):
        data = encode(t, pair[-1], "ignore")
        beyond = sum(b >= 0x80 for b in data)
        if beyond and 2 * sum(map(len, _SEQUENCE.findall(data))) >= beyond:
            return True
    return False


_KIND = np.full(128, 5, np.int64)
for _kinds, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r\n", 4)):
    _KIND[[ord(c) for c in _kinds]] = _k


def observed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, characters and their predecessors, where one of the two is beyond ASCII; ASCII by kind."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    symbol = np.where(code < 128, _KIND[np.minimum(code, 127)], code)
    before = np.concatenate([[4], symbol[:-1]])  # the start is as white space
    at = np.flatnonzero((code >= 128) | (before >= 128))
    return at, symbol[at], before[at]


@lru_cache(maxsize=None)
def repertoire(name: str) -> np.ndarray | None:
    """Characters that reading bytes in a one-byte encoding can give, and their lower case; None for other encodings."""
    if name in ("utf_8", "gbk", "shift_jis", "utf_16_le", "utf_16_be"):
        return None
    text = decode(bytes(range(128, 256)), name)
    return np.array(sorted({ord(c) for c in text + text.lower() + text.upper()}), np.int64)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character pairs of the texts (predecessor and character in one number), and how often each occurs."""
    seen = [observed(text)[1:] for text in texts]
    symbol, before = (np.concatenate([np.empty(0, np.int64), *(x[i] for x in seen)]) for i in (0, 1))
    return np.unique(before << 21 | symbol, return_counts=True)


def viterbi(emissions: list[np.ndarray], enter: np.ndarray, most: int = 1 << 18) -> list[np.ndarray]:
    """The likeliest states of each sequence (positions x states). Sequences of like length run side by side, ``most`` positions at a time."""
    states = np.arange(len(enter), dtype=np.int16)
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(emissions)
    order = sorted((i for i, e in enumerate(emissions) if len(e)), key=lambda i: -len(emissions[i]))
    while order:
        long = len(emissions[order[0]])
        lanes, order = order[: max(1, most // long)], order[max(1, most // long) :]
        size = np.array([len(emissions[i]) for i in lanes])
        e = np.zeros((long, len(lanes), len(enter)), np.float32)
        for k, i in enumerate(lanes):
            e[: size[k], k] = emissions[i]
        active = np.searchsorted(-size, -np.arange(1, long + 1), side="right")  # lanes with more than so many positions before
        via = np.zeros(e.shape, np.int16)
        v = enter + e[0]
        for i in range(1, long):
            n = active[i]
            now, row = v[:n], np.arange(n)
            best = np.argmax(now[:, 1:], axis=1) + 1
            leave = now[row, best] + LEAVE
            stay, begin = now + STAY, now[:, :1] + enter
            via[i, :n] = np.where(stay >= begin, states, 0)
            new = np.maximum(stay, begin)
            out_ = leave > now[:, 0]
            via[i, :n, 0] = np.where(out_, best, 0)
            new[:, 0] = np.where(out_, leave, now[:, 0])
            v[:n] = new + e[i, :n]
        at = np.argmax(v, axis=1)
        path = np.zeros((long, len(lanes)), np.int64)
        for i in range(long - 1, 0, -1):
            n = active[i]
            path[i, :n] = at[:n]
            at[:n] = via[i, np.arange(n), at[:n]]
        path[0] = at
        for k, i in enumerate(lanes):
            out[i] = path[: size[k], k]
    return out


class Model:
    """Emission tables of all states; state 0 is clean."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """``counts``: for each state what ``counted`` gives for its texts."""
        self.states = sorted(counts)
        self.enter = ENTER[np.array(self.states[1:], np.int64) - 1]
        found = [counts[s] for s in self.states]
        self.keys = np.unique(np.concatenate([keys for keys, _ in found]))
        left, right = self.keys >> 21, self.keys & ((1 << 21) - 1)
        n = np.zeros((len(self.keys), len(found)))
        for i, (keys, many) in enumerate(found):
            n[np.searchsorted(self.keys, keys), i] = many
        self.chars, self.lefts = np.unique(right), np.unique(left)
        one = np.zeros((len(self.chars) + 1, len(found)))
        np.add.at(one, np.searchsorted(self.chars, right), n)
        one = (one + 0.02) / (one.sum(axis=0) + 0.02 * 40_000)  # characters never seen share what 40,000 of them would have
        for i, s in enumerate(self.states):
            able = repertoire(PAIRS[s - 1][-1]) if s else None
            if able is not None:  # a one-byte encoding can't have given other characters
                one[:, i] = np.where(np.isin(np.append(self.chars, 0), able) | (np.append(self.chars, 1 << 20) < 128), one[:, i], 1e-12)
        after = np.zeros((len(self.lefts) + 1, len(found)))
        np.add.at(after, np.searchsorted(self.lefts, left), n)
        own = one[np.searchsorted(self.chars, right)]
        self.pair = np.log((n + PRIOR * own) / (after[np.searchsorted(self.lefts, left)] + PRIOR)).astype(np.float32)
        self.one = np.log(one).astype(np.float32)
        self.back = np.log(PRIOR / (after + PRIOR)).astype(np.float32)

    @staticmethod
    def _find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, x), max(0, len(table) - 1))
        return at, table[at] == x if len(table) else np.zeros(len(x), bool)

    def emissions(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        at, known = self._find(self.keys, before << 21 | symbol)
        c, has = self._find(self.chars, symbol)
        b, had = self._find(self.lefts, before)
        fallback = self.one[np.where(has, c, -1)] + self.back[np.where(had, b, -1)]
        return np.where(known[:, None], self.pair[at], fallback) if len(self.keys) else fallback

    def label(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text positions and states of the characters that count; empty where all are clean."""
        none = np.empty(0, np.int64)
        out = [(none, none)] * len(texts)
        open_, waiting = [], []
        for i, text in enumerate(texts):
            at, symbol, before = observed(text)
            if not len(at) or len(self.states) == 1:
                continue
            e = self.emissions(symbol, before)
            gain = e[:, 1:] - e[:, :1]
            for enter in np.unique(self.enter):  # not even the best stretch outweighs entering another state
                run = np.cumsum(gain[:, self.enter == enter].max(axis=1), dtype=np.float64)
                if (run - np.minimum.accumulate(np.concatenate([[0.0], run[:-1]]))).max() + enter > 0:
                    open_.append((i, at))
                    waiting.append(e)
                    break
        for (i, at), path in zip(open_, viterbi(waiting, np.concatenate([[0.0], self.enter]))):
            if path.any():
                out[i] = (at, path)
        return out

    def likely(self, text: str) -> float:
        """Log probability of a clean text."""
        _, symbol, before = observed(text)
        return float(self.emissions(symbol, before)[:, 0].sum()) if len(symbol) else 0.0

    def holds(self, text: str, a: int, e: int, pair: tuple[str, ...]) -> bool:
        """Whether a labelled span is what its pair makes: UTF-8 has its form, bytes of other encodings make a likelier text."""
        span = text[a:e]
        back = ungarble(span, pair)
        if back == span:
            return False
        if "\ufffd" in span or repertoire(pair[-1]) is None:
            return True
        if pair[0] == "utf_8" and not well_formed(span, pair):
            return False
        if back is None:
            if pair[0] == "utf_8":
                return True
            back = decode(encode(span, pair[-1], "ignore"), pair[0])
        before, after = text[max(0, a - 2) : a], text[e : e + 2]
        return self.likely(before + back + after) > self.likely(before + span + after)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Start, end and state of each garbled span of each text."""
        return [self.held(text, at, path) for text, (at, path) in zip(texts, self.label(texts))]

    def held(self, text: str, at: np.ndarray, path: np.ndarray) -> list[tuple[int, int, int]]:
        out: list[tuple[int, int, int]] = []
        last = 0
        for p, s in zip(at.tolist(), path.tolist()):
            if s and ord(text[p]) >= 128:
                if last == s:
                    out[-1] = (out[-1][0], p + 1, s)
                else:
                    out.append((p, p + 1, s))
            if ord(text[p]) >= 128:
                last = s
        return [(a, b, self.states[s]) for a, b, s in out if self.holds(text, a, b, PAIRS[self.states[s] - 1])]


_LEAD = {n: re.compile("[" + re.escape("".join(decode(bytes([b]), n) for b in range(0xC2, 0xF5))) + "][" + re.escape("".join(decode(bytes([b]), n) for b in range(0x80, 0xC0))) + "]") for n in ("cp1252", "mac_roman", "cp437", "cp850", "cp1251")}


def _plain(byte: int) -> bool:
    return 0x20 <= byte < 0x7F or byte in (9, 10, 13)


def suspicious(text: str) -> bool:
    """Rough first guess, only to keep garbled text out of the first clean counts."""
    if any("\x80" <= c < "\xa0" or c == "\ufffd" for c in text) or _LEAD["cp1252"].search(text):
        return True
    wide = [divmod(ord(c), 256) for c in text if "\x80" <= c < "\U00010000"]
    if sum(_plain(a) and _plain(b) for a, b in wide) * 10 > len(wide) * 9:  # two bytes of ASCII in one character
        return True
    return any(len(r.findall(text)) * 4 > len(text) ** 0.5 for r in _LEAD.values())


def garbled_by(pair: tuple[str, ...], texts: list[str], most: int) -> list[tuple[int, str]]:
    """Up to ``most`` of the texts, by number, put through a pair that keeps and changes enough of what is beyond ASCII."""
    out: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        if len(out) == most:
            break
        if pair[1].startswith("utf_16"):
            out.append((i, garble(t, pair)))
            continue
        marks = [c for c in t if c >= "\x80"]
        if not marks or len(decode(encode("".join(marks), pair[0], "ignore"), pair[0])) * 2 < len(marks):
            continue
        g = garble(t, pair)
        if sum((Counter(marks) & Counter(c for c in g if c >= "\x80")).values()) * 5 <= len(marks) * 3:
            out.append((i, g))
    return out


def training_texts(state: int, texts: list[str], kept: set[int], most: int) -> list[str]:
    """What a state's counts come from: the kept texts, or those put through its pair, and what may have been done to them afterwards."""
    clean = [texts[i] for i in sorted(kept)]
    if state == 0:
        return [*clean, *(t.upper() for t in clean[::4]), *(t.lower() for t in clean[::8])]
    pair = PAIRS[state - 1]
    source = [g for i, g in garbled_by(pair, texts, 2 * most) if i in kept][:most]
    if pair in MARKED:
        source += [garble("\ufeff" + t[:40], pair) for t in clean[: most // 3]]
    return source + [g.lower() for g in source[::3]] + [g.replace("\xa0", " ").translate(_C1) for g in source[::4]]


def fit(spark: SparkSession, sample: list[str], rounds: int = 2, most: int = 250) -> Model:
    """A model from unlabelled texts: what a round labels as garbled is left out of the next round's counts.

    A task counts for some of the states; the driver joins the counts into tables.
    """
    texts = [t for t in sample if not suspicious(t)]
    shared = spark.sparkContext.broadcast(texts)
    kept = set(range(len(texts)))
    states = spark.range(len(PAIRS) + 1, numPartitions=len(PAIRS) + 1)
    for i in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], kept: set[int] = kept) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for state in b.column(0).to_pylist():
                    keys, n = counted(training_texts(state, shared.value, kept, most))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), state)), pa.array(keys), pa.array(n)], names=["state", "pair", "n"])

        rows = states.mapInArrow(count, "state long, pair long, n long").toArrow()
        state, pair, n = (rows[c].combine_chunks().to_numpy() for c in ("state", "pair", "n"))
        order = np.lexsort((pair, state))
        state, pair, n = state[order], pair[order], n[order]
        model = Model({0: (pair[:0], n[:0])} | {int(s): (pair[state == s], n[state == s]) for s in np.unique(state)})
        if i < rounds - 1:
            tables = spark.sparkContext.broadcast(model)

            def label(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    ids = b.column(0).to_pylist()
                    found = tables.value.spans([shared.value[i] for i in ids])
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, spans in zip(ids, found) if spans], pa.int64())], names=["i"])

            kept -= {r.i for r in spark.range(len(texts)).mapInArrow(label, "i long").collect()}
    return model


def repair(docs: DataFrame, sample_docs: int = 2500, sample_chars: int = 1000) -> DataFrame:
    """(doc_id, encodings, n_spans, recovered, text): the garbled documents and what could be restored.

    ``docs`` needs doc_id and text; other columns are ignored. encodings names
    the pairs found (bytes' encoding, then what they were read as). recovered
    tells whether every span had an exact inverse; spans without one stay as
    they are in ``text``. Null and blank texts, and pure ASCII ones without escapes, are never garbled; repeated
    texts each come out; an empty table gives an empty result. Text whose
    garbled characters were escaped afterwards (character references, ``\\u``)
    is labelled, and restored, with the escapes resolved.

    The model is fitted on at most ``sample_docs`` documents, a window of ``sample_chars``
    characters of each (a hash picks both, so the model doesn't depend on how the table is stored); all documents are labelled as a whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    total = rows.count()
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40))
    start = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int") + 1
    part = min(1.0, 1.2 * sample_docs / max(total, 1) + 200 / max(total, 1))
    picked = rows.where(drawn <= int(part * (1 << 40))).select(drawn.alias("h"), "doc_id", F.col("text").substr(start, F.lit(sample_chars)).alias("text"))
    sample = [unescaped(r.text) for r in picked.orderBy("h", "doc_id", "text").limit(sample_docs).collect()]
    model = spark.sparkContext.broadcast(fit(spark, sample))
    names = [" > ".join(p) for p in PAIRS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"doc_id": [], "encodings": [], "n_spans": [], "recovered": [], "text": []}
            every = [(doc, text if "&" not in text and "\\u" not in text else unescaped(text)) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            every = [(doc, plain) for doc, plain in every if not plain.isascii()]
            for (doc, plain), spans in zip(every, model.value.spans([plain for _, plain in every])):
                if not spans:
                    continue
                parts, at, whole = [], 0, True
                for a, e, s in spans:
                    back = ungarble(plain[a:e], PAIRS[s - 1])
                    whole &= back is not None
                    parts += [plain[at:a], plain[a:e] if back is None else back]
                    at = e
                for k, v in zip(out, (doc, sorted({names[s - 1] for _, _, s in spans}), len(spans), whole, "".join([*parts, plain[at:]]))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("encodings", pa.list_(pa.string())), ("n_spans", pa.int32()), ("recovered", pa.bool_()), ("text", pa.string())]))

    return spread(rows).mapInArrow(run, "doc_id long, encodings array<string>, n_spans int, recovered boolean, text string")
