"""A single answer as a stream of events over the hits of a search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .retrieval import MOST_HITS, SEPARATOR, block

# The kinds of events a client knows, and why there may be no generated text.
CITATIONS, TOKEN, FALLBACK, DONE, ERROR = "citations", "token", "fallback", "done", "error"
NO_RESULTS, NO_MODEL = "no-results", "no-model"
Model = Callable[[str, str], Iterator[str]]


def body(rows: list[Row], question: str, model: Model | None) -> Iterator[dict]:
    """The model's text over the hits, or the reason why there is none."""
    if rows and model:
        yield from ({"type": TOKEN, "text": piece} for piece in model(SEPARATOR.join(r.block for r in rows), question))
    else:
        yield {"type": FALLBACK, "reason": NO_MODEL if rows else NO_RESULTS}


def answer(hits: DataFrame, question: str, model: Model | None = None) -> Iterator[dict]:
    """Events of one query: its citations, its text, the end. ``hits`` runs once; no more than ``MOST_HITS`` of its rows are read."""
    if not 1 <= len(question) <= 4000:
        raise ValueError("a question has 1 to 4000 characters")
    cited = hits.select("ref", "path", "name", "score", F.substring("text", 1, 240).alias("preview"), block().alias("block"))
    rows = cited.orderBy("ref").limit(MOST_HITS).collect()
    yield {"type": CITATIONS, "citations": [{k: v for k, v in r.asDict().items() if k != "block"} for r in rows]}
    end: dict = {"type": DONE}
    try:
        yield from body(rows, question, model)
    except Exception as e:  # noqa: BLE001  whatever a model raises ends the stream, not the caller
        end = {"type": ERROR, "error": str(e)}
    yield end
