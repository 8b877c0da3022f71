"""Secret scans by one automaton of all rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.llm.automaton import SEPARATOR, Rule, Scanner
from apothecary.llm.common import chosen, slices

BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

#: Public formats of credentials, after the base kinds. Lengths of open ends are
#: tested after the match: counted in the automaton they multiply its states.
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]+", least=24),
)

_LOAD = 1 << 20  # bytes of text that a task scans at a time


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def spans_of(scan: Scanner, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of the matches in each UTF-8 text, by start and then kind."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    points: dict[int, np.ndarray] = {}  # code points before each byte, of texts with matches
    for start, end, k in scan.find(SEPARATOR.join(texts)):
        of = int(np.searchsorted(starts, start, side="right")) - 1
        a, b = start - int(starts[of]), end - int(starts[of])
        if not texts[of].isascii():
            if of not in points:
                points[of] = np.cumsum(np.r_[0, (np.frombuffer(texts[of], dtype=np.uint8) & 0xC0) != 0x80])
            a, b = int(points[of][a]), int(points[of][b])
        out[of].append((scan.rules[k].kind, a, b))
    return out


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """``text`` with each stretch that spans cover replaced by ``mask``."""
    out, at, done = [], 0, 0
    for _, start, end in spans:
        if start >= done:
            out += [text[at:start], mask]
        at = done = max(done, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mask: str | None = None) -> DataFrame:
    """The secrets in each whole text: doc_id and ``spans``, an array of kind, start and end (code points, end exclusive).

    Spans come by start and then in the rules' order; within a kind they don't
    overlap. With ``mask``, a column ``masked`` has the text with each covered
    stretch replaced by it.

    One row a row of ``docs``: null texts count as empty and have no spans,
    null ids stay null, repeated rows get equal results, other columns are
    left out whatever their names, and an empty table gives an empty result.
    Letters of ``any_case`` rules are ASCII. The automaton is built once on the
    driver; its size depends on the rules alone. Texts are scanned in the tasks
    that read them, without a shuffle; a long one in blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner(tuple(rules)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in (g for whole in batches for g in slices(whole, "data", _LOAD)):
            texts = batch.column("data").to_pylist()
            spans = spans_of(shared.value, texts)
            columns = {"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind) if any(spans) else pa.array([[] for _ in spans], kind)}
            if mask is not None:
                columns["masked"] = pa.array([masked(t.decode(), s, mask) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    data = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return data.mapInArrow(scan, "doc_id long, spans array<struct<kind string, start long, end long>>" + (", masked string" if mask is not None else ""))
