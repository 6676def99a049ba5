"""Quality rules as a short-circuit cascade, ordered by what a sample tells of cost and rejection."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ._shared import sample_by_hash, sliced

#: Rows of the sample on which cost and rejection are estimated. It decides the order of rules, never a verdict.
SAMPLE_ROWS, WINDOW = 500, 8
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


class TextStats:
    """Counts of one text, each made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # for bytes, at exactly the six ASCII white-space characters

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\r\x0b\x0c"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of WINDOW words that occur twice or more, the first occurrence included."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        ids = self.ids.astype(np.uint64)
        with np.errstate(over="ignore"):
            codes = np.zeros(n, np.uint64)
            for k in range(WINDOW):
                codes = codes * np.uint64(0x9E3779B97F4A7C15) + (ids[k : k + n] + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
                codes ^= codes >> np.uint64(31)
        order = np.argsort(codes, kind="stable")
        same = codes[order][1:] == codes[order][:-1]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if not twice.any():
            return 0
        starts = np.flatnonzero(twice)
        groups: dict[tuple, list[int]] = {}
        for s in starts.tolist():  # equal hashes are compared in full
            groups.setdefault(tuple(self.ids[s : s + WINDOW].tolist()), []).append(s)
        cover = np.zeros(self.n_words + 1, np.int64)
        for found in groups.values():
            if len(found) > 1:
                np.add.at(cover, found, 1)
                np.add.at(cover, np.array(found) + WINDOW, -1)
        return int((np.cumsum(cover)[:-1] > 0).sum())

    @cached_property
    def n_runs(self) -> int:
        """Words equal to the word before."""
        return int((self.ids[1:] == self.ids[:-1]).sum())


#: A rule rejects a text where it is true. Their order here does not matter.
RULES: dict[str, Callable[[TextStats], bool]] = {
    "few_words": lambda s: s.n_words < 20,
    "repeated_windows": lambda s: 100 * s.n_repeat_words > 30 * s.n_words,
    "symbols": lambda s: 10 * s.n_symbols > 3 * s.n_words,
    "duplicate_lines": lambda s: 10 * s.n_dup_lines > 5 * len(s.lines),
    "word_runs": lambda s: 100 * s.n_runs > 30 * s.n_words,
    "word_length": lambda s: not 2 * s.n_words <= s.word_chars <= 14 * s.n_words,
}
BASE = ("few_words", "repeated_windows")


def measured(texts: list[str | None], rules: dict[str, Callable]) -> dict[str, tuple[float, float]]:
    """(seconds a text, share rejected) of each rule alone, on fresh statistics."""
    out = {}
    for name, rule in rules.items():
        began = time.perf_counter()
        rejected = sum(bool(rule(TextStats(t))) for t in texts)
        out[name] = ((time.perf_counter() - began) / max(1, len(texts)), rejected / max(1, len(texts)))
    return out


def cascade_order(docs: DataFrame, rules: dict[str, Callable] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejection per cost on ``rows`` rows of smallest hash; names break ties. Tasks measure; sums reach the driver."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 50):
            cost = measured(batch.column(0).to_pylist(), rules)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(cost)), pa.array([s * n for s, _ in cost.values()]), pa.array([r * n for _, r in cost.values()])], ["rule", "seconds", "rejected"])

    some = sample_by_hash(docs.select("doc_id", "text"), "doc_id", rows, docs.count()).select("text")
    sums = some.mapInArrow(measure, "rule string, seconds double, rejected double").groupBy("rule").agg(F.sum("rejected").alias("r"), F.sum("seconds").alias("s")).collect()
    gain = {r["rule"]: r["r"] / max(r["s"], 1e-9) for r in sums}
    return sorted(rules, key=lambda r: (-gain.get(r, 0.0), r))


def first_failed(stats: TextStats, order: list[str], rules: dict[str, Callable] = RULES) -> str | None:
    return next((name for name in order if rules[name](stats)), None)


def apply_rules(docs: DataFrame, rules: dict[str, Callable] = RULES, order: list[str] | None = None) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule of the cascade that rejects the text, null for kept rows.

    Which rule is named depends on the measured order; whether one is does not. Null and empty texts have no words
    (few_words rejects them); texts are read whole; every row is judged alone, so repeated rows fare alike; all
    columns stay (one named rejected_by is replaced); no rows give none.
    """
    order = order or cascade_order(docs, rules)
    rows = docs.drop("rejected_by")
    at = rows.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            failed = [first_failed(TextStats(t), order, rules) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed, pa.string())], [*batch.schema.names, "rejected_by"])

    return rows.mapInArrow(judge, StructType([*rows.schema, StructField("rejected_by", StringType())]))


def text_statistics(docs: DataFrame, rules: dict[str, Callable] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, the counts of TextStats, base_failed and kept (the whole cascade's verdict) for every row."""
    order = order or cascade_order(docs, rules)
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                stats = TextStats(t)
                rows.append([*(getattr(stats, c) for c in counts), any(rules[b](stats) for b in BASE), first_failed(stats, order, rules) is None])
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])], ["doc_id", *counts, "base_failed", "passed"]
            )

    out = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, passed boolean")
    return out.selectExpr("doc_id", *counts, "base_failed", "not base_failed and passed as kept")
