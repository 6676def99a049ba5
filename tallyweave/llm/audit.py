"""What each filter of a chain removes in every order: a byte transducer finds the facts, Spark counts the interactions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._words import Spans, first_of_kind, sliced_bytes, text_bytes

#: The filters, a bit of a failure mask each, A lowest.
FILTERS = "ABCDE"
#: Conditions: fewest words; least share of distinct words; most share of capitals (per cent); characters that fail a text.
FEWEST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 200, 50, 2, b"#$%&*|"

#: States, kinds of byte, and what a step may say.
OUT, IN = 0, 1
SPACE, PLAIN, CAPITAL, SYMBOL, INNER = range(5)
POINT, BEGINS, ENDS, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16


def _transducer() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind of each byte, state after each (state, kind), output of each (state, kind))."""
    kind = np.full(256, PLAIN, np.uint8)
    kind[0x80:0xC0] = INNER  # not the first byte of a code point
    kind[list(b" \t\n\x0b\x0c\r")] = SPACE
    kind[ord("A") : ord("Z") + 1] = CAPITAL
    kind[list(SYMBOLS)] = SYMBOL
    after, says = np.zeros(10, np.uint8), np.zeros(10, np.uint8)
    for state in (OUT, IN):
        for k in range(5):
            after[5 * state + k] = OUT if k == SPACE else IN
            says[5 * state + k] = (
                POINT * (k != INNER) | BEGINS * (state == OUT and k != SPACE) | ENDS * (state == IN and k == SPACE) | IS_CAPITAL * (k == CAPITAL) | IS_SYMBOL * (k == SYMBOL)
            )
    return kind, after, says


KIND, AFTER, SAYS = _transducer()


def transduced(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The transducer's output at every byte; each text begins OUT.

    The state after a byte hangs on that byte's kind alone (AFTER has equal halves), so the table gives all states at once.
    """
    kind = KIND[data]
    state = np.zeros(len(data), np.uint8)
    state[1:] = AFTER[kind[:-1]]
    state[bounds[:-1][bounds[:-1] < bounds[1:]]] = OUT
    return SAYS[5 * state + kind]


def counted(texts: pa.Array) -> dict[str, np.ndarray]:
    """Of each text (null: empty): words, distinct words, capitals, code points, symbols."""
    data, bounds = text_bytes(texts)
    said = transduced(data, bounds)
    each = lambda bit: np.flatnonzero(said & bit)
    per_text = lambda at: np.diff(np.searchsorted(at, bounds))
    begins, ends = each(BEGINS), each(ENDS)
    owner = np.searchsorted(bounds, begins, "right") - 1
    close = np.append(ends, len(data))[np.searchsorted(ends, begins)]  # the next end, or that of the text
    words = Spans(data, begins, np.minimum(close, bounds[1:][owner]) - begins, owner)
    distinct = np.bincount(owner[first_of_kind(words)], minlength=len(texts))
    return {"n_words": per_text(begins), "n_distinct": distinct, "n_capitals": per_text(each(IS_CAPITAL)), "n_points": per_text(each(POINT)), "n_symbols": per_text(each(IS_SYMBOL))}


_FACTS = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]


def text_facts(docs: DataFrame) -> DataFrame:
    """doc_id, part (source; null: empty string), digest (of the text) and the transducer's five counts of every row.

    A null text counts as empty; texts are read whole, a long one alone; a task's memory is some ten times the longest text.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_bytes(batches, 3):
            found = counted(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[n], pa.int64()) for n in _FACTS)], ["doc_id", "part", "digest", *_FACTS])

    return rows.mapInArrow(count, f"doc_id {kind}, part string, digest binary, {', '.join(f'{n} long' for n in _FACTS)}")


def failure_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask (the filters that a row fails, taken alone) of every row.

    E asks for the smallest id of each text that occurs more than once: an aggregate that meets on the map side, and a join of
    ids and digests. A row without an id comes after all that have one; repeated rows of one id do not fail by each other.
    """
    facts = stored(text_facts(docs), "facts")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("digest", "first")
    conditions = {
        "A": F.col("n_words") < FEWEST_WORDS,
        "B": 100 * F.col("n_distinct") < DISTINCT_SHARE * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > CAPITAL_SHARE * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
        "E": F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))),
    }
    mask = sum((F.when(conditions[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    return facts.join(first, "digest", "left").select("doc_id", "part", mask.alias("mask"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, filter order (all 120) and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs``: doc_id, text, source; ``labels``: doc_id, quality, toxic (a document is good or toxic if any of its rows says so;
    rows without an id say nothing). Documents are first counted by (part, failure mask, labels), at most 32 cells a part, and
    every order and step is a sum over those cells. Null sources and empty ones are one part. Equal rows each count; other
    columns are ignored; an empty table has no parts and gives no rows.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    cells = (
        failure_masks(docs)
        .join(marks, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = lambda f: F.instr("filter_order", f)
    chosen = lambda test: sum((F.when(test(place(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumns({"own": chosen(lambda p: p == F.col("step")), "before": chosen(lambda p: p < F.col("step"))})
    fails = lambda m, name: m.bitwiseAND(F.col(name)) != 0

    def total(test, value=lambda c: c["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(test(c["mask"]), value(c)).otherwise(F.lit(0)))

    removed = lambda m: fails(m, "own") & ~fails(m, "before")
    firsts = F.array(*[F.lit(120 // n).cast("long") for n in range(1, len(FILTERS) + 1)])  # orders in which one of n failed filters comes first
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m, "own") & ~fails(m, "before")).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m, "own") & fails(m, "before")).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda m: fails(m, "own"), lambda c: c["n"] * F.get(firsts, F.bit_count(c["mask"]) - 1)).alias("shapley"),
    )
