"""Mixing sources to target weights, block by block."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, sliced, stored, word_count

#: Words in a block, blocks in an output shard, shards' worth of slots that one task draws, sources that are drawn for
#: together, and the number of sources that are sent to all tasks (more are joined).
BLOCK, SHARD_SLOTS, TASK_SHARDS, GROUP, SENT_SOURCES = 128, 4096, 64, 10_000, 10_000


def permuted(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a Feistel network on the next power of four, walked until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(zlib.crc32(f"{key}/{r}".encode()) | 1) for r in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in reversed(keys) if inverse else keys:
            seen = left if inverse else right
            mixed = (seen + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
            left, right = (right ^ (mixed & mask), left) if inverse else (right, left ^ (mixed & mask))
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        out = once(np.asarray(x, np.uint64))
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Share:
    """What the plan knows of one source: its blocks and the words and slots it gives."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_take: int
    key: int


def share(name: str | None, size: int, target: float, block: int, seed: int) -> Share:
    """Slots so that the source gives round(target) words: whole rounds over its blocks, then a cut last slot."""
    blocks, key, words = -(-size // block), zlib.crc32(f"{seed}/{name!r}".encode()), round(target)
    if not size or not words:
        return Share(name, size, target, blocks, 0, 0, key)
    rounds, rest = divmod(words, size)
    if not rest:
        rounds, rest = rounds - 1, size
    short = block * blocks - size
    at = int(permuted(np.array([blocks - 1]), blocks, key, inverse=True)[0]) if blocks > 1 else 0
    given = lambda n: n * block - short * (at < n)
    n = -(-rest // block)
    n += given(n) < rest
    return Share(name, size, target, blocks, rounds * blocks + n, rest - given(n - 1), key)


#: numpy draws hypergeometric numbers of totals below this.
_DRAWN_TOTAL = 10**9


def _log_gamma_step(x: float, d: float) -> float:
    """log gamma(x + d) - log gamma(x), without the cancellation of two large values."""
    if min(x, x + d) < 1e6:
        return math.lgamma(x + d) - math.lgamma(x)
    return (x - 0.5) * math.log1p(d / x) + d * math.log(x + d) - d + (1 / (x + d) - 1 / x) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` things drawn from ``good`` and ``bad`` ones are good, for totals of any size.

    Above numpy's range: binomial draws, accepted by the ratio of the two laws, which is largest where the draw has the
    share of the whole.
    """
    if good + bad < _DRAWN_TOTAL:
        return int(rng.hypergeometric(good, bad, take))
    if 2 * take > good + bad:  # what is left behind is drawn instead: fewer are refused
        return good - hypergeometric(rng, good, bad, good + bad - take)
    if not good or not bad or not take:
        return take if not bad else 0
    odds = math.log(good / bad)
    peak = min(good, max(take - bad, round(take * good / (good + bad))))

    def ratio(k: int) -> float:
        if k > good or take - k > bad:
            return -math.inf
        return -_log_gamma_step(good - peak + 1, peak - k) - _log_gamma_step(bad - take + peak + 1, k - peak) - (k - peak) * odds

    top = max(map(ratio, range(max(0, peak - 2), min(take, peak + 2) + 1)))
    while True:
        k = int(rng.binomial(take, good / (good + bad)))
        if math.log(1 - rng.random()) <= ratio(k) - top:
            return k


def drawn_counts(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """``take`` things drawn without replacement from ``counts`` of each kind: how many of each."""
    total = int(counts.sum())
    if not take:
        return np.zeros_like(counts)
    if total < _DRAWN_TOTAL:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out = np.zeros_like(counts)
    for i, n in enumerate(counts.tolist()):
        total -= n
        out[i] = hypergeometric(rng, n, total, take) if total else take
        take -= int(out[i])
        if not take:
            break
    return out


def shard_draws(groups: list[int], group: int, slots: np.ndarray, shards: int, per: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, slots of each group, sources, slots of each, slots of each in all shards before) for the shards [low, high).

    Sources are drawn for in groups: ``groups`` has the slots of every group, ``slots`` those of each source of ``group``.
    The draw is multinomial given its totals (multivariate hypergeometric), split shard range by shard range with a seed
    per range, groups first and then the sources of each group: every task finds its own shards' counts of its own group
    alone, and all of them add up to the plan. Sources without slots in a shard are left out.
    """

    def within(lo: int, hi: int, whole: np.ndarray, which: np.ndarray, counts: np.ndarray, before: np.ndarray):
        if hi <= low or high <= lo or not len(which):
            return
        if hi - lo == 1:
            yield lo, whole, which, counts, before
            return
        mid = (lo + hi) // 2
        left = drawn_counts(np.random.default_rng([seed, lo, hi]), whole, min((mid - lo) * per, int(whole.sum())))
        mine = drawn_counts(np.random.default_rng([seed, lo, hi, group + 1]), counts, int(left[group]))
        for a, b, g, c, f in ((lo, mid, left, mine, before), (mid, hi, whole - left, counts - mine, before + mine)):
            some = c > 0
            yield from within(a, b, g, which[some], c[some], f[some])

    some = slots > 0
    yield from within(0, shards, np.array(groups, np.int64), np.flatnonzero(some), slots[some], np.zeros(some.sum(), np.int64))


def _slots(groups: list[int], shards: int, per: int, block: int, seed: int):
    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_no", ignore_index=True)
        group, low, high = (int(rows[c].iloc[0]) for c in ("group", "low", "high"))
        slots, blocks = rows["slots"].to_numpy(), rows["blocks"].to_numpy()
        parts = [np.zeros((4, 0), np.int64)]
        for shard, whole, which, counts, before in shard_draws(groups, group, slots, shards, per, seed, low, high):
            n = int(counts.sum())
            k = np.arange(n) + np.repeat(before - (np.cumsum(counts) - counts), counts)
            place = permuted(int(whole[:group].sum()) + np.arange(n), int(whole.sum()), zlib.crc32(f"{seed}/shard {shard}".encode()))
            parts.append(np.stack([np.repeat(which, counts), k, np.full(n, shard), place]))
        at, k, shard, place = np.concatenate(parts, axis=1)
        order = np.argsort(at, kind="stable")
        at, k, shard, place = at[order], k[order], shard[order], place[order]
        mapped = k % blocks[at]
        used, first = np.unique(at, return_index=True)
        for i, lo, hi in zip(used, first, [*first[1:], len(at)], strict=True):
            if blocks[i] > 1:
                mapped[lo:hi] = permuted(mapped[lo:hi], int(blocks[i]), int(rows["key"][i]))
        take = np.where(k == slots[at] - 1, rows["last_take"].to_numpy()[at], block)
        return pd.DataFrame({"source_no": rows["source_no"].to_numpy()[at], "round": k // blocks[at], "block": mapped, "take": take, "shard": shard, "position": place})

    return draw


_SLOT = "source_no long, round long, block long, take long, shard long, position long"


def _running(rows: DataFrame, order: Column, value: str, total: str) -> DataFrame:
    """``rows`` with ``total``: the sum of ``value`` over the rows before in ``order``, from sums of range partitions."""
    placed = stored(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = placed.groupBy("__part").agg(F.sum(value).alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(starts, "__part").withColumn(total, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__part", "__at", "__start")


def _plan(totals: DataFrame, weights: tuple[float, ...], share_of_words: float, cap: float, block: int, per: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources: source_no, source, source_size, target; slots: source_no, round, block, take, shard, position).

    Sources stay a table, however many they are; the driver holds the slots of each GROUP of them, one number a group.
    """
    numbered = _running(totals.withColumn("one", F.lit(1).cast("long")), F.asc_nulls_last("source"), "one", "source_no").drop("one")
    sources = stored(numbered.withColumn("w", F.element_at(F.lit([float(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))), "numbered")
    every = sources.where("size > 0")
    total = share_of_words * (every.agg(F.sum("size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level at which sources stop only rises, so the loop ends
        over = F.col("w") * level > F.col("size") * cap
        r = every.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("size") * cap).otherwise(0.0)).alias("cut"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if r["n"] == full:
            break
        full, level = r["n"], (total - r["cut"]) / r["w"] if r["w"] else float("inf")
    target = F.when(F.col("size") == 0, 0.0).when(F.col("w") * level > F.col("size") * cap, F.col("size") * cap).otherwise(F.col("w") * level)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [share(n, int(size), t, block, seed) for n, size, t in zip(batch["source"], batch["size"], batch["target"], strict=True)]
            yield batch.assign(blocks=[f.blocks for f in found], slots=[f.slots for f in found], last_take=[f.last_take for f in found], key=[f.key for f in found])

    planned = sources.select("source_no", "source", "size", target.alias("target")).mapInPandas(shares, "source_no long, source string, size long, target double, blocks long, slots long, last_take long, key long")
    planned = stored(planned.withColumn("group", F.expr(f"source_no div {GROUP}")), "planned")
    names = planned.select("source_no", "source", F.col("size").alias("source_size"), "target")
    sums = stored(planned.groupBy("group").agg(F.sum("slots").alias("group_slots")), "groups")
    groups = [r["group_slots"] for r in sums.orderBy("group").collect()]
    shards, strips = max(1, -(-sum(groups) // per)), sum(max(1, -(-n // (TASK_SHARDS * per))) for n in groups)
    cut = planned.join(sums, "group").withColumn("strips", F.expr(f"least({shards}L, greatest(1L, (group_slots + {TASK_SHARDS * per - 1}) div {TASK_SHARDS * per}))"))
    cut = cut.select("group", "source_no", "blocks", "slots", "last_take", "key", "strips", F.explode(F.expr("sequence(0L, strips - 1)")).alias("strip"))
    cut = cut.withColumn("low", F.expr(f"strip * {shards}L div strips")).withColumn("high", F.expr(f"(strip + 1) * {shards}L div strips"))
    cut = cut.repartition(max(1, min(2 * strips, 10_000)), "group", "strip")  # few rows in, many out: not for the optimiser to join up
    return names, cut.groupBy("group", "strip").applyInPandas(_slots(groups, shards, per, block, seed), _SLOT)


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share_of_words: float = 1.5,
    cap: float = 2.0,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(documents, slots): what each source and document gives to a mix of ``share_of_words`` times all words.

    Sources in code point order, null last, weigh ``weights`` in turn; no target passes ``cap`` times its source.
    A source's documents, in hashed order, are one stream of words cut into blocks of ``block`` (the last is shorter).
    Output shards draw multinomial source counts, a source's slots map through a pseudorandom permutation of its
    blocks, and slots join blocks by index. ``documents``: doc_id, source, text_hash, size, start, source_size,
    target, one row each. ``slots``: shard, position, round, and the word range [low, high) of the document
    (source, start) that fills it, one row for each document in a block.

    Null or empty texts have size 0 and give nothing; a null source is a source; ties in doc_id are ordered by text; fully
    equal rows are rows of their own, counted as one until their words have places; no rows give no rows. Columns besides
    doc_id, text and source are ignored. One plan serves any number of sources.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    sized = stored(sized.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("doc_id", "text_hash")), "sizes")
    totals = stored(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")), "sources")
    rows, sources = sized.count(), totals.count()
    names, drawn = _plan(totals, weights, share_of_words, cap, block, shard_slots, seed)
    names = (F.broadcast(names) if sources <= SENT_SOURCES else names).withColumnRenamed("source", "__source")

    # Word offsets inside each source: totals of hashed buckets, then a running sum in each bucket.
    buckets = max(64, rows // 20_000)
    words = F.col("size") * F.col("copies")
    known = sized.join(names, sized["source"].eqNullSafe(names["__source"])).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = known.groupBy("source_no", "bucket").agg(F.sum(words).alias("words")).select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("h", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.join(bases, ["source_no", "bucket"]).withColumn("first", F.col("base") + F.sum(words).over(inside) - words)
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    documents = stored(
        each.select("doc_id", "source", "source_no", "text_hash", "size", (F.col("first") + F.col("copy") * F.col("size")).alias("start"), "source_size", "target"), "offsets"
    )

    pieces = (
        documents.where("size > 0")
        .select("doc_id", "source", "text_hash", "source_no", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
        .withColumn("first", F.greatest("start", F.col("block") * block))
        .withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("first"))
    )
    slots = (
        drawn.join(pieces.hint("merge"), ["source_no", "block"])  # the slots are as many as the blocks; Spark guesses fewer
        .withColumn("given", F.least(F.col("words"), F.col("take") - (F.col("first") - F.col("block") * block)))
        .where("given > 0")
        .select("shard", "position", "round", "doc_id", "source", "text_hash", "source_no", "start", (F.col("first") - F.col("start")).alias("low"), (F.col("first") - F.col("start") + F.col("given")).alias("high"))
    )
    return documents, slots


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, and what the mix takes of it.

    ``taken``: words, repeats counted; ``shards``: output shards that hold some of them; ``first_shard``: the first of
    these, null where none does.
    """
    documents, slots = mix_sources(docs, **options)
    # Dealt out by document once: both sums then need no other exchange.
    here = slots.repartition("source_no", "start").groupBy("source_no", "start", "shard").agg(F.sum(F.col("high") - F.col("low")).alias("words"))
    taken = here.groupBy("source_no", "start").agg(F.sum("words").alias("taken"), F.count("*").alias("shards"), F.min("shard").alias("first_shard"))
    # A (source, start) is one document where size > 0; documents without words share a start and give nothing.
    filled = documents.where("size > 0").join(taken, ["source_no", "start"], "left")
    return filled.unionByName(documents.where("size = 0"), allowMissingColumns=True).select(
        "doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("taken", "shards")], "first_shard"
    )


_WORD = re.compile(WORD)


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words in ``ranges`` (sorted, disjoint), with the white space between neighbours kept."""
    merged: list[list[int]] = []
    for low, high in ranges:
        if merged and merged[-1][1] == low:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    spans = [m.span() for m in _WORD.finditer(text)]
    if merged == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for each document and round the words taken, all columns else unchanged (n_chars is counted again).

    A document taken whole keeps its text as it was; one that the mix does not take is left out; one taken in two
    rounds gives two rows. Fully equal rows are taken one by one; a row is told by id, source and text. Rows lie in the
    order of the drawn shards: those whose first words are in one shard together, by the place of these words.
    """
    _, slots = mix_sources(docs, **options)
    key = ["doc_id", "source", "text_hash"]
    ranges = slots.groupBy(*key, "start").agg(F.collect_list(F.struct("round", "low", "high")).alias("__ranges"), F.min(F.struct("shard", "position")).alias("__first"))
    ranges = ranges.withColumnsRenamed({k: f"__{k}" for k in key}).drop("start")
    names = docs.columns
    whole = docs.withColumn("__hash", F.xxhash64("text"))
    own = ["doc_id", "source", "__hash"]
    if whole.groupBy(*own).count().where("count > 1").limit(1).count():
        others = [c for c in names if c not in own]
        whole = whole.groupBy(*own).agg(F.min(F.struct(*others)).alias("__row")).select(*own, *[F.col("__row")[c].alias(c) for c in others])
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__hash") == F.col("__text_hash"))
    joined = whole.join(ranges, same).select(*names, "__ranges", F.col("__first.shard").alias("__shard"), F.col("__first.position").alias("__position"))
    joined = joined.repartition("__shard").sortWithinPartitions("__shard", "__position")
    at, counted, lengths = names.index("text"), names.index("n_chars") if "n_chars" in names else None, docs.schema

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in sliced(batches):
            rows, texts = [], []
            for i, (text, slots_) in enumerate(zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)):
                by: dict[int, list[tuple[int, int]]] = {}
                for s in slots_:
                    by.setdefault(s["round"], []).append((s["low"], s["high"]))
                for _, r in sorted(by.items()):
                    rows.append(i)
                    texts.append(cut_words(text, sorted(r)))
            picked = batch.select(names).take(pa.array(rows, pa.int64()))
            columns = [c for c in picked.columns]
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array([len(t) for t in texts], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, lengths)
