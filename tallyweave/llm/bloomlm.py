"""Language-model scores of texts from a log-frequency Bloom filter of word and word-pair counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._words import Spans, codes_of, counted_codes, joined, mixed, sliced_bytes, taken, words_of

#: One document in FOLDS is held out of training; what the base adds to each count.
FOLDS, ADDED = 10, 0.1
#: Bits of the filters for each training token (pairs) and each different token (words); bits of a segment; segments of a
#: shard, which is what is sent to the tasks at a time (128 MB); most segments of the words' filter, which is sent whole.
PAIR_BITS, WORD_BITS, SEGMENT_BITS, SHARD_SEGMENTS = 4, 16, 1 << 20, 1024
#: Bits that a count's first level and each further level take.
FIRST_PROBES, PROBES = 5, 2
#: Most frequent tokens whose exact counts are sent to the tasks; rarer ones meet theirs by a join.
HEAD = 1 << 18


def _levels(base: float = 1.5, most: float = 1e15) -> np.ndarray:
    """The smallest count of each level: 1, 2, 3, then about ``base`` times the one before."""
    found = [1]
    while found[-1] < most:
        found.append(max(found[-1] + 1, int(np.ceil(base ** len(found)))))
    return np.array(found, np.int64)


LEVELS = _levels()
#: What a count of each level is taken for (0: not in the filter): the middle of the level.
ESTIMATES = np.concatenate([[0.0], (LEVELS[:-1] + LEVELS[1:] - 1) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS, counts, "right")


def segment_of(codes: np.ndarray, segments: int) -> np.ndarray:
    return ((codes >> np.uint64(33)) % np.uint64(segments)).astype(np.int64)


def _bit(codes: np.ndarray, level: np.ndarray | int, probe: int) -> np.ndarray:
    """Place, within its segment, of one of the bits that (code, level) takes."""
    own = mixed(codes + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    step = (own >> np.uint64(32)) | np.uint64(1)
    return ((own + np.uint64(probe) * step) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


class LogFrequencyFilter(NamedTuple):
    """Bits of a run of segments: a code of count level n has (code, 1) to (code, n) set in its segment."""

    bits: np.ndarray  # 64 to a number
    first: int  # the segments held: [first, first + len(bits) * 64 / SEGMENT_BITS)
    segments: int  # of the whole filter

    def holds(self, codes: np.ndarray) -> np.ndarray:
        at = segment_of(codes, self.segments) - self.first
        return (at >= 0) & (at < len(self.bits) * 64 // SEGMENT_BITS)

    def levels(self, codes: np.ndarray) -> np.ndarray:
        """Level of each code's count, by probes until one misses; never too low. The codes' segments must be held."""
        base = (segment_of(codes, self.segments) - self.first) * SEGMENT_BITS
        out, todo, level = np.zeros(len(codes), np.int64), np.arange(len(codes)), 1
        while len(todo) and level < len(LEVELS):
            for probe in range(FIRST_PROBES if level == 1 else PROBES):
                at = base[todo] + _bit(codes[todo], level, probe)
                todo = todo[(self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
            out[todo] = level
            level += 1
        return out


def set_bits(bits: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> None:
    """Enter counts into one segment."""
    todo, levels, level = np.arange(len(codes)), level_of(counts), 1
    while len(todo):
        for probe in range(FIRST_PROBES if level == 1 else PROBES):
            at = _bit(codes[todo], level, probe)
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        level += 1
        todo = todo[levels[todo] >= level]


class Model(NamedTuple):
    words: DataFrame  # word (the end is the empty one), code, c
    tokens: int
    kinds: int
    seed: int
    word_filter: object  # broadcast LogFrequencyFilter
    head: object  # broadcast (sorted codes, counts)
    pairs: DataFrame  # segment, bits
    pair_segments: int
    weights: np.ndarray  # of the pair's share, by level of the context's count


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def _empty_span() -> Spans:
    return Spans(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))


def end_code(seed: int) -> np.uint64:
    """The end's code is that of the empty word, which no text has."""
    return codes_of(_empty_span(), seed)[0]


def begin_code(seed: int) -> np.uint64:
    return mixed(np.array([end_code(seed)]))[0]


def sequences(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token codes of all texts, an end after each; the code before each token; number of tokens of each text)."""
    words, _ = words_of(texts, lower=True)
    sizes = np.bincount(words.owner, minlength=len(texts)) + 1
    ends = np.cumsum(sizes)
    tokens = np.full(ends[-1] if len(ends) else 0, end_code(seed), np.uint64)
    tokens[np.arange(len(words.owner)) + words.owner] = codes_of(words, seed)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[ends - sizes] = begin_code(seed)
    return tokens, before, sizes


def token_counts(texts: DataFrame, seed: int) -> DataFrame:
    """word, code, c of every token of the column ``text``; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_bytes(batches, 0):
            words, _ = words_of(batch.column(0), lower=True)
            codes, at, c = counted_codes(codes_of(words, seed))
            spelt = pa.concat_arrays([taken(words, at), pa.array([b""], pa.large_binary())]).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([spelt, pa.array(np.append(codes, end_code(seed)).view(np.int64)), pa.array(np.append(c, batch.num_rows), pa.int64())], ["word", "code", "c"])

    return texts.select("text").mapInArrow(count, "word string, code long, c long").groupBy("word", "code").agg(F.sum("c").alias("c"))


def _dealt(rows: DataFrame, segments: int) -> DataFrame:
    """Whole segments to partitions, where the counts of a code are added up."""
    place = F.expr(f"int(shiftrightunsigned(code, 33) % {segments})")
    return rows.withColumn("segment", place).repartition("segment").groupBy("segment", "code").agg(F.sum("c").alias("c"), F.max("level").alias("level"))


def filter_segments(rows: DataFrame, segments: int) -> DataFrame:
    """Of counts (code, c, level of the context): the bits of each segment, and for each level (segment null) the sum and the number of the counts.

    One shuffle deals whole segments to tasks; a task's rows stream past while it keeps its segments' bits, so its memory hangs on
    the filter's size and not on how many counts there are.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        sums, kinds = np.zeros(len(LEVELS) + 1, np.int64), np.zeros(len(LEVELS) + 1, np.int64)
        for batch in batches:
            where, codes, c, level = (batch.column(i).to_numpy() for i in range(4))
            sums += np.bincount(level, c, len(sums)).astype(np.int64)
            kinds += np.bincount(level, minlength=len(kinds))
            order = np.argsort(where, kind="stable")
            edges = np.flatnonzero(np.diff(where[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, segment = order[a:b], int(where[order[a]])
                if segment not in bits:
                    bits[segment] = np.zeros(SEGMENT_BITS // 64, np.uint64)
                set_bits(bits[segment], codes[own].view(np.uint64), c[own])
        for segment, own in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([own.tobytes()]), *(pa.array([None], t) for t in (pa.int32(), pa.int64(), pa.int64()))], names)
        some = np.flatnonzero(kinds)
        none = [pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), pa.array(sums[some]), pa.array(kinds[some])], names)

    names = ["segment", "bits", "level", "c", "kinds"]
    return _dealt(rows, segments).select("segment", "code", "c", "level").mapInArrow(fill, "segment int, bits binary, level int, c long, kinds long")


def gathered(filled: DataFrame, first: int, count: int, segments: int) -> LogFrequencyFilter:
    """A run of at most SHARD_SEGMENTS segments, as a filter."""
    bits = np.zeros(count * SEGMENT_BITS // 64, np.uint64)
    found = filled.where(F.col("segment").between(first, first + count - 1)).select("segment", "bits").toArrow()
    each = SEGMENT_BITS // 64
    for segment, own in zip(found.column("segment").to_pylist(), found.column("bits"), strict=True):
        bits[(segment - first) * each : (segment - first + 1) * each] = np.frombuffer(own.as_buffer(), np.uint64)
    return LogFrequencyFilter(bits, first, segments)


def _distinct_codes(texts: DataFrame) -> tuple[DataFrame, int]:
    for seed in range(8):
        words = stored(token_counts(texts, seed), "tokens")
        if not words.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            return words, seed
    raise ValueError("two words have one code under each of 8 seeds")


def train(texts: DataFrame) -> Model:
    """The model of the column ``text`` (null: empty; each row one text).

    Words are counted exactly, told apart by 64-bit codes that are checked to be unique. Counts of words and of pairs (a word
    and the one before it, a begin mark before the first) go into two log-frequency filters. The words' filter takes WORD_BITS
    bits for each different word, SHARD_SEGMENTS segments at most, and is sent whole; past that size (67 million words) it
    grows denser, so more unknown words pass for rare ones. The pairs' filter takes PAIR_BITS bits a token, however many, in shards.
    A pair's share in its context weighs C / (C + T), with C pairs and T different pairs in contexts of that level of count.
    """
    spark = texts.sparkSession
    words, seed = _distinct_codes(texts)
    said = words.agg(F.sum("c").alias("tokens"), F.count("*").alias("kinds"), F.sum(F.when(F.col("word") == "", F.col("c"))).alias("texts")).first()
    tokens, kinds, n_texts = said["tokens"] or 0, said["kinds"], said["texts"] or 0
    segments = min(SHARD_SEGMENTS, max(1, -(-kinds * WORD_BITS // SEGMENT_BITS)))
    begin = int(begin_code(seed).view(np.int64))
    entries = words.select("code", "c").unionByName(spark.createDataFrame([(begin, n_texts)], "code long, c long").where("c > 0"))
    filled = filter_segments(entries.withColumn("level", F.lit(0)), segments)
    word_filter = spark.sparkContext.broadcast(gathered(filled, 0, segments, segments))
    top = words.orderBy(F.desc("c"), "code").limit(HEAD).select("code", "c").toArrow()
    codes, c = top.column("code").to_numpy().view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(codes)
    head = spark.sparkContext.broadcast((codes[order], c[order]))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_bytes(batches, 0):
            tokens, before, sizes = sequences(batch.column(0), seed)
            _, _, _, context = _levels(tokens, sizes, word_filter.value, seed)
            found, at, c = counted_codes(joined(before, tokens))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(c, pa.int32()), pa.array(context[at], pa.int32())], ["code", "c", "level"])

    pair_segments = max(1, -(-tokens * PAIR_BITS // SEGMENT_BITS))
    pairs = stored(filter_segments(texts.select("text").mapInArrow(count_pairs, "code long, c int, level int"), pair_segments), "pairs")
    weights = np.zeros(len(LEVELS) + 1)
    for r in pairs.where("segment is null").groupBy("level").agg(F.sum("c").alias("c"), F.sum("kinds").alias("t")).collect():  # a row a level
        weights[r["level"]] = r["c"] / (r["c"] + r["t"])
    return Model(words, tokens, kinds, seed, word_filter, head, pairs, pair_segments, weights)


def _levels(tokens: np.ndarray, sizes: np.ndarray, words: LogFrequencyFilter, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different tokens, which of them each token is, level of each token's count, level of the one before it)."""
    where, kinds = pd.factorize(tokens)
    own = words.levels(kinds)[where]
    context = np.empty_like(own)
    context[1:] = own[:-1]
    context[np.cumsum(sizes) - sizes] = words.levels(np.array([begin_code(seed)]))[0]
    return kinds, where, own, context


def _pair_scores(codes: np.ndarray, own: np.ndarray, context: np.ndarray, pairs: LogFrequencyFilter, weights: np.ndarray, total: float) -> np.ndarray:
    """log10 probability of each token after the one before it, from the pair's code and both levels; zero where the pair is another shard's."""
    mine = pairs.holds(codes)
    pair = ESTIMATES[pairs.levels(codes[mine])]
    own, context = own[mine], context[mine]
    share = np.minimum(1.0, pair / np.maximum(ESTIMATES[context], 1.0))
    weight = np.where(context > 0, weights[context], 0.0)
    out = np.zeros(len(mine))
    out[mine] = np.log10(weight * share + (1 - weight) * (ESTIMATES[own] + ADDED) / total)
    return out


_SCORED = "row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"


def _one_shard(rows: DataFrame, model: Model, first: int, count: int, kind: str) -> DataFrame:
    """What one shard of the pairs' filter adds to each row's score; the counts and the base come with each."""
    shard = rows.sparkSession.sparkContext.broadcast(gathered(model.pairs, first, count, model.pair_segments))
    word_filter, head, weights, seed = model.word_filter, model.head, model.weights, model.seed
    total = model.tokens + ADDED * (model.kinds + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = head.value
        for batch in sliced_bytes(batches, 3):
            tokens, before, sizes = sequences(batch.column(3), seed)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            kinds, where, own, context = _levels(tokens, sizes, word_filter.value, seed)
            logp = _pair_scores(joined(before, tokens), own, context, shard.value, weights, total)
            at = np.minimum(np.searchsorted(known, kinds), max(0, len(known) - 1))
            hit = known[at] == kinds if len(known) else np.zeros(len(kinds), bool)
            base = np.where(hit, np.log10((np.where(hit, counts[at] if len(known) else 0, 0) + ADDED) / total), 0.0)[where]
            rare = ~hit[where]
            per_text = lambda x: np.bincount(owner, x, len(sizes))
            offsets = np.concatenate([[0], np.cumsum(per_text(rare))]).astype(np.int32)
            columns = [*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(per_text(~rare).astype(np.int64)), pa.array(per_text(base)), pa.array(per_text(logp))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[rare].view(np.int64)))], names)

    names = [x.split()[0] for x in _SCORED.split(", ")]
    return rows.mapInArrow(score, _SCORED.format(kind=kind))


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows that ``is_held_out`` leaves (a null id counts as the empty text, so it is held out). Scores are
    sums of log10 over a text's lower-case words and one end. ``base_score`` needs exact counts: the HEAD most frequent
    tokens' are sent to the tasks, the others' come by a join on their codes. ``score`` comes from the filters; where the pairs'
    filter has several shards, each is sent in turn and adds the tokens whose pair it holds.

    Null and empty texts are their end alone; texts are read whole, a long one alone; equal rows fare alike; other columns are
    ignored; without training rows every token has probability 1 in the base and the model; no rows give none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    model = train(docs.where(~is_held_out(F.col("doc_id"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    if model.pair_segments > SHARD_SEGMENTS:
        rows = stored(rows, "texts")  # so that rows keep their numbers from shard to shard
    shards = range(0, model.pair_segments, SHARD_SEGMENTS)
    parts = [stored(_one_shard(rows, model, first, min(SHARD_SEGMENTS, model.pair_segments - first), kind), "scores") for first in shards]
    scored = parts[0]
    if parts[1:]:
        added = parts[0].select("row", "score")
        for part in parts[1:]:
            added = added.unionByName(part.select("row", "score"))
        scored = scored.drop("score").join(added.groupBy("row").agg(F.sum("score").alias("score")), "row")
    total = model.tokens + ADDED * (model.kinds + 1)
    rare = scored.select("row", F.explode("rare").alias("code")).groupBy("row", "code").agg(F.count("*").alias("n"))
    rare = rare.join(model.words.select("code", "c"), "code", "left")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + ADDED) / total)).alias("b"))
    out = scored.join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        "score",
    )
