"""Collocations of 2 to 5 words: the longest windows are counted once, and ROLLUP sums them into every shorter phrase."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored
from ._words import LOWER, Spans, codes_of, flags, joined, mixed, sliced_bytes, spans_of, taken, text_bytes

#: Words of the longest phrase, bits of a mark table (fixed: what is sent to the tasks), seeds tried for word codes.
LONGEST, MARK_BITS, SEEDS = 5, 1 << 26, 8
#: What ends a piece, and what parts words within one.
PIECE_ENDS, BLANKS = flags(b".,;:!?\n\x0b\x0c\r"), flags(b" \t")


def _language_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def _sequence(texts: pa.Array) -> tuple[Spans, np.ndarray]:
    """The texts' words in lower case, and the number of the piece that each is in (no two texts share one)."""
    data, bounds = text_bytes(texts)
    data = LOWER[data]
    ends = PIECE_ENDS[data]
    words = spans_of(data, bounds, ~(ends | BLANKS[data]))
    return words, np.searchsorted(np.flatnonzero(ends), words.start) + words.owner


def _each_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column(0).dictionary_encode()
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, batch.column(1).filter(pa.array(langs.indices.to_numpy() == i))


def word_counts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """lang, word, code, c: how often each lower-case word occurs in each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_bytes(batches, 1):
            for lang, texts in _each_language(batch):
                words, _ = _sequence(texts)
                codes, at, c = np.unique(codes_of(words, seed), return_index=True, return_counts=True)
                columns = [pa.array([lang] * len(c), pa.string()), taken(words, at).cast(pa.large_string()).cast(pa.string()), pa.array(codes.view(np.int64)), pa.array(c, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "code", "c"])

    rows = _language_and_text(docs).mapInArrow(count, "lang string, word string, code long, c long")
    return rows.groupBy("lang", "word", "code").agg(F.sum("c").alias("c"))


def _told_apart(docs: DataFrame) -> tuple[DataFrame, int]:
    """The word counts, stored, and a seed under which no two words have one code."""
    for seed in range(SEEDS):
        words = stored(word_counts(docs, seed), "words")
        if not words.groupBy("code").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b").limit(1).count():
            return words, seed
    raise ValueError(f"two words have one code under each of {SEEDS} seeds")


def marks(codes: DataFrame) -> np.ndarray:
    """A table of MARK_BITS bits, those of the column ``code`` set: 8 MB, however many codes there are.

    Bits meet in words of 64 by an aggregate, so the driver gets at most MARK_BITS / 64 pairs of numbers.
    """
    bit = f"pmod(code, {MARK_BITS})"
    cells = codes.groupBy(F.expr(f"int(shiftright({bit}, 6))").alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({bit} & 63))")).alias("bits")).toArrow()
    out = np.zeros(MARK_BITS // 64, np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    return out


def _marked(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = (codes % np.uint64(64 * len(table))).astype(np.int64)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def _mapped(docs: DataFrame, work: Callable, schema: str) -> DataFrame:
    """The columns that ``work(lang, texts)`` makes of each slice's texts of one language."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced_bytes(batches, 1):
            for lang, texts in _each_language(batch):
                yield pa.RecordBatch.from_arrays(work(lang, texts), names)

    return _language_and_text(docs).mapInArrow(run, schema)


def _chained(words: Spans, pieces: np.ndarray, seed: int, lang: str, tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word codes, code of the phrase of len(tables) + 1 words from each word on, whether it may be frequent).

    tables[i] marks the frequent phrases of i + 1 words; a phrase may be frequent if both that it has of one word less are marked.
    """
    codes = codes_of(words, seed)
    salt = np.uint64(int.from_bytes(lang.encode("utf-8", "surrogatepass")[-8:], "little"))
    phrase, may = mixed(codes + salt), np.ones(len(codes), bool)
    for k, table in enumerate(tables, 1):
        marked = may & _marked(table, codes if k == 1 else phrase)
        longer, may = np.zeros_like(phrase), np.zeros_like(may)
        longer[:-k] = joined(phrase[:-k], codes[k:])
        may[:-1] = marked[:-1] & marked[1:] & (pieces[:-1] == pieces[1:])
        phrase = longer
    return codes, phrase, may


def longest_windows(docs: DataFrame, words: DataFrame, seed: int, min_count: int) -> DataFrame:
    """lang, w1 .. w5 (word codes, null beyond the window's end), c: the windows that begin at each word, counted.

    A window ends with its piece, with the fifth word, or where the next word would complete a pair or a triple that occurs fewer
    than ``min_count`` times: no phrase over such a one is a candidate or a part of one, so the counts of all that matter stay
    whole. Rare words, pairs and triples are known by mark tables; where one calls a rare phrase frequent, a window is just longer
    than it need be. Without them nearly every window is one of its own, and all of those would be shuffled.
    """
    context = docs.sparkSession.sparkContext
    tables = [context.broadcast(marks(words.where(F.col("c") >= min_count).select("code")))]

    def candidates(lang: str, texts: pa.Array) -> list[pa.Array]:
        _, phrase, may = _chained(*_sequence(texts), seed, lang, [t.value for t in sent])
        found, c = np.unique(phrase[may], return_counts=True)
        return [pa.array(found.view(np.int64)), pa.array(c, pa.int32())]

    for _ in ("pairs", "triples"):
        sent = list(tables)
        counts = _mapped(docs, candidates, "code long, c int").groupBy("code").agg(F.sum("c").alias("c"))
        tables.append(context.broadcast(marks(counts.where(F.col("c") >= min_count))))
    columns = [f"w{i}" for i in range(1, LONGEST + 1)]

    def windows(lang: str, texts: pa.Array) -> list[pa.Array]:
        words, pieces = _sequence(texts)
        codes, pair, may = _chained(words, pieces, seed, lang, [tables[0].value])
        linked = may & _marked(tables[1].value, pair)
        _, triple, may = _chained(words, pieces, seed, lang, [t.value for t in tables[:2]])
        threes = may & _marked(tables[2].value, triple)
        starts = np.flatnonzero(linked)
        lead, on = [pa.array(codes[starts].view(np.int64))], np.ones(len(starts), bool)
        for i in range(1, LONGEST):  # the i-th word after each start, while pairs and triples hold
            on = on & (linked[starts] if i == 1 else threes[np.minimum(starts + i - 2, len(codes) - 1)])
            lead.append(pa.array(codes[np.minimum(starts + i, len(codes) - 1)].view(np.int64), mask=~on))
        return [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(starts), np.int32))), *lead]

    return _mapped(docs, windows, f"lang string, {', '.join(f'{w} long' for w in columns)}").groupBy("lang", *columns).agg(F.count("*").alias("c"))


def phrase_counts(docs: DataFrame, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, words: array of codes, f) of every phrase of 1 to 5 words with f >= min_count, and the stored word counts."""
    words, seed = _told_apart(docs)
    columns = [f"w{i}" for i in range(1, LONGEST + 1)]
    windows = stored(longest_windows(docs, words, seed, min_count), "windows")
    level = F.grouping_id().alias("level")  # a bit for each column that is summed over, the last column lowest
    sums = windows.rollup("lang", *columns).agg(F.sum("c").alias("f"), level).where(F.col("f") >= min_count)
    # a prefix of k words; a window of fewer than k has a null there
    prefixes = sums.withColumn("k", F.lit(LONGEST) - F.bit_count("level")).where("k >= 2").select("lang", F.slice(F.array(*columns), F.lit(1), F.col("k")).alias("words"), "f")
    phrases = prefixes.where(F.element_at("words", -1).isNotNull())
    single = words.where(F.col("c") >= min_count).select("lang", F.array("code").alias("words"), F.col("c").alias("f"))
    return stored(phrases.unionByName(single), "phrases"), words


def collocations(docs: DataFrame, min_count: int = 100, share: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to 5 words.

    A candidate occurs ``min_count`` times or more; of its cuts in two the one with the lowest floor(1000 a n / (l r)) counts
    (decimals of 38 digits, so products past 64 bits are exact), the shortest first part on ties. A candidate inside a longer
    one that occurs in ``share`` per cent of its places goes. Ties of score and count go by the phrase's UTF-8 bytes.

    Null and empty texts have no words; a null language is 'und'; texts are read whole; equal rows each count; other columns
    are ignored; no rows give none. The windows that are counted hang on the text alone, a frequent phrase is one row for each
    task that has met it, and no step joins on anything but whole phrases.
    """
    phrases, words = phrase_counts(docs, min_count)
    total = words.groupBy("lang").agg(F.sum("c").alias("n"))  # one row a language
    found = phrases.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("j"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("j")), "right": F.slice("words", F.col("j") + 1, F.size("words"))})
    part = lambda name, f: phrases.select(F.col("lang").alias(f"{name}_lang"), F.col("words").alias(name), F.col("f").alias(f))
    for name, f in (("left", "l"), ("right", "r")):
        own = part(f"{name}_words", f)
        cuts = cuts.join(own, (F.col("lang") == F.col(f"{name}_words_lang")) & (F.col(name) == F.col(f"{name}_words"))).drop(f"{name}_words_lang", f"{name}_words")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    product: Column = F.lit(1000).cast("decimal(4,0)") * (F.col("a").cast("decimal(15,0)") * F.col("n").cast("decimal(17,0)"))
    cuts = cuts.join(total, "lang").withColumn("product", product).withColumn("parts", whole("l") * whole("r"))
    cuts = cuts.withColumn("score", F.expr("product div parts"))
    best = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "j", "a", "l", "r", "n")).alias("b")).select("lang", "words", "b.*")
    inner = [F.slice("words", i + 1, m) for m in range(2, LONGEST) for i in range(LONGEST - m + 1)]
    inside = found.where(F.size("words") > 2).select("lang", F.col("words").alias("longer"), F.col("a").alias("longer_a"), F.explode(F.array_distinct(F.array(*inner))).alias("words"))
    inside = inside.where((F.size("words") > 1) & (F.size("words") < F.size("longer"))).groupBy("lang", "words").agg(F.max("longer_a").alias("most"))
    kept = best.join(inside, ["lang", "words"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a"))).drop("most")
    spelt = words.where(F.col("c") >= min_count).select("lang", "code", "word")
    named = kept.select("*", F.posexplode("words").alias("at", "code")).join(spelt, ["lang", "code"])
    named = named.groupBy("lang", "words", "score", "a", "l", "r", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
