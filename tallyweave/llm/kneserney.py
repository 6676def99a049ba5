"""Perplexity of documents under interpolated modified Kneser-Ney models of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

#: UTF-8 bytes in an n-gram; bits of a byte; the mark before a text, a byte that UTF-8 does not have.
ORDER, BITS, BEGIN = 6, 8, b"\xff"
#: Halves of the trusted text: each trains a model, and a document is scored by the model of the half that it is not in.
FOLDS = 2
#: n-grams of a model that is sent to the tasks (a larger one is joined); characters of texts that are joined together; rows
#: of labels that are sent rather than shuffled.
SENT_NGRAMS, SLICE_CHARACTERS, SENT_LABELS = 8_000_000, 32_000_000, 200_000
#: A text is rejected above this quantile of its language's trusted perplexities.
QUANTILE = 0.99


def _normal(text: str | None) -> bytes:
    return " ".join((text or "").split()).encode("utf-8", "surrogatepass")


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram code and text number of every byte; a text is preceded by ORDER - 1 begin marks."""
    lead = BEGIN * (ORDER - 1)
    ids = np.frombuffer(lead + lead.join(texts), np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    at = np.arange(len(owner)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    codes = np.zeros(len(at), np.int64)
    for k in range(ORDER - 1, -1, -1):
        codes = (codes << BITS) | ids[at - k]
    return codes, owner


def _mask(k: int) -> int:
    return (1 << BITS * k) - 1


def _parts(batch: pa.RecordBatch | pa.Table, rows: int = 200) -> Iterator[tuple[pa.RecordBatch | pa.Table, list[bytes]]]:
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, [_normal(t) for t in part.column("text").to_pylist()]


def fold_of(text: Column) -> Column:
    """The half that a text is in; equal texts are in one."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def ngram_counts(trusted: DataFrame) -> DataFrame:
    """fold, code, c: how often each n-gram of ORDER bytes occurs in each half of the trusted text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold in range(FOLDS):
                mine = batch.filter(pa.array(np.asarray(batch.column("fold")) == fold))
                found = [_codes(texts)[0] for _, texts in _parts(mine)]
                which, codes = pd.factorize(np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                columns = [pa.array(np.full(len(codes), fold, np.int32)), pa.array(codes, pa.int64()), pa.array(np.bincount(which, minlength=len(codes)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["fold", "code", "c"])

    counted = trusted.select(fold_of(F.col("text")).alias("fold"), "text").mapInArrow(count, "fold int, code long, c long")
    return counted.groupBy("fold", "code").agg(F.sum("c").alias("c"))


def _by_fold(values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for fold, value in values.items():
        out = F.when(F.col("fold") == fold, float(value)).otherwise(out)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What counts of 1, 2 and more give up, from how many n-grams have counts 1 to 4; fixed ones where one of those is none."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _cut(counts: DataFrame) -> Column:
    """The discount of each row's count ``c``, by fold."""
    n = counts.groupBy("fold").agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in range(1, 5)]).collect()
    found = {r["fold"]: discounts(*(r[f"n{i}"] for i in range(1, 5))) for r in n}
    d1, d2, d3 = (_by_fold({fold: d[i] for fold, d in found.items()}) for i in range(3))
    return F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)


def train(trusted: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(grams, contexts): for each order 1..ORDER the tables (fold, code, logp) and (fold, code, logg) of the halves' models.

    Full counts at the highest order, below it the number of different bytes before an n-gram; three discounts for each
    order and half from counts of counts; an n-gram's probability is its discounted share in its context plus the
    context's left-over weight times the probability of the n-gram one byte shorter. All of this is sums and equi-joins on
    n-gram codes, so the tables are sharded by code and grow with the text.
    """
    counts = {ORDER: stored(ngram_counts(trusted), "grams")}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = stored(counts[k + 1].groupBy("fold", F.col("code").bitwiseAND(_mask(k)).alias("code")).agg(F.count("*").alias("c")), "continued")
    grams, contexts, lower = [], [], None
    for k in range(1, ORDER + 1):
        with_context = counts[k].withColumns({"h": F.shiftright("code", BITS), "cut": _cut(counts[k])})
        weights = with_context.groupBy("fold", "h").agg(F.sum("c").alias("total"), F.sum("cut").alias("left")).select("fold", "h", "total", (F.col("left") / F.col("total")).alias("gamma"))
        weights = stored(weights, "contexts")
        p = with_context.join(weights, ["fold", "h"]).withColumn("own", (F.col("c") - F.col("cut")) / F.col("total"))
        if k == 1:
            p = p.select("fold", "code", (F.col("own") + F.col("gamma") / (1 << BITS)).alias("p"))
        else:
            shorter = lower.select("fold", F.col("code").alias("s"), F.col("p").alias("ps"))
            p = p.withColumn("s", F.col("code").bitwiseAND(_mask(k - 1))).join(shorter, ["fold", "s"]).select("fold", "code", (F.col("own") + F.col("gamma") * F.col("ps")).alias("p"))
        lower = stored(p, "probabilities")
        grams.append(lower.select("fold", "code", F.log("p").alias("logp")))
        contexts.append(weights.select("fold", F.col("h").alias("code"), F.log("gamma").alias("logg")))
    return grams, contexts


#: Log probability of a byte that no context knows, before the weights left over.
UNSEEN = -float(np.log(1 << BITS))


def _gathered(grams: list[DataFrame], contexts: list[DataFrame]) -> dict:
    """A small model's tables as sorted arrays, the fold above the code."""

    def table(df: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        found = df.select((F.col("fold").cast("long") * (1 << BITS * ORDER) + F.col("code")).alias("key"), F.col(value).alias("v")).toArrow()
        keys, values = found.column("key").to_numpy(), found.column("v").to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order]

    return {"grams": [table(g, "logp") for g in grams], "contexts": [table(c, "logg") for c in contexts]}


def _logp(codes: np.ndarray, fold: int, model: dict) -> np.ndarray:
    """Log probability of the last byte of each n-gram, from the longest n-gram the model knows."""
    out, todo, high = np.zeros(len(codes)), np.arange(len(codes)), fold << BITS * ORDER

    def found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = table
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return hit, np.where(hit, values[at], 0.0)

    for k in range(ORDER, 0, -1):
        now = codes[todo] & _mask(k)
        hit, value = found(model["grams"][k - 1], now | high)
        out[todo] += value
        todo, now = todo[~hit], now[~hit]
        out[todo] += found(model["contexts"][k - 1], (now >> BITS) | high)[1]
    out[todo] += UNSEEN
    return out


def _joined(texts: DataFrame, grams: list[DataFrame], contexts: list[DataFrame], slices: int) -> DataFrame:
    """row, doc_id, lang, n_chars, logp of each text, for models of any size.

    Texts are dealt to slices. A slice names each n-gram once, so a frequent one meets the model once a slice; every
    different n-gram is looked up by joins on n-gram, order by order, and what is found goes back to the slices.
    """
    dealt = texts.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))

    def names(part: pa.Table) -> pa.Table:
        folds, seen = np.asarray(part.column("fold")), {}
        for fold in range(FOLDS):
            found = [np.unique(_codes(t)[0]) for _, t in _parts(part.filter(pa.array(folds == fold)))]
            seen[fold] = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        n = sum(map(len, seen.values()))
        columns = [np.full(n, part.column("slice")[0].as_py()), np.repeat(list(seen), [len(x) for x in seen.values()]).astype(np.int32), np.concatenate(list(seen.values()))]
        return pa.table([pa.array(c) for c in columns], ["slice", "fold", "code"])

    wanted = stored(dealt.groupBy("slice").applyInArrow(names, "slice long, fold int, code long"), "wanted")
    looked = wanted.select("fold", "code").distinct().withColumns({"logp": F.lit(None).cast("double"), "left": F.lit(0.0)})
    for k in range(ORDER, 0, -1):
        gram = grams[k - 1].select("fold", F.col("code").alias("g"), F.col("logp").alias("own"))
        context = contexts[k - 1].select("fold", F.col("code").alias("h"), "logg")
        looked = looked.withColumns({"g": F.col("code").bitwiseAND(_mask(k)), "h": F.shiftright(F.col("code").bitwiseAND(_mask(k)), BITS)})
        looked = looked.join(gram, ["fold", "g"], "left").join(context, ["fold", "h"], "left")
        looked = looked.select("fold", "code", F.coalesce("logp", F.col("left") + F.col("own")).alias("logp"), (F.col("left") + F.coalesce("logg", F.lit(0.0))).alias("left"))
    looked = stored(looked.select("fold", "code", F.coalesce("logp", F.col("left") + UNSEEN).alias("logp")), "looked-up")
    scored = wanted.join(looked, ["fold", "code"])

    def add(part: pa.Table, found: pa.Table) -> pa.Table:
        folds, known = np.asarray(found.column("fold")), {}
        for fold in range(FOLDS):
            mine = found.filter(pa.array(folds == fold))
            codes = mine.column("code").to_numpy()
            order = np.argsort(codes)
            known[fold] = codes[order], mine.column("logp").to_numpy()[order]
        return pa.Table.from_batches(list(_sums(part.combine_chunks().to_batches(), lambda codes, fold: known[fold][1][np.searchsorted(known[fold][0], codes)])))

    schema = f"row long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang string, n_chars long, logp double"
    return dealt.groupBy("slice").cogroup(scored.groupBy("slice")).applyInArrow(add, schema)


_SUMS = ["row", "doc_id", "lang", "n_chars", "logp"]


def _sums(batches: Iterator[pa.RecordBatch], logp_of) -> Iterator[pa.RecordBatch]:
    """Characters and summed log probability of every text; ``logp_of(codes, fold)`` knows each n-gram."""
    for batch in batches:
        for part, texts in _parts(batch):
            total, fold = np.zeros(len(texts)), np.asarray(part.column("fold"))
            for f in np.unique(fold).tolist():
                mine = np.flatnonzero(fold == f)
                codes, owner = _codes([texts[i] for i in mine])
                which, distinct = pd.factorize(codes)
                if len(codes):
                    total[mine] = np.bincount(owner, logp_of(distinct, f)[which], len(mine))
            chars = [len(t) if t.isascii() else int((np.frombuffer(t, np.uint8) & 0xC0 != 0x80).sum()) for t in texts]
            columns = [part.column("row"), part.column("doc_id"), part.column("lang"), pa.array(chars, pa.int64()), pa.array(total, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, _SUMS)


def score_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, n_chars (characters scored) and perplexity (a character; null where there is none) of every row.

    A document is scored by the model of the half of ``trusted`` that its text would not be in, so no model judges a text
    it was trained on. Models of at most SENT_NGRAMS n-grams, as counted, are sent to the tasks whole, and one pass over
    the texts scores them without a shuffle; larger ones are joined (``_joined``). Both give the same perplexities, bit for bit:
    the same doubles are added in the same order.
    """
    grams, contexts = train(trusted)
    kind = docs.schema["doc_id"].dataType.simpleString()
    other = (F.lit(FOLDS - 1) - fold_of(F.col("text"))).alias("fold")
    texts = docs.select("doc_id", "lang", "text", other, F.monotonically_increasing_id().alias("row"))
    if sum(df.count() for df in (*grams, *contexts)) <= SENT_NGRAMS:
        model = docs.sparkSession.sparkContext.broadcast(_gathered(grams, contexts))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _sums(batches, lambda codes, fold: _logp(codes, fold, model.value))

        out = texts.mapInArrow(score, f"row long, doc_id {kind}, lang string, n_chars long, logp double")
    else:
        size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        out = _joined(stored(texts, "scored"), grams, contexts, max(1, size // SLICE_CHARACTERS))
    return out.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(-F.col("logp") / F.col("n_chars"))).alias("perplexity"))


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``; few enough ids are sent to the tasks, more are joined by shuffle."""
    few = ids.select("doc_id").limit(SENT_LABELS + 1).count() <= SENT_LABELS
    return docs.join(F.broadcast(ids.select("doc_id")) if few else ids.select("doc_id"), "doc_id", "left_semi")


def classify(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept for every row of ``docs``.

    The models are trained on the documents in ``trusted_ids`` (doc_id), half of them each; every document is scored by the
    model that has not seen its text. A language's ``quantile`` of all its trusted documents' perplexities is its threshold; a
    language without any takes that of all. Rows at or below the threshold are kept. Null and empty texts have no
    perplexity and are not kept; without trusted text every text is kept. Equal rows fare alike; other columns are
    ignored; no rows give none.
    """
    scored = stored(score_documents(docs, only(docs, trusted_ids)), "perplexities")
    good = only(scored, trusted_ids).where("perplexity is not null")
    q = lambda: F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_language = good.groupBy(F.col("lang").alias("__lang")).agg(q().alias("own"))  # one row a language
    for_all = good.agg(q().alias("t")).first()["t"]
    named = scored.join(by_language, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    limit = F.coalesce("own", F.lit(for_all).cast("double"))
    return named.select(
        "doc_id", "lang", "n_chars", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))), F.lit(False)).alias("kept")
    )
