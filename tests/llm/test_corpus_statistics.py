"""Filter audit, collocations and language-model scores against brute-force versions, on odd rows too."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, WORD, docs, none, odd, rows_of  # noqa: F401

from tallyweave.llm import _words, audit, bloomlm, collocations
from tallyweave.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", " ", "a", "a a", "A b\tc\x0bd\x0ce\rf\ng", "x" * 100 + " " + "x" * 99 + "y " + "x" * 100, "été été \U0001f600  z", "a\0b a a\0", None, "12345678 12345678 123456789 1234567", "end "]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (3, None, None), (4, 1, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# words


def test_spans_are_words():
    array = pa.array(TEXTS)
    for part in (array, array.slice(3), array.slice(2, 6), array.slice(8, 1), array.slice(0, 0)):
        words, bounds = _words.words_of(part)
        want = [(i, w) for i, t in enumerate(part.to_pylist()) for w in WORD.findall(t or "")]
        got = _words.taken(words, np.arange(len(words.start))).to_pylist()
        assert list(zip(words.owner.tolist(), got, strict=True)) == [(i, w.encode()) for i, w in want]
        codes = _words.codes_of(words).tolist()
        assert len({c for c in codes}) == len({w for _, w in want}) == len({(c, w) for c, (_, w) in zip(codes, want, strict=True)})
        new = _words.first_of_kind(words)
        assert Counter(words.owner[new].tolist()) == Counter({i: n for i, n in Counter(i for i, _ in set(want)).items()})


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(_words, "codes_of", lambda words, seed=0: np.zeros(len(words.start), np.uint64))
    words, _ = _words.words_of(pa.array(["abcdefgh1 abcdefgh2 abcdefgh1 b ab b", "b"]))
    assert _words.first_of_kind(words).sum() == 5


def test_slices_keep_all(monkeypatch):
    monkeypatch.setattr(_words, "SLICE_BYTES", 5)
    batch = pa.record_batch([pa.array(TEXTS)], ["t"])
    got = [t for b in _words.sliced_bytes(iter([batch]), 0) for t in b.column(0).to_pylist()]
    assert got == TEXTS


# 11 filter audit


def failed(row, smallest):
    t = row["text"] or ""
    w = WORD.findall(t)
    out = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
    first = smallest.get(t)
    return {f for f, x in out.items() if x} | ({"E"} if first is not None and (row["doc_id"] is None or row["doc_id"] > first) else set())


def brute_audit(rows, labels):
    smallest, good, toxic = {}, set(), set()
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            smallest[t] = min(r["doc_id"], smallest.get(t, r["doc_id"]))
    for r in labels:
        if r["doc_id"] is not None:
            good |= {r["doc_id"]} if r["quality"] == 1 else set()
            toxic |= {r["doc_id"]} if r["toxic"] == 1 else set()
    parts = defaultdict(list)
    for r in rows:
        parts[r["source"] or ""].append((r["doc_id"], failed(r, smallest)))
    out, shapley = {}, Counter()
    for part, members in parts.items():
        for order in permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                here = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                all_failing = sum(f in m[1] for m in members)
                out[part, "".join(order), step] = (len(left), len(here), all_failing - len(here), sum(m[1] == {f} for m in members), sum(m[0] in good for m in here), sum(m[0] in toxic for m in here))
                shapley[part, f] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in df.collect()}


def test_filter_audit(spark, sf_dir, docs, odd, none, labels):  # noqa: F811
    own = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert audited(QUERIES["op11_filter_audit"](spark, sf_dir)) == brute_audit(docs.collect(), own.collect())
    more = odd.unionByName(spark.createDataFrame([(7, "one two three", "en", "", 1, 1, "x"), (None, "one two three", "en", "", 1, 1, "x"), (8, "A%" * 500, "en", "", 1, 1, "x")], SCHEMA))
    assert audited(audit.interactions(more, labels)) == brute_audit(more.collect(), labels.collect())
    clash = more.withColumns({c: F.lit(1) for c in ("part", "digest", "mask", "first", "rows", "cells", "quality", "toxic", "good", "n", "step")})
    assert audited(audit.interactions(clash, labels.withColumn("text", F.lit("x")))) == audited(audit.interactions(more, labels))
    assert audit.interactions(none, labels).count() == 0
    assert {v[4:6] for v in audited(audit.interactions(more, labels.limit(0))).values()} == {(0, 0)}


def test_audit_joins_no_copies(odd, labels):  # noqa: F811
    plan = audit.interactions(odd, labels)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# 12 collocations


def brute_collocations(rows, min_count, share, top):
    f, n = Counter(), Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r["text"] or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    covered = Counter()
    for (lang, p), a in often.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                covered[lang, p[i : i + m]] = max(covered[lang, p[i : i + m]], a)
    for (lang, p), a in often.items():
        cuts = []
        for k in range(1, len(p)):
            le, ri = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * n[lang] // (le * ri), k, le, ri))
        if 100 * covered[lang, p] < share * a:
            score, _, le, ri = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), le, ri, n[lang]))
    return sorted((lang, i, p.decode(), -a, le, ri, n, -s) for lang, found in out.items() for i, (s, a, p, le, ri, n) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("min_count, share, top", [(100, 100, 2000), (3, 100, 50), (2, 60, 2000)])
def test_collocations(docs, odd, min_count, share, top):  # noqa: F811
    short = docs.where("length(text) < 3000") if min_count < 100 else docs
    assert rows_of(collocations.collocations(short, min_count, share, top)) == sorted(brute_collocations(short.collect(), min_count, share, top), key=repr)


def test_collocations_of_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(1, "New York, new YORK; new york city\tnew york\x0bcity Zé zé ZÉ", None), (2, "new york " * 4, "und"), (3, None, "en"), (4, "a a a a a a a a", "en"), (5, ".,;:!?\n", "fr"), (6, " x  x y\0z y\0z", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for min_count in (1, 2, 3):
        assert rows_of(collocations.collocations(df, min_count)) == sorted(brute_collocations(rows_dict(rows), min_count, 100, 2000), key=repr)
    clash = df.withColumns({c: F.lit(7) for c in ("word", "words", "code", "c", "f", "n", "w1", "score", "rank")})
    assert rows_of(collocations.collocations(clash, 2)) == rows_of(collocations.collocations(df, 2))
    assert rows_of(collocations.collocations(odd, 50)) == sorted(brute_collocations(odd.collect(), 50, 100, 2000), key=repr)
    assert collocations.collocations(none).count() == 0


def rows_dict(rows):
    return [{"text": t, "lang": lang} for _, t, lang in rows]


def test_mark_tables_only_lengthen(monkeypatch, docs):  # noqa: F811
    """Tables so small that they mark almost everything change no result."""
    short = docs.where("doc_id < 60")
    want = rows_of(collocations.collocations(short, 5))
    monkeypatch.setattr(collocations, "MARK_BITS", 64)
    assert rows_of(collocations.collocations(short, 5)) == want and want


def test_scores_past_64_bits(spark):
    """The score's product passes 64 bits and 128-bit doubles' exactness."""
    out = spark.sql("select cast(1000 as decimal(4,0)) * (cast(987654321012345 as decimal(15,0)) * cast(98765432101234567 as decimal(17,0))) div (cast(9876543210123456789 as decimal(19,0)) * cast(3 as decimal(19,0))) as x").first()["x"]
    assert out == 1000 * 987654321012345 * 98765432101234567 // (9876543210123456789 * 3)


# 13 language-model scores


def brute_base(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), ""]
    c = Counter(w for r in rows if not held(r["doc_id"]) for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    score = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
    return sorted(((r["doc_id"], held(r["doc_id"]), len(tokens(r["text"])), sum(c[w] > 0 for w in tokens(r["text"])), n, round(score(r["text"]), 6)) for r in rows), key=repr)


def base_of(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("head", [1 << 18, 50])
def test_lm_base(spark, sf_dir, docs, odd, none, monkeypatch, head):  # noqa: F811
    monkeypatch.setattr(bloomlm, "HEAD", head)
    out = QUERIES["op13_lm_score"](spark, sf_dir)
    assert base_of(out) == brute_base(docs.collect())
    assert base_of(bloomlm.score_texts(odd.withColumns({"row": F.lit(1), "code": F.lit(1), "held_out": F.lit("x"), "score": F.lit(1)}))) == brute_base(odd.collect())
    assert bloomlm.score_texts(none).count() == 0
    alone = bloomlm.score_texts(docs.where(bloomlm.is_held_out(F.col("doc_id")))).collect()
    assert alone and all(r["train_tokens"] == 0 and r["score"] == 0 and r["base_score"] == 0 for r in alone)


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, 40_000).astype(np.uint64)
    counts = (rng.pareto(1.0, len(codes)) + 1).astype(np.int64)
    segments = 2
    bits = np.zeros((segments, bloomlm.SEGMENT_BITS // 64), np.uint64)
    for s in range(segments):
        mine = bloomlm.segment_of(codes, segments) == s
        bloomlm.set_bits(bits[s], codes[mine], counts[mine])
    found = bloomlm.LogFrequencyFilter(bits.ravel(), 0, segments)
    got, want = found.levels(codes), bloomlm.level_of(counts)
    assert (got >= want).all() and (got == want).mean() > 0.9
    assert (found.levels(rng.integers(0, 1 << 63, 40_000).astype(np.uint64)) > 0).mean() < 0.02
    assert (np.abs(bloomlm.ESTIMATES[want] / counts - 1) < 0.3).all() and bloomlm.ESTIMATES[:4].tolist() == [0, 1, 2, 3]


def exact_scores(rows):
    """The model with exact counts, quantised but in no filter."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), ""]
    train = [tokens(r["text"]) for r in rows if not held(r["doc_id"])]
    c = Counter(w for t in train for w in t)
    before = Counter(w for t in train for w in t) + Counter({None: len(train)})
    pairs = Counter(p for t in train for p in zip([None, *t], t, strict=False))
    level = lambda n: int(bloomlm.level_of(np.array([n]))[0])
    mean = lambda n: bloomlm.ESTIMATES[level(n)]
    sums, kinds = Counter(), Counter()
    for (h, _), n in pairs.items():
        sums[level(before[h])] += n
        kinds[level(before[h])] += 1
    n, v = sum(c.values()), len(c)

    def score(t):
        out = 0.0
        for h, w in zip([None, *tokens(t)], tokens(t), strict=False):
            lam = sums[level(before[h])] / (sums[level(before[h])] + kinds[level(before[h])]) if before[h] else 0.0
            share = min(1.0, mean(pairs[h, w]) / max(1.0, mean(before[h])))
            out += math.log10(lam * share + (1 - lam) * (mean(c[w]) + 0.1) / (n + 0.1 * (v + 1)))
        return out

    return {r["doc_id"]: score(r["text"]) for r in rows}


def test_lm_scores(spark, docs, monkeypatch):  # noqa: F811
    rows = docs.collect()
    want = exact_scores(rows)
    got = {r["doc_id"]: r for r in bloomlm.score_texts(docs).collect()}
    off = [abs(got[i]["score"] - s) / got[i]["n_tokens"] for i, s in want.items()]
    assert np.mean(off) < 0.02 and max(off) < 0.3  # what false hits of the filter do
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the pairs help on texts never seen
    monkeypatch.setattr(bloomlm, "PAIR_BITS", 64)
    monkeypatch.setattr(bloomlm, "SHARD_SEGMENTS", 2)
    sharded = {r["doc_id"]: r["score"] for r in bloomlm.score_texts(docs).collect()}
    monkeypatch.setattr(bloomlm, "SHARD_SEGMENTS", 1024)
    whole = {r["doc_id"]: r["score"] for r in bloomlm.score_texts(docs).collect()}
    assert all(abs(whole[i] - sharded[i]) < 1e-6 + 1e-3 * abs(whole[i]) for i in whole)
