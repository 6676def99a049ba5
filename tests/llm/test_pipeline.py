"""The corpus pipeline: every stage keeps the columns of documents and does what it says."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tallyweave.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def results(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs)
    return out


def test_columns(results):
    for df in results[1:-1]:
        assert df.columns == results[0].columns


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_stages(results):
    docs, ruled, single, clean, mixed, packed = ([r.asDict() for r in df.collect()] for df in results)
    kept = {r["doc_id"] for r in docs if quality.first_failed(quality.TextStats(r["text"]), list(quality.RULES)) is None}
    assert {r["doc_id"] for r in ruled} == kept
    ids = {r["doc_id"] for r in single}
    sets = {r["doc_id"]: shingles(r["text"]) for r in ruled}
    alike = lambda a, b: len(a & b) / len(a | b)
    for d in kept - ids:  # something like what went is left, or went for the like of it
        assert any(alike(sets[d], sets[o]) >= 0.8 for o in kept if o != d)
    texts = Counter(r["text"] for r in single)
    assert max(texts.values()) == 1 and set(texts) == {r["text"] for r in ruled if r["doc_id"] in ids}
    assert [r["doc_id"] for r in sorted(clean, key=lambda r: r["doc_id"])] == sorted(ids)
    secret = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{8,})|AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}")
    before = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        assert not secret.search(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or secret.search(before[r["doc_id"]]) or "[SECRET]" in r["text"]
    assert Counter(r["doc_id"] for r in mixed).most_common(1)[0][1] <= 2
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == pytest.approx(1.5 * sum(len(WORD.findall(r["text"])) for r in clean), abs=50)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
    assert mixing.BLOCK > 0


def test_run(spark, sf_dir, results):
    assert p.run(spark, sf_dir).columns == results[-1].columns


def test_tied_ids(spark):
    words = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [
        (5, words("a"), "en", "s", 1), (5, words("b"), "en", "s", 1), (3, words("a"), "en", "s", 1),  # one of the texts of 5 is a copy of 3
        (7, words("c"), "en", "s", 1), (7, words("c"), "de", "s", 1), (7, words("d"), "en", "s", 1),
        (None, words("d"), "en", "s", 1), (None, words("e"), "en", "s", 1), (None, words("e"), "en", "s", 1), (None, words("f"), None, None, None),
    ]
    want = [rows[i] for i in (1, 2, 4, 5, 7, 9)]
    for parts in (1, 5):
        got = p.near_dedup(spark, spark.createDataFrame(rows, schema).repartition(parts), "").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


LONG = " ".join(f"word{i % 977} x{i}" for i in range(3000))
ODD = [
    (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "b", 4), (4, LONG, "en", "b", len(LONG)),
    (5, "one two three", "en", None, 13), (5, "one two three", "en", None, 13), (5, "a different text of the same id " * 9, "en", "a", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "th", "__start", "root", "node", "text_hash", "rejected_by", "secret_spans", "start", "size", "row", "first", "count", "piece", "label", "value", "bucket", "cells"]


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    single = [tuple(r) for r in p.near_dedup(spark, docs, "").collect()]
    assert sorted(single, key=repr) == sorted([ODD[1], ODD[4], ODD[5], ODD[7]], key=repr)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
    assert {r["doc_id"] for r in docs.collect()} == {4}


@pytest.mark.parametrize("name, stage", p.STAGES, ids=[n for n, _ in p.STAGES])
def test_each_stage_on_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(ODD, SCHEMA)
    plain = [tuple(r) for r in stage(spark, docs, "").collect()]
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    got = stage(spark, more, "")
    if name != p.STAGES[-1][0]:
        assert got.columns == more.columns
        assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(plain, key=repr)
        assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in got.collect())
    else:
        assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted((r[:5] for r in plain), key=repr)
    assert stage(spark, docs.limit(0), "").count() == 0
    ids = Counter(r[0] for r in plain)
    few, all_ids = {4: 1}, Counter(r[0] for r in ODD)
    if name == "quality rules":
        assert ids == few
    elif name == "secret scans":
        assert ids == all_ids and sorted(plain, key=repr) == sorted(ODD, key=repr)
    elif name == "mixing sources":
        assert set(ids) == {4, 5}
    elif name == "best-fit packing":
        assert {**ids, 4: 1} == {**all_ids, 4: 1} and ids[4] > 1
