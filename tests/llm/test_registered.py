"""The registered queries' columns, as returned, against brute-force versions of what they state; models in all their forms."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm import brute_fp, brute_groups, docs, none, odd, short  # noqa: F401

from tallyweave.llm import kneserney, sharding
from tallyweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(docs, odd, tmp_path_factory):  # noqa: F811
    """Documents of the given table and odd ones, in a folder of their own."""
    path = str(tmp_path_factory.mktemp("tables"))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1_000_000).select(*names)).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def rows(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def listed(spans):
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]


def secret_spans(text):
    """As the contract states them: base spans by start, then kind."""
    found = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end(), "assign")] if len(m[1]) >= 8 else []
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def test_op3_columns(spark, folder, rows):
    want = Counter()
    for r in rows:
        base = secret_spans(r["text"] or "")
        n = Counter(k for k, *_ in base)
        want[r["doc_id"], n["assign"], n["access"], n["hex"], digest(base)] += 1
    out = QUERIES["op3_secret_scan"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in out) == want
    for r in out:
        assert digest([x for x in listed(r["spans"]) if x[0] in ("assign", "access", "hex")]) == r["base_sha256"]
        assert [s for _, s, _ in listed(r["spans"])] == sorted(s for _, s, _ in listed(r["spans"]))


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def personal_spans(text):
    """As the contract states them: base spans by kind, then start."""
    numbers = lambda m: [int(c) for c in m[0] if c in "0123456789"]
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(numbers(m)) <= 19 and luhn(numbers(m))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(numbers(m)) <= 15]
    return found


def test_op5_columns(spark, folder, rows):
    kinds = ("email", "ip", "card", "phone")
    want = Counter()
    for r in rows:
        base = personal_spans(r["text"] or "")
        n = Counter(k for k, *_ in base)
        want[(r["doc_id"], *(n[k] for k in kinds), digest(base))] += 1
    out = QUERIES["op5_personal_data"](spark, folder).collect()
    assert Counter((r["doc_id"], *(r[f"n_{k}"] for k in kinds), r["base_sha256"]) for r in out) == want
    assert all(digest([x for x in listed(r["spans"]) if x[0] in kinds]) == r["base_sha256"] for r in out)


def test_op8_columns(spark, folder, rows):
    fps = [(r["doc_id"], brute_fp(r["text"], 4)) for r in rows]
    want = Counter()
    for (doc_id, fp, component), n in brute_groups(fps, 4).items():
        want[doc_id, f"{fp:016x}", component] += n
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash"](spark, folder).collect()) == want


def test_op9_columns(spark, folder, rows):
    out = QUERIES["op9_shards"](spark, folder).collect()
    text = lambda r: (r["text"] or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r["doc_id"], len(text(r)) + 8, zlib.crc32(text(r))) for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    assert set(by) <= set(range(24))
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 24) <= largest


def test_shards_replace_columns_of_their_names(odd, none):  # noqa: F811
    named = odd.withColumn("size", F.length("text")).withColumn("slot", F.lit("own"))
    out = sharding.balanced_shards(named, "size", 3)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "size", "shard", "slot"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in odd.collect())
    places = defaultdict(list)
    for r in out.collect():
        places[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in places.values())


def test_perplexities_are_the_same_bits(short, monkeypatch):  # noqa: F811
    """A model sent whole and a model joined give equal doubles, so no verdict hangs on the corpus's size."""
    trusted = short.where("doc_id < 40").select("doc_id")
    forms = []
    for sent in (10**7, 0):
        monkeypatch.setattr(kneserney, "SENT_NGRAMS", sent)
        monkeypatch.setattr(kneserney, "SLICE_CHARACTERS", 500)
        forms.append(Counter(tuple(r) for r in kneserney.classify(short, trusted, 0.8).collect()))
    assert forms[0] == forms[1]
