"""URL verdicts: listed rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._gbt import BoostedTrees, entropy, threshold_at
from ._shared import sample_by_hash

#: Bound of the labelled URLs that the trees are fitted on; precision that a block must reach on held-out ones.
TRAINING_URLS, PRECISION, FOLDS = 20_000, 0.9, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = re.compile(r".*?://([^/?#]*)([^?#]*)", re.S)
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, "host/path") that fits; null where none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # longer ones override
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def lexical(url: str) -> list[float]:
    """Length, depth, digit ratio, entropy and parameter counts."""
    m = _URL.match(url)
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    query = url.partition("?")[2].partition("#")[0]
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), host.count("-"),
        entropy(url), entropy(host), query.count("="), len(query), float("#" in url), float(path.endswith("/")), float("%" in url), float(url.startswith("https")),
        max((len(x) for x in host.split(".")), default=0),
    ]


class SuffixRates:
    """Block rates of hosts' suffixes, counted by fold, so that a row's own label need not be in its rates."""

    def __init__(self, folds: int = 1):
        self.folds, self.counts = folds, {}

    def add(self, url: str, blocked: bool, fold: int = 0) -> None:
        for s in {"", *_suffixes_of(url)}:
            self.counts.setdefault(s, np.zeros((self.folds, 2)))[fold] += (blocked, 1)

    def of(self, url: str, left_out: tuple[int, ...] = ()) -> list[float]:
        """Rates of the last and the last two labels, without some folds; a suffix seen fewer than five times has the usual rate."""

        def sums(suffix: str) -> np.ndarray:
            return np.delete(self.counts[suffix], left_out, 0).sum(0) if suffix in self.counts else np.zeros(2)

        blocked, n = sums("")
        usual = blocked / n if n else 0.5
        return [(b + 5 * usual) / (m + 5) if m >= 5 else usual for b, m in map(sums, _suffixes_of(url))]


def _suffixes_of(url: str) -> tuple[str, str]:
    m = _URL.match(url)
    return suffixes(m[1].lower() if m else "")


def features(url: str, rates: SuffixRates, left_out: tuple[int, ...] = ()) -> list[float]:
    """The lexical features and the block rates of the host's suffixes."""
    return lexical(url) + rates.of(url, left_out)


def train(labelled: DataFrame, bound: int = TRAINING_URLS) -> tuple[BoostedTrees, SuffixRates]:
    """(trees, suffix rates) from ``labelled`` (url, blocked): at most ``bound`` of them, those of smallest hash.

    Rows fall in FOLDS folds by host, so that sites met in training do not vouch for themselves. The threshold is set on
    probabilities that trees fitted without a row's fold give it, and a row's suffix rates never count its own fold, nor
    in those trees the fold that they are tried on.
    """
    usable = labelled.where("url is not null").select("url", "blocked")
    rows = sample_by_hash(usable, "url", bound, usable.count()).collect()
    if not rows:
        return BoostedTrees(threshold=1.1), SuffixRates()
    urls, y = [r["url"] for r in rows], np.array([float(r["blocked"]) for r in rows])
    fold = np.array([zlib.crc32((m[1].lower() if (m := _URL.match(u)) else "").encode("utf-8", "surrogatepass")) % FOLDS for u in urls], int)
    rates = SuffixRates(FOLDS)
    for u, b, f in zip(urls, y, fold, strict=True):
        rates.add(u, bool(b), f)
    shape = np.array([lexical(u) for u in urls])
    at = lambda left_out: np.hstack([shape, np.array([rates.of(u, tuple({*left_out, int(f)})) for u, f in zip(urls, fold, strict=True)])])
    tried = np.zeros(len(urls))
    for k in range(FOLDS):
        mine = fold == k
        if mine.any() and not mine.all():
            x = at((k,))
            tried[mine] = BoostedTrees().fit(x[~mine], y[~mine]).probability(x[mine])
    trees = BoostedTrees().fit(at(()), y)
    trees.threshold = threshold_at(tried, y, PRECISION) if 0 < y.sum() < len(y) else 1.1
    return trees, rates


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row: the longest fitting rule's verdict, else the trees'.

    The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path goes on up to
    ``?``, ``#`` or the end. ``labelled`` (url, blocked) trains the trees; by default the URLs that rules decide
    do. Without labels of both kinds the trees allow. A null url or one without ``://`` has empty host and
    path, no rule, and is allowed. Equal rows are judged alike; columns besides page_id and url are ignored.
    """
    known = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = known.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = known.where("found is not null").select("url", (F.col("found.verdict") == "block").alias("blocked"))
    trees, rates = train(labelled)

    def probability(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            known = [u for u in urls if u and "://" in u]
            p = iter(trees.probability(np.array([features(u, rates) for u in known])) >= trees.threshold) if known and trees.threshold <= 1 else itertools.repeat(False)
            blocked = [bool(next(p)) if u and "://" in u else False for u in urls]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocked, pa.bool_())], [*batch.schema.names, "blocked"])

    flat = known.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("listed"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema) + ", blocked boolean"
    judged = flat.mapInArrow(probability, schema)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
