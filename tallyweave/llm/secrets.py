"""Secrets in texts: fixed patterns, and random strings told from identifiers by character Markov models.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let, sample_by_hash, stored

#: Pattern, the group whose length counts, its least length. Kinds in the order in which spans sort.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),  # a shorter run holds no longer one, so the length can stand in the pattern
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: What the model looks at: whole runs of these characters, at least 12, with a digit and a letter among them. The test for
#: both stands before the run, which is entered at its first character only, so a long run is read a fixed number of times.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{12,}"
#: Characters from '+' (43) to 'z' (122) index the model's square table.
LOW, WIDTH = 43, 80
#: Bound of the labelled documents that the models are fitted on.
TRAINING_DOCUMENTS = 2000


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of numbers, in about n * sqrt(n) steps."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)

    def with_step(v: Column) -> Column:
        n = F.size(v)
        return let(F.struct(v.alias("v"), F.greatest(F.lit(1), F.sqrt(n).cast("int")).alias("b")), blocks)

    def blocks(s: Column) -> Column:
        v, b = s["v"], s["b"]
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / b).cast("int")), lambda k: total(F.slice(v, k * b + 1, b)))
        return let(F.struct(v.alias("v"), b.alias("b"), sums.alias("s")), before)

    def before(s: Column) -> Column:
        starts = F.transform(s["s"], lambda x, k: total(F.slice(s["s"], F.lit(1), k)))
        return let(F.struct(s["v"].alias("v"), s["b"].alias("b"), starts.alias("p")), each)

    def each(s: Column) -> Column:
        v, b, p = s["v"], s["b"], s["p"]
        return F.transform(v, lambda x, i: F.get(p, F.floor(i / b).cast("int")) + total(F.slice(v, i - i % b + 1, i % b + 1)))

    return F.when(F.size(values) == 0, F.array().cast("array<long>")).otherwise(let(values.cast("array<long>"), with_step))


def spans_of(text: Column, pattern: str, group: int, least: int, kind: str, order: int) -> Column:
    """Spans [start, end) in characters of the pattern's leftmost matches whose group is long enough.

    Matches and the stretches between them alternate, so a running sum of their lengths gives every place.
    """
    p = F.lit(pattern)
    empty = F.array().cast("array<struct<start:long,kind_no:int,end:long,kind:string,value:string>>")

    def placed(m: Column) -> Column:
        lengths = F.transform(m, lambda x: F.length(x))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), F.concat(F.array(F.lit(0)), F.slice(lengths, F.lit(1), F.size(m) - 1)), lambda g, n: g + n)
        tested = m if not group else F.regexp_extract_all(text, p, F.lit(group))
        rows = F.arrays_zip(prefix_sums(steps).alias("at"), m.alias("value"), tested.alias("part"))
        return F.transform(
            F.filter(rows, lambda r: F.length(r["part"]) >= least),
            lambda r: F.struct(
                r["at"].alias("start"), F.lit(order).alias("kind_no"), (r["at"] + F.length(r["value"])).alias("end"), F.lit(kind).alias("kind"), r["part"].alias("value")
            ),
        )

    return let(F.regexp_extract_all(text, p, F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(placed(m)))


def base_spans(text: Column) -> Column:
    found = {k: spans_of(text, *v, k, i) for i, (k, v) in enumerate(KINDS.items())}
    found["access"] = F.when(F.contains(text, F.lit("AKIA")), found["access"]).otherwise(F.array().cast("array<struct<start:long,kind_no:int,end:long,kind:string,value:string>>"))
    return F.concat(*found.values())


def training_samples(docs: DataFrame, documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(value, label): 1 for random strings, 0 for ordinary identifiers, from at most ``documents`` documents.

    Random: values that the fixed patterns find, as they are, in capitals, and the same randomness spelt in base 64 and in
    hexadecimal, which the patterns may not know. Ordinary: the texts' own words, alone, numbered, and joined as
    identifiers are.
    """
    picked = sample_by_hash(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", documents, docs.count())
    digest = lambda v: F.unhex(F.sha2(v, 256))
    spelt = lambda v: F.array(v, F.upper(v), F.regexp_replace(F.base64(digest(v)), "=", ""), F.hex(digest(v)), F.lower(F.hex(digest(v))))
    shown = picked.select(F.transform(base_spans(F.col("text")), lambda s: s["value"]).alias("found"), F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("words"))
    after = F.concat(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 1, 1))
    joined = F.zip_with(F.arrays_zip(F.col("words").alias("a"), after.alias("b")), F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda w, i: F.concat(w["a"], F.when(i % 2 == 0, F.lit("_")).otherwise(F.lit("-")), w["b"], F.when(i % 3 == 0, i.cast("string")).otherwise(F.lit(""))))
    numbered = F.transform("words", lambda w, i: F.concat(w, (i * 7 % 100).cast("string")))
    ordinary = shown.where(F.size("words") > 0).select(F.explode(F.concat("words", joined, numbered)).alias("value"), F.lit(0).alias("label"))
    random = shown.select(F.explode("found").alias("v")).select(F.explode(spelt(F.col("v"))).alias("value"), F.lit(1).alias("label"))
    return random.unionByName(ordinary)


def held_out(value: Column) -> Column:
    """One sample in five, by hash: what the threshold is set on and the models have not seen."""
    return F.pmod(F.xxhash64(value, F.lit(7)), F.lit(5)) == 0


def train(samples: DataFrame) -> tuple[list[float], float]:
    """Log-likelihood ratios of character pairs (row * WIDTH + column) and the threshold on their mean.

    Pair counts of both classes are summed by Spark; at most WIDTH squared sums come to the driver. The threshold is where
    99.9% of the held-out ordinary samples of 12 and more characters stay below, and never under 0.
    """
    pairs = (
        samples.where((F.length("value") >= 2) & ~held_out(F.col("value")))
        .select("label", F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
        .where(F.col("pair").rlike("^[+-z]{2}$"))
        .groupBy("pair")
        .agg(F.sum("label").alias("random"), F.sum(1 - F.col("label")).alias("ordinary"))
        .collect()
    )
    row, seen = defaultdict(lambda: [0, 0]), {}
    for r in pairs:
        a, b = (ord(c) - LOW for c in r["pair"])
        seen[a, b] = (r["random"], r["ordinary"])
        row[a][0] += r["random"]
        row[a][1] += r["ordinary"]
    half = 0.5

    def ratio(a: int, b: int) -> float:
        n, total = seen.get((a, b), (0, 0)), row[a]
        return math.log((n[0] + half) / (total[0] + half * WIDTH)) - math.log((n[1] + half) / (total[1] + half * WIDTH))

    table = [ratio(a, b) for a in range(WIDTH) for b in range(WIDTH)]
    calm = samples.where((F.col("label") == 0) & (F.length("value") >= 12) & held_out(F.col("value")))
    high = calm.select(score(F.col("value"), table).alias("s")).agg(F.percentile_approx("s", F.lit(0.999)).alias("t")).first()["t"]
    return table, max(0.0, high or 0.0)


def score(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs, in one pass over its characters."""
    model = F.lit(table)

    def mean(x: Column) -> Column:
        c, m = x["c"], x["m"]
        pairs = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.coalesce(F.get(m, a * WIDTH + b), F.lit(0.0)))
        return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p) / (F.size(c) - 1)

    codes = F.transform(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) - LOW)
    return F.when(F.length(value) < 2, F.lit(0.0)).otherwise(let(F.struct(codes.alias("c"), model.alias("m")), mean))


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, kind_no, end, kind, value), by start, then kind.

    The fixed kinds are assign, access and hex; ``random`` is what the models add: a run of 12 or more
    characters with a letter and a digit, of a mean log-likelihood ratio above the calibrated threshold, where no
    fixed span overlaps. ``samples`` (value, label) train the models; by default ``training_samples(docs)``.

    A null or empty text has no spans; whole texts are read, however long; every row, equal ones too, is answered
    on its own; all columns of ``docs`` stay (one named secret_spans is replaced); no rows give none.
    """
    table, threshold = train(stored(samples if samples is not None else training_samples(docs, documents), "secret-samples"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.drop("secret_spans").withColumn("__base", base_spans(text))
    tried = spans_of(text, CANDIDATE, 0, 12, "random", len(KINDS))
    added = let(
        F.struct(tried.alias("t"), F.col("__base").alias("b")),
        lambda x: F.filter(
            x["t"], lambda s: ~F.exists(x["b"], lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])) & (score(s["value"], table) > threshold)
        ),
    )
    return base.withColumn("secret_spans", F.array_sort(F.concat("__base", added))).drop("__base")


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every stretch that spans cover replaced by ``mark``; without spans it is unchanged."""
    covered = F.aggregate(
        spans,
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] <= F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )

    def pieces(x: Column) -> Column:
        t, c = x["t"], x["c"]
        kept = F.transform(
            F.sequence(F.lit(0), F.size(c)),
            lambda i: let(
                F.coalesce(F.get(c, i - 1)["end"], F.lit(0)).cast("int"), lambda low: F.substring(t, low + 1, F.coalesce(F.get(c, i)["start"].cast("int"), F.length(t)) - low)
            ),
        )
        return F.array_join(kept, mark)

    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(text.alias("t"), covered.alias("c")), pieces))
