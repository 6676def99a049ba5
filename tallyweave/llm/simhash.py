"""Near-duplicates by SimHash, searched with generalised pigeonhole partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import sliced, stored
from .components import connected_components

BITS = 64
#: Fingerprints that bit correlations and candidate counts are estimated on; rows of a bucket before it is split.
SAMPLE, BUCKET_ROWS = 2048, 1024
#: Texts and shingles of a group that one task compares; texts of a larger group that all its texts are compared with first.
CELL_ROWS, CELL_SHINGLES, CENTRES = 2048, 2_000_000, 8
#: Bits within which fingerprints of sets of shingles make texts candidates, by generalised pigeonhole partitions.
CANDIDATE_BITS = 7
#: MinHash values in a band, and the share of pairs right at the wanted similarity that may have no band in common.
BAND_VALUES, MISSED = 4, 1e-6
#: Cost of writing a probe and of comparing a pair, in like units, for choosing partitions.
PROBE_COST, PAIR_COST = 1.0, 0.004


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> list[int]:
    """XXH64 of every run of ``shingle`` words (A-Z lower-cased, one space between); fewer words: of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 32_768):
        part = np.array(hashes[at : at + 32_768], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp (64 bits, as a signed long): one row for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            prints = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _signed(prints)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(make, f"doc_id {kind}, fp long")


@dataclass(frozen=True)
class Partitions:
    """Bit positions of each partition and how many of its bits a probe may change (-1: not probed)."""

    bits: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _grouped(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """64 bits in ``m`` groups of like width; each takes the bits that go best with those it has."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    bits -= bits.mean(0) if len(bits) else 0
    norm = np.sqrt((bits**2).sum(0)) + 1e-9
    tied = np.abs(bits.T @ bits) / norm[:, None] / norm[None, :] if len(sample) else np.zeros((BITS, BITS))
    left, groups = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(left, key=lambda b: (tied[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (tied[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(tuple(sorted(group)))
    return groups


def _key(values: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for j, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def plan_partitions(sample: np.ndarray, n: int, max_bits: int) -> Partitions:
    """Partitions and thresholds of least estimated cost that miss no pair within ``max_bits``.

    If every partition differed in more bits than its threshold, a pair would differ in sum(threshold + 1) bits or
    more; so the thresholds add up to max_bits - m + 1. Dynamic programming deals that sum out over the partitions,
    at n * probes + n * n * share of sampled pairs within the threshold.
    """
    best: tuple[float, Partitions] | None = None
    some = sample[:1024]
    for m in range(2, min(max_bits + 1, 10) + 1):
        groups = _grouped(sample, m)
        costs = []
        for g in groups:
            k = _key(some, g)
            apart = np.bincount(np.bitwise_count(k[:, None] ^ k[None, :]).ravel(), minlength=len(g) + 1).astype(float)
            apart[0] = max(0.0, apart[0] - len(some))
            near = np.cumsum(apart) / max(1, len(some) * (len(some) - 1))
            volume = np.cumsum([math.comb(len(g), d) for d in range(len(g) + 1)])
            floor = volume / 2.0 ** len(g)
            costs.append([0.0, *(PROBE_COST * n * volume[t] + PAIR_COST * n * n * max(near[t], floor[t]) for t in range(min(3, len(g)) + 1))])
        goal = max_bits - m + 1 + m  # thresholds counted from -1
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (c, chosen) in table.items():
                for t, x in enumerate(cost):
                    if total + t <= goal and (total + t not in step or step[total + t][0] > c + x):
                        step[total + t] = (c + x, (*chosen, t - 1))
            table = step
        if goal in table and (best is None or table[goal][0] < best[0]):
            best = (table[goal][0], Partitions(tuple(groups), table[goal][1]))
    assert best is not None
    return best[1]


def _masks(width: int, most: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for d in range(most + 1) for c in combinations(range(width), d)], np.uint64)


_PROBE = ["bucket", "node", "own"]
_PROBE_SCHEMA = "bucket long, node long, own boolean"


def _probes(plan: Partitions):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 2000):
                fps = every[at : at + 2000]
                for i, (bits, most) in enumerate(zip(plan.bits, plan.thresholds, strict=True)):
                    if most >= 0:
                        masks = _masks(len(bits), most)
                        keys = _key(fps, bits)[:, None] ^ masks[None, :]
                        own = np.zeros(keys.shape, bool)
                        own[:, 0] = True
                        bucket = (keys | np.uint64(i << 40)).ravel().view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.repeat(fps, len(masks)).view(np.int64)), pa.array(own.ravel())], _PROBE)

    return emit


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component, for links a-b among 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b as stars: each node with the smallest one of its component."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = _roots(place[: len(a)], place[len(a) :], len(nodes))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _near(index: list[np.ndarray], probes: list[np.ndarray], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars of the links between rows (node, words of bits) of ``probes`` and of ``index`` within ``most`` bits."""
    tile = max(1, 2_000_000 // max(1, len(index[0])))
    for at in range(0, len(probes[0]), tile):
        node, *words = (x[at : at + tile] for x in probes)
        apart = reduce(np.add, (np.bitwise_count(p[:, None] ^ i[None, :]) for p, i in zip(words, index[1:], strict=True)))
        r, j = np.nonzero(apart <= most)
        a, b = node[r], index[0][j]
        if (other := a != b).any():
            yield _star(a[other], b[other])


def _bucket_links(words: list[str], most: int):
    """Links within ``most`` bits in each (bucket, salt): of index rows with each other, and of probes with index rows.

    Index rows come first and are held; probes stream past them, so memory hangs on the index rows of one cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in _then_none(batches):
            if batch is not None:
                part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "salt", "probe", "node", *words)]
                part = [*part[:4], *(x.view(np.uint64) for x in part[4:])]
                held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if held is None or not len(held[0]):
                continue
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            cuts = np.concatenate(([0], new, [len(held[0])]))
            found, kept = [], None
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                size = e - s - int(held[2][s:e].sum())  # of the index
                last = batch is not None and e == len(held[0])
                if last and (size == e - s or e - s < 65_536):  # it may go on
                    kept = [x[s:] for x in held]
                    break
                if size and e - s > 1:
                    found += _near([x[s : s + size] for x in held[3:]], [x[s:e] for x in held[3:]], most)
                if last:
                    kept = [x[s : s + size] for x in held]  # the index, for the probes to come
            held = kept
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fps`` (fp) whose components are those of all pairs within ``max_bits``.

    A bucket of over BUCKET_ROWS fingerprints is a grid: each of its own rows is held in one cell and probes the others, and
    the other probes go to every cell. So a task holds about BUCKET_ROWS rows of a bucket at a time, and no pair is lost.
    Fewer than two fingerprints give no link.
    """
    n = fps.count()
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()], np.int64).view(np.uint64)
    plan = plan_partitions(sample, n, max_bits)
    rows = fps.select("fp").mapInArrow(_probes(plan), _PROBE_SCHEMA)
    exact = Partitions(plan.bits, tuple(min(t, 0) for t in plan.thresholds))
    large = fps.select("fp").mapInArrow(_probes(exact), _PROBE_SCHEMA).groupBy("bucket").count().where(F.col("count") > BUCKET_ROWS)
    large = stored(large.select("bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("cells")), "large-buckets")
    if large.limit(1).count():
        cells = F.coalesce("cells", F.lit(1))
        rows = rows.join(large, "bucket", "left").select("bucket", "node", "own", F.pmod(F.xxhash64("node"), cells).alias("home"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("salt"))
        rows = rows.select("bucket", "salt", (~F.col("own") | (F.col("home") != F.col("salt"))).alias("probe"), "node")
    else:
        rows = rows.select("bucket", F.lit(0).alias("salt"), (~F.col("own")).alias("probe"), "node")
    together = rows.withColumn("fp", F.col("node")).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "probe")
    return _in_order(together.mapInArrow(_bucket_links(["fp"], max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 4, similarity: float | None = None) -> DataFrame:
    """doc_id, fp, component_id for every row: rows whose fingerprints differ in ``max_bits`` bits or fewer are linked,
    and component_id is the smallest doc_id that links reach.

    With ``similarity`` links are those of ``text_groups`` instead, whatever the bits: rows whose whole texts reach that
    Jaccard similarity of word shingles; fp is then the fingerprint of distinct shingles, and texts of equal sets of
    shingles are one class.

    Equal fingerprints are one class before any search without ``similarity``. Null and empty texts have fingerprint 0 and link like any
    other; null ids never are a component's id unless all are null; equal rows are in one component; columns besides
    doc_id and text are ignored; no rows give none. Nothing but a bounded sample of fingerprints reaches the driver.
    """
    if similarity is not None:
        groups = stored(text_groups(docs, shingle, similarity), "groups")
        lowest = stored(groups.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
        return groups.join(lowest, "root").select("doc_id", "fp", "component_id")
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    links = near_links(classes.select("fp"), max_bits)
    roots = stored(connected_components(links), "roots")
    known = roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "first")
    lowest = known.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = known.join(lowest, "root").select(F.col("node").alias("fp"), "component_id")
    named = stored(classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    # Both sides come straight from tables, so a fingerprint that very many rows share is a skewed join that Spark splits.
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def band_count(similarity: float) -> int:
    """Bands that texts of this similarity share none of once in 1 / MISSED pairs."""
    return math.ceil(math.log(MISSED) / math.log(1 - similarity**BAND_VALUES)) if similarity < 1 else 1


def far_bits(similarity: float) -> int:
    """Of 128 fingerprint bits, those that texts of this similarity may differ in: five standard deviations over the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(2 * BITS * p + 5 * math.sqrt(2 * BITS * p * (1 - p)))


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A key for each band of BAND_VALUES MinHash values; no hashes give none."""
    if not len(hashes):
        return hashes
    seeds = _mixed(np.arange(1, 2 * bands * BAND_VALUES + 1, dtype=np.uint64))
    flips, factors = seeds[::2, None], seeds[1::2, None] | np.uint64(1)
    least = np.full(bands * BAND_VALUES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            least = np.minimum(least, ((hashes[None, at : at + 512] ^ flips) * factors).min(1))
    key = np.arange(bands, dtype=np.uint64)
    for values in least.reshape(bands, BAND_VALUES).T:
        key = _mixed(key ^ values)
    return key


def marked_texts(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """doc_id, text_hash, node (a hash of the set of shingles), n (its size), fp and fq (two fingerprints of that set) and bands of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "node", "n", "fp", "fq", "bands"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for t in batch.column(2).to_pylist()]
            nodes = [xxhash.xxh64_intdigest(h.tobytes()) for h in hashes]
            first = [fingerprint(h) for h in hashes]
            second = [fingerprint(_mixed(h)) for h in hashes]
            keys = pa.array([band_keys(h, bands).view(np.int64) for h in hashes], pa.list_(pa.int64()))
            sizes = pa.array([len(h) for h in hashes], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(nodes), sizes, _signed(first), _signed(second), keys], names)

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(make, f"doc_id {kind}, text_hash long, node long, n long, fp long, fq long, bands array<long>")


def common_counts(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``rows`` has in common with each of ``others`` (arrays without repeats), by matrix products."""
    both = [*rows, *others]
    _, column, seen = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    owner, column = owner[shared := seen[column] > 1], column[shared]  # what one set alone has counts for no pair
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) != 0)
    width = max(256, 4_000_000 // len(both))
    out = np.zeros((len(rows), len(others)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [low, low + width])
        dense = np.zeros((len(both), min(width, int(column[-1]) + 1 - low)), np.float32)
        dense[owner[s:e], column[s:e] - low] = 1
        out += dense[: len(rows)] @ dense[len(rows) :].T
    return out


def alike(rows: list[np.ndarray], others: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``rows`` and ``others`` whose Jaccard similarity is at least ``similarity``."""
    common = common_counts(rows, others).astype(np.float64)
    union = np.array([len(x) for x in rows], float)[:, None] + np.array([len(x) for x in others], float)[None, :] - common
    return np.nonzero(common >= similarity * union - 1e-9 * union)


def _compared(similarity: float, shingle: int):
    """Links among texts of each (root, cell): probes with the other rows, or where there are none all with each other.

    Rows (root, cell, probe, node, text) come sorted by root and cell; one cell is held at a time. a, b: a link; degree: how
    many texts of its cell the text a, alike to most of them, is alike to (b is null then).
    """

    def judged(root: int, rows: list[tuple]) -> Iterator[tuple]:
        sets = [np.unique(np.array(shingle_hashes(t, shingle), np.uint64)) for *_, t in rows]
        node = np.array([r[3] for r in rows], np.int64)
        probe = np.array([r[2] for r in rows], bool)
        if not probe.any():
            i, j = alike(sets, sets, similarity)
        else:
            one, two = np.flatnonzero(probe), np.flatnonzero(~probe)
            i, j = alike([sets[k] for k in one], [sets[k] for k in two], similarity)
            i, j = one[i], two[j]
        other = node[i] != node[j]
        if other.any():
            for a, b in zip(*_star(node[i][other], node[j][other]), strict=True):
                yield root, int(a), int(b), None
        degree = np.bincount(i, minlength=len(node))
        yield root, int(node[degree.argmax()]), None, int(degree.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            key, held, nodes = None, [], set()
            for batch in sliced(batches, 200):
                for row in zip(*(batch.column(c).to_pylist() for c in ("root", "cell", "probe", "node", "text")), strict=True):
                    if row[:2] != key:
                        if len(held) > 1:
                            yield from judged(key[0], held)
                        key, held, nodes = row[:2], [], set()
                    if row[2:4] not in nodes:  # rows of equal id and text repeat a node
                        nodes.add(row[2:4])
                        held.append(row)
            if len(held) > 1:
                yield from judged(key[0], held)

        for part in _chunks(cells(), 10_000):
            columns = [pa.array(c, pa.int64()) for c in zip(*part, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["root", "a", "b", "degree"])

    return run


def _chunks(rows: Iterator[tuple], n: int) -> Iterator[list[tuple]]:
    while part := list(islice(rows, n)):
        yield part


def _links_of(rows: DataFrame, similarity: float, shingle: int) -> DataFrame:
    dealt = rows.select("root", "cell", "probe", "node", "text").repartition("root", "cell").sortWithinPartitions("root", "cell", "node")
    return dealt.mapInArrow(_compared(similarity, shingle), "root long, a long, b long, degree long")


def _large_group_links(big: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links (a, b) of the texts ``big`` (root, cells, node, text) of groups that one task does not hold.

    First texts of one cell meet each other, then all texts meet the CENTRES texts of their group that are alike to most
    texts of their cells. What has not joined the group's largest component by then meets every text of the group, cell by
    cell, so no pair is left out, and the work grows with the square of a group only where its texts stay apart.
    """
    home = big.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    all_cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("cell")
    none = F.lit(False).alias("probe")
    first = stored(_links_of(home.select("root", "cell", none, "node", "text"), similarity, shingle), "cells")
    best = Window.partitionBy("root").orderBy(F.desc("degree"), "a")
    centres = first.where("degree > 1").withColumn("k", F.row_number().over(best)).where(F.col("k") <= CENTRES).select(F.col("a").alias("node"))
    centre = big.join(stored(centres, "centres"), "node", "left_semi").select("root", all_cells("cells"), F.lit(True).alias("probe"), "node", "text")
    second = stored(_links_of(home.select("root", "cell", none, "node", "text").unionByName(centre), similarity, shingle), "starred")
    links = first.unionByName(second).where("b is not null").select("a", "b")
    roots = stored(connected_components(links), "part-roots")
    parts = big.select("root", "cells", "node").join(roots.select("node", F.col("root").alias("part")), "node", "left").select("root", "cells", "node", F.coalesce("part", "node").alias("part"))
    counts = parts.groupBy("root", "part").count()
    most = counts.groupBy("root").agg(F.max_by("part", F.struct("count", "part")).alias("largest"), F.sum("count").alias("rows"), F.max("count").alias("joined"))
    most = most.where("rows > joined").select("root", "largest", F.ceil((F.col("rows") - F.col("joined")) / CELL_ROWS).cast("int").alias("strips"))
    open_ = stored(parts.join(most, "root").select("node", "strips", (F.col("part") != F.col("largest")).alias("apart")), "open")
    if not open_.limit(1).count():
        return links
    rest = big.join(open_, "node").withColumns({"home": F.pmod(F.xxhash64("node"), F.col("cells")), "strip": F.pmod(F.xxhash64("node", F.lit(1)), F.col("strips"))})
    at = lambda cell, strip: (cell * F.col("strips") + strip).cast("int")
    index = rest.select("root", "strips", "home", "node", "text", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("s")).select("root", at(F.col("home"), F.col("s")).alias("cell"), none, "node", "text")
    probes = rest.where("apart").select("root", "strips", "strip", "node", "text", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("c")).select("root", at(F.col("c"), F.col("strip")).alias("cell"), F.lit(True).alias("probe"), "node", "text")
    third = stored(_links_of(index.unionByName(probes), similarity, shingle), "crossed")
    return links.unionByName(third.where("b is not null").select("a", "b"))


def _print_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) among the nodes of ``classes`` (node, fp) whose fingerprints are equal or within CANDIDATE_BITS, as stars."""
    prints = stored(classes.groupBy("fp").agg(F.min("node").alias("low")), "prints")
    # both sides come straight from tables, so a print of very many nodes is a skewed join that Spark splits
    equal = classes.select("node", "fp").join(prints, "fp").where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    links = stored(near_links(prints.select("fp"), CANDIDATE_BITS), "print-links")
    ends = [prints.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in ("a", "b")]
    return equal.unionByName(links.join(ends[0], "a").join(ends[1], "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b")))


def text_groups(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text), fp and root for every row; rows of one root are linked by texts whose word
    shingles reach the Jaccard ``similarity``.

    Texts whose fingerprints differ in CANDIDATE_BITS or fewer are candidates, found by ``near_links``; so are those farther apart in bits
    that share a band of MinHash values and whose 128 fingerprint bits are near. Candidates' components
    are small and far apart, so each is then compared in full, whole sets of shingles, in one task; one of over CELL_ROWS
    texts or CELL_SHINGLES shingles is split into cells. Where many rows share a band, rows near to one of them in bits are
    linked to it, and only the others meet the whole band, in cells of BUCKET_ROWS.
    """
    most = far_bits(similarity)
    rows = stored(marked_texts(docs, shingle, band_count(similarity)), "marked")
    shown = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = stored(rows.groupBy("node").agg(F.min(shown).alias("shown"), *[F.min(c).alias(c) for c in ("n", "fp", "fq", "bands")]), "classes")
    banded = classes.select(F.explode("bands").alias("bucket"), "node", "fp", "fq")
    crowds = stored(banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("node", "fp", "fq")).alias("low")).where("size > 1"), "crowds")
    close = F.bit_count(F.expr("fp ^ low.fp")) + F.bit_count(F.expr("fq ^ low.fq")) <= most
    shared = stored(banded.join(crowds, "bucket").withColumn("close", close), "shared")
    to_low = shared.where(F.col("close") & (F.col("node") != F.col("low.node"))).select(F.col("node").alias("a"), F.col("low.node").alias("b"))
    # a row near to the first of its bucket is held in one cell; the others, where there are any, meet the bucket's every cell
    far = stored(shared.where("not close").select("bucket").distinct(), "far-buckets")
    cells = F.ceil(F.col("size") / BUCKET_ROWS).cast("int")
    dealt = shared.join(far, "bucket", "left_semi").select("bucket", "node", "fp", "fq", "close", F.pmod(F.xxhash64("node"), cells).alias("home"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("salt"))
    dealt = dealt.where(~F.col("close") | (F.col("home") == F.col("salt"))).select("bucket", "salt", (F.col("home") != F.col("salt")).alias("probe"), "node", "fp", "fq")
    together = dealt.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "probe")
    candidates = _print_links(classes).unionByName(to_low).unionByName(together.mapInArrow(_bucket_links(["fp", "fq"], most), "a long, b long"))
    groups = stored(connected_components(_in_order(candidates)), "candidates")
    picked = classes.select("node", "n", "shown.doc_id", "shown.text_hash").join(groups, "node")
    sizes = picked.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CELL_ROWS, F.sum("n") / CELL_SHINGLES)).cast("int").alias("cells"))
    wanted = stored(picked.join(sizes, "root").select("node", "root", "cells", F.col("doc_id").alias("id"), F.col("text_hash").alias("th")), "wanted")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("th")))
    texts = texts.select("root", "cells", "node", "text")
    small = texts.where("cells = 1").select("root", F.lit(0).alias("cell"), F.lit(False).alias("probe"), "node", "text")
    links = stored(_links_of(small, similarity, shingle).where("b is not null").select("a", "b"), "alike")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    if wanted.where("cells > 1").limit(1).count():
        big = stored(texts.where("cells > 1").dropDuplicates(["node"]), "large-groups")
        roots = roots.unionByName(connected_components(_large_group_links(big, similarity, shingle)))
    roots = stored(roots, "roots")
    # Both sides come straight from tables, so a class that very many rows share is a skewed join that Spark splits.
    return rows.select("doc_id", "text_hash", "fp", "node").join(roots, "node", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "node").alias("root"))
