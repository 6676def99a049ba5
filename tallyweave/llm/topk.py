"""Exact inner-product search, pruned by segment statistics from coarse to fine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored

#: Rows of a candidate group and of a query block at scale; groups at least, while they still hold 256 rows.
GROUP_ROWS, QUERY_ROWS, LEAST_GROUPS = 32_768, 8_192, 64


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and ``v``: floor(scale * x) of every component; vectors null or with a null, infinite or NaN component go."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & finite).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _segments(m: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of the length, and norms of what is left, of each of ``parts`` segments."""
    cuts = np.linspace(0, m.shape[1], parts + 1).astype(int)
    mean, rest = np.empty((len(m), parts)), np.empty((len(m), parts))
    for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        seg = m[:, a:b]
        mu = seg.mean(1) if b > a else np.zeros(len(m))
        mean[:, j] = mu * np.sqrt(b - a)
        rest[:, j] = np.sqrt(np.maximum(0, ((seg - mu[:, None]) ** 2).sum(1)))
    return mean, rest


def group_top(ids: np.ndarray, rows: np.ndarray, m: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int, levels: tuple[int, ...] = (1, 4, 16), tile: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best of a group for each query; its own row is no candidate.

    By segments, q.x = sum of (means' product) + (rests' product) <= sum of mean*mean + norm*norm; in squared
    distances |q|^2 + |x|^2 - 2q.x that is the lower bound by means and deviations. A few candidates of the best
    coarse bound give each query a k-th score to beat; the others are dropped level by level where their bound
    stays below it, and survivors get exact integer products.
    """
    # Tightest at the k-th score, then ties: whatever may equal it survives. Bounds carry a margin for rounding.
    order = np.argsort(ids, kind="stable")
    ids, row, m = ids[order], rows[order], m[order]
    mf, levels = m.astype(np.float64), [p for p in levels if p <= max(1, m.shape[1])]
    stats = [_segments(mf, p) for p in levels]
    exact_float = m.size == 0 or float(np.abs(mf).max()) * float(np.abs(q).max(initial=0)) * max(1, m.shape[1]) < 2**52
    out_q, out_c, out_s = [], [], []
    for at in range(0, len(q), tile):
        qt = q[at : at + tile]
        qf = qt.astype(np.float64)
        bound = None
        for level, (mean, rest) in enumerate(stats):
            qm, qr = _segments(qf, levels[level])
            if bound is None:
                bound = qm @ mean.T + qr @ rest.T
                seeds = np.argpartition(-bound, min(4 * k, len(ids)) - 1, axis=1)[:, : 4 * k]
                known = np.einsum("qd,qsd->qs", qf, mf[seeds])
                known[row[seeds] == query_rows[at : at + tile, None]] = -np.inf
                floor = np.sort(known, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(qf), -np.inf)
                slack = 1e-9 * (np.abs(floor) + np.abs(bound).max(1) + 1)
                slack[~np.isfinite(slack)] = 0
                alive = bound >= (floor - slack)[:, None]
            else:
                rows = np.flatnonzero(alive.any(0))
                alive[:, rows] &= (qm @ mean[rows].T + qr @ rest[rows].T) >= (floor - slack)[:, None]
        rows = np.flatnonzero(alive.any(0))
        scores = (qf @ mf[rows].T).astype(np.int64) if exact_float else qt @ m[rows].T
        for i, own in enumerate(query_rows[at : at + tile]):
            keep = alive[i, rows] & (row[rows] != own)
            s, c = scores[i][keep], ids[rows][keep]
            best = np.lexsort((c, -s))[:k]
            out_q.append(np.full(len(best), own))
            out_c.append(c[best])
            out_s.append(s[best])
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _searched(k: int):
    def search(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(queries):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
        m, q = np.stack(cands["v"].to_numpy()).astype(np.int64), np.stack(queries["v"].to_numpy()).astype(np.int64)
        a, b, s = group_top(cands["vec_id"].to_numpy(), cands["row"].to_numpy(), m, queries["row"].to_numpy(), q, k)
        return pd.DataFrame({"query": a, "vec_id": b, "score": s})

    return search


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest integer inner products, ties to the smaller id.

    ``is_query`` is a Column over vec_id. Candidates are dealt by hash to groups, queries to blocks of QUERY_ROWS;
    every (group, block) cell is searched in one task and the cells' top k meet in a last ranking, so a task
    holds one group and one block at most. The candidates travel once for each query block.

    Vectors null or with null or non-finite components take no part, nor rows with a null id; vectors of unlike
    lengths do not meet; of rows with one id all take part, each query row with an answer of its own and only itself left
    out (equal scores and ids stay apart); fewer than k
    candidates give fewer rows; no rows give none. Columns besides vec_id and embedding are ignored. Products
    are exact within 64 bits.
    """
    rows = stored(quantised(vectors.select("vec_id", "embedding")).where("vec_id is not null").withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}), "vectors")
    queries = rows.where(is_query)
    n, nq = rows.count(), queries.count()
    groups = max(-(-n // GROUP_ROWS), min(LEAST_GROUPS, -(-n // 256)), 1)
    blocks = max(1, -(-nq // QUERY_ROWS))
    h = F.xxhash64("row")
    cells = lambda df, own, count, other, n_other: df.withColumn(own, F.pmod(h, F.lit(count))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    cands = cells(rows, "grp", groups, "blk", blocks).select("grp", F.col("blk").cast("long").alias("blk"), "dim", "vec_id", "row", "v")
    asked = cells(queries, "blk", blocks, "grp", groups).select(F.col("grp").cast("long").alias("grp"), "blk", "dim", "row", "v")
    key = ["grp", "blk", "dim"]
    found = cands.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_searched(k), "query long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
