"""Exact top-k inner products by descending norm, with partial sums after a rotation and Cauchy-Schwarz bounds.

Components become whole numbers floor(64 x), so scores are exact. The first singular vectors of a
bounded sample gather most of the length in ``HEAD`` dimensions; the partial product over these
plus the product of the residual lengths bounds a score from above. Queries are held in blocks of
bounded size, each block one pass over all vectors, whose result is written before the next block
is held. Every partition takes its vectors by descending length: the longest of all give each query
a first threshold, queries whose bound by length alone can't reach their threshold are done, and
exact scores are computed only where the residual bound can. A partition's best meet in a final
ranking by (score descending, vec_id).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import drop, give_back, in_batches, table

SCALE, K = 64, 20
#: Leading dimensions of the rotated vectors whose product is computed before the bound.
HEAD = 24
#: Vectors that the rotation is fitted on, and those that give the first thresholds; both have at most ``BYTES``.
SAMPLE, LONGEST, BYTES = 2000, 2000, 1 << 25
#: Queries, and bytes of them, held at once.
BLOCK = 8192
#: Sums of products up to this are exact in double precision.
EXACT = float(1 << 53)


def usable(vectors: DataFrame, every: int) -> DataFrame:
    """(vec_id, x, norm, is_query): components as doubles; vectors that are null or hold null or non-finite values are left out.

    norm is the length of floor(64 x), nearly: it orders the vectors, bounds are computed from the components.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    used = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("x", x).where(ok)
    norm2 = F.aggregate("x", F.lit(0.0), lambda s, e: s + e * e)
    return used.select("vec_id", "x", norm2.alias("norm2"), (F.pmod("vec_id", F.lit(every)) == 0).alias("is_query"))


def _matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _whole(x: float) -> int:
    """floor(64 x); a double of 2**47 or more is a multiple of 1/64."""
    return int(x) * SCALE if abs(x) >= 1 << 47 else math.floor(x * SCALE)


def _length(v: np.ndarray) -> np.ndarray:
    """Row lengths; infinite where they leave double precision."""
    most = np.abs(v).max(axis=1, initial=0.0)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(np.sqrt(((v / np.where(most > 0, most, 1)[:, None]) ** 2).sum(1)) * most, nan=np.inf, posinf=np.inf)


class Vectors:
    """Rows of components with floor(64 x) as doubles, their lengths, and head and residual lengths after the rotation."""

    def __init__(self, x: np.ndarray, head: np.ndarray) -> None:
        self.x = x
        with np.errstate(over="ignore", invalid="ignore"):
            self.v = np.floor(x * SCALE)
            self.norm = _length(self.v)
            self.head = self.v @ head
            rest = self.norm**2 * (1 + 1e-9) - (self.head**2).sum(1)
        self.rest = np.sqrt(np.maximum(np.nan_to_num(rest, nan=np.inf, posinf=np.inf), 0))

    def scores(self, mine: np.ndarray, other: Vectors, theirs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Inner products; those ``wanted`` that doubles could round are computed in whole numbers of any size."""
        with np.errstate(over="ignore", invalid="ignore"):
            out = self.v[mine] @ other.v[theirs].T
            wide = wanted & ~(np.outer(self.norm[mine], other.norm[theirs]) * 2 < EXACT)
        if wide.any():
            out = out.astype(object)
            rows = {i: [_whole(e) for e in self.x[mine[i]]] for i in np.flatnonzero(wide.any(axis=1))}
            cols = {j: [_whole(e) for e in other.x[theirs[j]]] for j in np.flatnonzero(wide.any(axis=0))}
            for i, j in zip(*np.nonzero(wide), strict=True):
                out[i, j] = sum(a * b for a, b in zip(rows[i], cols[j], strict=True))
        return out

    def upper(self, mine: np.ndarray, other: Vectors, theirs: np.ndarray) -> np.ndarray:
        """No score is above this: the product over the head and of the residual lengths, with room for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.outer(self.norm[mine], other.norm[theirs])
            out = self.head[mine] @ other.head[theirs].T + np.outer(self.rest[mine], other.rest[theirs]) + 1e-9 * most + 1e-6
        return np.where(np.isnan(out), np.inf, out)


def _floor(score) -> float:
    """A double that is no larger than the score."""
    try:
        return float(score) if abs(score) < EXACT else math.nextafter(float(score), -math.inf)
    except OverflowError:
        return -math.inf if score < 0 else 1.7e308


def _first(q: Vectors, qids: np.ndarray, ids: np.ndarray, longest: Vectors, k: int) -> np.ndarray:
    """For each query what its k-th best score is at least, by the longest vectors."""
    start = np.full(len(qids), -np.inf)
    if len(ids) > k:
        for at in range(0, len(qids), 512):
            mine = slice(at, at + 512)
            with np.errstate(over="ignore", invalid="ignore"):
                s = q.v[mine] @ longest.v.T - 1e-9 * np.outer(q.norm[mine], longest.norm) - 1e-6
            s = np.where(np.isfinite(s) & (qids[mine, None] != ids[None, :]), s, -np.inf)
            start[mine] = np.partition(s, -k, axis=1)[:, -k]
    return start


def _search(queries: np.ndarray, qids: np.ndarray, head: np.ndarray, first_ids: np.ndarray, first: np.ndarray, k: int) -> Callable:
    """One partition's candidates, which come by descending norm: at most the k best of each query, pruned by bounds."""
    dim = queries.shape[1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Vectors(queries, head)
        bound = _first(q, qids, first_ids, Vectors(first, head), k)
        kept: list[list[tuple]] = [[] for _ in qids]  # (-score, vec_id), best first
        for t in in_batches(rows, 1 << 22):
            ids, c = t["vec_id"].to_numpy(), Vectors(_matrix(t["x"].to_pylist(), dim), head)
            for at in range(0, len(ids), 1024):
                some = np.arange(at, min(at + 1024, len(ids)))
                with np.errstate(over="ignore", invalid="ignore"):
                    reach = q.norm * c.norm[some].max() * (1 + 1e-9) + 1e-6
                live = np.flatnonzero(~(reach < bound))
                if not len(live):
                    continue
                may = (q.upper(live, c, some) >= bound[live, None]) & (qids[live, None] != ids[None, some])
                cols, mine = np.flatnonzero(may.any(axis=0)), np.flatnonzero(may.any(axis=1))
                if not len(cols):
                    continue
                may = may[np.ix_(mine, cols)]
                scores, cand = q.scores(live[mine], c, some[cols], may), ids[some[cols]]
                for i, n in enumerate(live[mine].tolist()):
                    ok = np.flatnonzero(may[i] & (scores[i] >= bound[n]))
                    if not len(ok):
                        continue
                    if len(ok) > k and scores.dtype != object:  # ties at the k-th stay
                        ok = ok[scores[i][ok] >= np.partition(scores[i][ok], -k)[-k]]
                    kept[n] = sorted(kept[n] + [(-int(s), v) for s, v in zip(scores[i][ok].tolist(), cand[ok].tolist(), strict=True)])[:k]
                    if len(kept[n]) == k:
                        bound[n] = max(bound[n], _floor(-kept[n][-1][0]))
        found = [(int(i), v, max(-(1 << 63), min(-s, (1 << 63) - 1)), not -(1 << 63) <= -s < 1 << 63) for i, best in zip(qids, kept, strict=True) for s, v in best]
        if found:
            cols = zip(*found, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], ["query_id", "vec_id", "score", "wide"])
        give_back()

    return run


_FOUND = "query_id long, vec_id long, score long, wide boolean"


def top_k(vectors: DataFrame, every: int = 20, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row whose vec_id is divisible by ``every``.

    Scores are integer inner products of floor(64 x); ties go to the smaller vec_id. All candidates if fewer than ``k``.

    * Vectors that are null, or hold null or non-finite components, and null vec_ids take no part.
    * All finite components do. Scores that doubles could round are computed in whole numbers of any
      size; one among the best that doesn't fit a long is an error, as no right value can be returned.
    * Vectors of different lengths: missing components count as 0.
    * Rows with the same vec_id: candidates each, never of a query with that id; the query is one of them, the smallest vector.
    * An empty table gives an empty result; columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    made = table(usable(vectors, every), "vectors")
    facts = made.agg(F.max(F.size("x")), F.count(F.when(F.col("is_query"), 1))).first()
    dim = max(1, facts[0] or 0)
    parts: list[DataFrame] = []
    if facts[1]:
        few = max(1, min(SAMPLE, BYTES // (8 * dim)))
        sample = _matrix([r[0] for r in made.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(few).select("x").collect()], dim)
        scale = np.abs(sample).max(axis=1, initial=0.0)
        _, _, axes = np.linalg.svd(sample / np.where(scale > 0, scale, 1)[:, None], full_matrices=False)
        head = np.ascontiguousarray(axes[:HEAD].T)
        longest = made.orderBy(F.desc("norm2"), "vec_id", "x").limit(max(1, min(LONGEST, BYTES // (8 * dim)))).select("vec_id", "x").collect()
        first_ids, first = np.array([r[0] for r in longest], np.int64), _matrix([r[1] for r in longest], dim)
        blocks = math.ceil(facts[1] / max(1, min(block, 2 * BYTES // (8 * dim))))
        asked = made.where("is_query").groupBy("vec_id").agg(F.min("x").alias("x"))
        asked = table(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")
        sorted_ = made.sortWithinPartitions(F.desc("norm2"), "vec_id").select("vec_id", "x")
        for b in range(blocks):
            rows = asked.where(F.col("block") == b).orderBy("vec_id").collect()
            if not rows:
                continue
            held = spark.sparkContext.broadcast((_matrix([r["x"] for r in rows], dim), np.array([r["vec_id"] for r in rows], np.int64), head, first_ids, first, k))

            def run(found: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                yield from _search(*held.value)(found)

            parts.append(table(sorted_.mapInArrow(run, _FOUND), "best"))
            held.destroy()
        drop(asked)
    drop(made)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = out.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    score = F.when(F.col("wide"), F.raise_error(F.lit("a score among the best does not fit a long")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
