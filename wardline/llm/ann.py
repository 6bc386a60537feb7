"""Approximate nearest neighbours by collision-counting hashing with query-centred windows.

Every block of the index keeps one sorted array for each of ``projections`` random directions. A query opens a window
around its own projection in every array; virtual rehashing widens all windows by a factor, and only the entries that
come in are counted. A vector that collides in ``share`` of the arrays is verified with the exact product. A query is
done once a vector as far as its k-th verified one would have reached that count with ``z`` standard deviations to
spare, or when all vectors of the block are verified. Largest inner product becomes nearest distance by one more
dimension that brings all vectors to the largest norm.

The stated query set meets all rows in blocks of bounded size: the arrays of an index block are built once, and the
queries stream through them. Each block returns its k best of a query, which a window with a group limit merges. Recall
over one block and over several is measured against brute force in tests/llm/test_operators.py.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a null
id; vectors meet those of their own length only; repeated ids are candidates of their own but never of their own id; rows
that repeat a query are one query, and those that repeat its id with another vector are queries of their own, each with
its ranks; fewer candidates than k give all; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import runs, stored, table

PROJECTIONS, SHARE, Z, WIDEN, FIRST = 64, 0.6, 1.2, 1.4, 0.25
#: Components of an index block, in bytes; queries in a block, and the most such blocks that one part takes.
INDEX_BYTES, QUERY_BLOCK, PART_BLOCKS = 1 << 24, 256, 256


class CollisionIndex:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, projections: int = PROJECTIONS, share: float = SHARE, z: float = Z):
        self.ids, self.vectors, self.norm, self.share, self.z = ids, vectors.astype(np.float64), norm, share, z
        unit = self.vectors / norm
        rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))
        self.directions = np.random.Generator(np.random.PCG64(7)).standard_normal((unit.shape[1] + 1, projections))
        value = unit @ self.directions[:-1] + rest[:, None] * self.directions[-1]
        self.order = np.ascontiguousarray(np.argsort(value, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(value, self.order.T, axis=0).T.copy()
        self.verified = 0
        # half a window, for each unit of distance, in which a vector collides often enough with z deviations to spare
        chance = np.linspace(0, 1, 2001)[1:-1]
        spare = projections * chance - z * np.sqrt(projections * chance * (1 - chance)) >= math.ceil(share * projections)
        self.reach = NormalDist().inv_cdf((1 + float(chance[spare.argmax()])) / 2) if spare.any() else 6.0

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best found, best first, ties to the smaller id."""
        n, m = len(self.ids), len(self.sorted)
        q = query.astype(np.float64)
        size = math.sqrt(float(q @ q))
        centre = (q / size) @ self.directions[:-1]
        need = max(1, math.ceil(self.share * m))
        count = np.zeros(n, np.int64)
        done = self.ids == query_id
        left = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre, strict=True)])
        right = left.copy()
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        half = FIRST
        while True:
            new = []
            for j in range(m):
                lo, hi = self.sorted[j].searchsorted((centre[j] - half, centre[j] + half)).tolist()
                new += [self.order[j, lo : left[j]], self.order[j, right[j] : hi]]
                left[j], right[j] = lo, hi
            count += np.bincount(np.concatenate(new), minlength=n)
            pick = np.flatnonzero((count >= need) & ~done)
            done[pick] = True
            self.verified += len(pick)
            some = self.vectors[pick]
            near = some @ q
            if len(near) > k:  # what rounding cannot bring to the k best is left
                best = near >= np.partition(near, -k)[-k] - 1e-9 * (1 + size * self.norm)
                pick, some = pick[best], some[best]
            found = np.concatenate((found, pick))
            scores = np.concatenate((scores, (some * q).sum(1)))
            if len(found) > k:
                best = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
            if done.all() or bool((right - left == n).all()):
                break
            wider = half * WIDEN
            if len(found) == k:
                far = math.sqrt(max(0.0, 2 - 2 * float(scores.min()) / (size * self.norm)))
                enough = far * self.reach
                if half >= enough:
                    break
                wider = max(half * 1.02, min(wider, enough))
            half = wider
        best = np.lexsort((self.ids[found], -scores))
        return self.ids[found[best]], scores[best]


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """Of (d, block, id, h, v) one row (d, block, ids, hashes, vectors) a block, the lists as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["d", "block"]):
            ids, h = (t.column(c).to_numpy().astype("<i8") for c in ("id", "h"))
            v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
            yield pa.record_batch([t.column("d")[:1].combine_chunks(), t.column("block")[:1].combine_chunks(), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, h, v))], ["d", "block", "ids", "hashes", "vectors"])

    # the same block whatever order rows came in
    dealt = rows.repartition(n, "d", "block").sortWithinPartitions("d", "block", "id", "h")
    return dealt.mapInArrow(run, "d int, block long, ids binary, hashes binary, vectors binary")


def _search_parts(k: int, share: float, z: float):
    """Of each part (d, block, part), sorted, its index block (kind 0), built once, and the query blocks that meet it (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                d, block, part, kind, ids, hashes, vectors, norm = (batch.column(c)[i].as_py() for c in ("d", "block", "part", "kind", "ids", "hashes", "vectors", "norm"))
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(-1, d)
                if kind == 0:
                    made, key = CollisionIndex(ids, x, norm, share=share, z=z), (d, block, part)
                    continue
                assert key == (d, block, part)
                hits = [made.search(q, v, k) for q, v in zip(ids.tolist(), x, strict=True)]
                size = [len(h[0]) for h in hits]
                cols = [np.repeat(ids, size), np.repeat(np.frombuffer(hashes, "<i8"), size), *(np.concatenate([h[j] for h in hits]) for j in (0, 1))]
                yield pa.record_batch([pa.array(c) for c in cols], ["query_id", "h", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE, z: float = Z) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row among the index rows of other ids."""
    usable = F.col("v").isNotNull() & F.col("id").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = lambda t: t.select(t[id_col].cast("long").alias("id"), t[vec_col].cast("array<double>").alias("v")).where(usable).withColumns({"d": F.size("v"), "h": F.xxhash64("v")})
    base, ask = clean(index), clean(queries).distinct()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = base.groupBy("d").agg(F.count("*").alias("n"), F.sqrt(F.max(norm2)).alias("norm"))
    asked = ask.groupBy("d").agg(F.count("*").alias("q"))
    blocks = F.ceil(F.col("n") * F.col("d") * 8 / INDEX_BYTES).cast("long")
    # one row a length of vectors
    plan = stored(sizes.join(asked, "d").select("d", "norm", blocks.alias("blocks"), F.ceil(F.col("q") / QUERY_BLOCK).cast("long").alias("chunks")), "plan")
    all_blocks = plan.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("chunks"), F.lit(0))).first()
    spread = math.ceil(index.sparkSession.sparkContext.defaultParallelism / max(1, all_blocks[0]))
    # a block meets all queries in one part, or in several where there are fewer blocks than cores or very many queries
    plan = plan.withColumn("parts", F.least("chunks", F.greatest(F.lit(spread), F.ceil(F.col("chunks") / PART_BLOCKS))))
    deal = lambda rows, n: rows.join(plan.select("d", F.col(n).alias("m")), "d").select("d", F.pmod("h", "m").alias("block"), "id", "h", "v")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rest = ("d", "block", "part", "kind", "turn", "ids", "hashes", "vectors", "norm")
    kept = stored(_blocks(deal(base.withColumn("h", F.xxhash64("id", "v")), "blocks"), max(1, all_blocks[0])), "index_blocks")
    asks = stored(_blocks(deal(ask, "chunks"), max(1, all_blocks[1])), "query_blocks")
    left = kept.join(plan, "d").select("*", upto("parts").alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn")).select(*rest)
    right = asks.withColumnRenamed("block", "turn").join(plan, "d").select("*", upto("blocks").alias("block"), F.pmod("turn", "parts").alias("part"), F.lit(1).alias("kind")).select(*rest)
    n = max(1, plan.agg(F.sum(F.col("blocks") * F.col("parts"))).first()[0] or 0)
    met = left.union(right).repartition(4 * n if n < 1000 else n, "d", "block", "part").sortWithinPartitions("d", "block", "part", "kind", "turn")
    near = met.mapInArrow(_search_parts(k, share, z), "query_id long, h long, vec_id long, score double")
    best = W.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
