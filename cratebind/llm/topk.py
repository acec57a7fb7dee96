"""Exact top-k by inner product with a pivot-distance index.

Vectors are lifted to equal length, so that a larger inner product is a smaller distance; every row is keyed by its nearest
pivot and its distance to it, and each pivot's rows are cut into annuli. A query first takes its nearest annuli until they hold
k rows, which bounds the distance of its k-th neighbour; then, by the triangle inequality, it needs only the annuli that
reach within that bound. Pivots and annulus borders are fitted on a bounded sample and affect the speed alone.

Rules for odd input: vectors without an id, and those that are null, empty or hold null or non-finite components take no part, nor do those whose
length is not the most frequent one; ties go to the smaller vec_id; equal vectors and repeated ids are rows of their own,
but a query skips every row of its own id; components and scores that no long holds are its largest or least number; fewer than k other
rows give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep

SLACK = 1e-6
LARGEST = (1 << 63) - 1
LEAST = -LARGEST - 1


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, x: floor(scale * component) of the usable vectors."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(good).select("vec_id", F.transform(e, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (usual["n"] if usual else 0))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """x with one more component, so that every row has squared length `top`."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, top - (x * x).sum(1)))[:, None]])


class Index:
    """Pivots and the borders of their annuli, fitted on a sample."""

    def __init__(self, sample: np.ndarray, top: float, pivots: int, rings: int):
        self.top = top
        lift = lifted(sample, top)
        chosen, gap = [0], np.full(len(lift), np.inf)
        for _ in range(min(pivots, len(lift)) - 1):  # farthest first
            gap = np.minimum(gap, ((lift - lift[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(gap.argmax()))
        self.pivots = lift[chosen]
        near, d = self.key(sample)
        self.borders = [np.quantile(d[near == p], np.arange(1, rings) / rings) if (near == p).any() else np.zeros(0) for p in range(len(self.pivots))]
        self.rings = rings

    def distances(self, lift: np.ndarray) -> np.ndarray:
        square = (lift * lift).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * lift @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def key(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(lifted(x, self.top))
        near = d.argmin(1)
        return near, d[np.arange(len(d)), near]

    def annulus(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, d = self.key(x)
        ring = np.array([np.searchsorted(self.borders[p], v, "right") for p, v in zip(near, d, strict=True)], np.int64)
        return near * self.rings + ring, d

    def lower_bounds(self, q: np.ndarray, rings: pd.DataFrame) -> np.ndarray:
        """For each query and annulus, the least distance that any of its rows can have."""
        at = np.hstack([q.astype(np.float64), np.zeros((len(q), 1))])
        d = self.distances(at)[:, rings["annulus"].to_numpy() // self.rings]
        return np.maximum(0, np.maximum(rings["near"].to_numpy()[None, :] - d, d - rings["far"].to_numpy()[None, :]))


def stack(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def top_rows(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, smaller vec_id) of each query id, rows in any order."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else np.zeros(0, np.int64)
    good = np.arange(len(query)) - start < k
    return query[good], vec[good], score[good]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact. Those beyond the range of long are its nearest number, so that they compare as the largest.

    Doubles hold them as long as no sum can pass 2^53; beyond that they are worked out in Python's integers.
    """
    widest = float(np.abs(left.astype(np.float64)).max()) * float(np.abs(right.astype(np.float64)).max()) * left.shape[1]
    if widest < 2.0**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return np.clip(left.astype(object) @ right.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


def block_scores(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best rows of one block; left: query_id, x; right: vec_id, x."""
    out = [np.zeros(0, np.int64)] * 3
    if len(left) and len(right):
        x, ids = np.stack(right["x"].to_numpy()), right["vec_id"].to_numpy()
        for i in range(0, len(left), 256):
            part = left.iloc[i : i + 256]
            scores = products(np.stack(part["x"].to_numpy()), x)
            own = part["query_id"].to_numpy()[:, None] == ids[None, :]
            scores[own] = LEAST
            n = min(k, scores.shape[1])
            least = np.partition(scores, scores.shape[1] - n, 1)[:, scores.shape[1] - n]
            a, b = np.nonzero((scores >= least[:, None]) & ~own)  # with all ties of the k-th
            best = top_rows(part["query_id"].to_numpy()[a], ids[b], scores[a, b], k)
            out = [np.r_[p, q] for p, q in zip(out, best, strict=True)]
    return pd.DataFrame({"query_id": out[0], "vec_id": out[1], "score": out[2]})


def search(rows: DataFrame, queries: Column, k: int = 20, pivots: int = 32, rings: int = 8, block: int = 1024, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product for each row where `queries` holds."""
    spark = rows.sparkSession
    rows = keep(rows, "topk-rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norms = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    top = rows.agg(F.max(norms)).first()[0]
    if top is None:
        return empty
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("x").collect()  # `sample` rows at most
    index = Index(np.array([r["x"] for r in fitted], np.int64), float(top), pivots, rings)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                annulus, d = shared.value.annulus(stack(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(annulus, pa.int64()), pa.array(d, pa.float64())], ["vec_id", "x", "annulus", "d"])

    keyed = keep(rows.mapInArrow(assign, "vec_id long, x array<long>, annulus long, d double"), "topk-index")
    facts = keyed.groupBy("annulus").agg(F.min("d").alias("near"), F.max("d").alias("far"), F.count("*").alias("n")).orderBy("annulus").toPandas()  # pivots * rings rows at most
    about = spark.sparkContext.broadcast(facts)
    # rows and queries meet in blocks of bounded size, however many rows an annulus or queries a table has
    size = dict(zip(facts["annulus"], facts["n"], strict=True))
    blocks = F.lit([max(1, -(-int(size.get(a, 0)) // block)) for a in range(pivots * rings)])

    def parts(annulus: str) -> Column:
        return F.element_at(blocks, F.col(annulus).cast("int") + 1).cast("long")

    n_queries = rows.where(queries).count()
    groups = max(1, -(-n_queries // block))
    placed = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts("annulus")))
    asked = keep(rows.where(queries).select(F.col("vec_id").alias("query_id"), "x", F.pmod(F.xxhash64(F.col("vec_id"), F.lit(7)), F.lit(groups)).alias("group")), "topk-queries")

    def visits(first: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, facts = shared.value, about.value
            count = facts["n"].to_numpy()
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    x = stack(part.column(1))
                    low = index.lower_bounds(x, facts)
                    order = np.argsort(low, 1, kind="stable")
                    before = np.cumsum(count[order], 1) - count[order]
                    chosen = np.zeros(low.shape, bool)
                    np.put_along_axis(chosen, order, before < k + 1, 1)  # the nearest annuli that hold k others
                    if not first:
                        kth = np.array([-np.inf if v is None else v for v in part.column(3).to_pylist()])
                        reach = np.sqrt(np.maximum(0, index.top + (x.astype(np.float64) ** 2).sum(1) - 2 * kth))
                        chosen = ~chosen & (low <= reach[:, None] * (1 + SLACK) + SLACK * (1 + math.sqrt(index.top)))  # distances are as exact as their squares
                    a, b = np.nonzero(chosen)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(a)), part.column(1).take(pa.array(a)), part.column(2).take(pa.array(a)), pa.array(facts["annulus"].to_numpy()[b], pa.int64())], ["query_id", "x", "group", "annulus"])

        return work

    def meet(asking: DataFrame, first: bool) -> DataFrame:
        to = asking.mapInArrow(visits(first), "query_id long, x array<long>, group long, annulus long")
        to = to.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts("annulus") - 1)))
        cells = ["annulus", "part", "group"]
        to = keep(to, "topk-asked")
        # rows go only where queries of a group ask for their annulus
        wanted = to.select(*(F.col(c).alias(f"for_{c}") for c in cells)).distinct()
        met = placed.join(wanted, (F.col("annulus") == F.col("for_annulus")) & (F.col("part") == F.col("for_part"))).select("vec_id", "x", *(f"for_{c}" for c in cells))
        return to.groupBy(*cells).cogroup(met.groupBy(*(f"for_{c}" for c in cells))).applyInPandas(lambda a, b: block_scores(a, b, k), "query_id long, vec_id long, score long")

    near = keep(meet(asked, True), "topk-near")
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("query_id", F.when(F.size("s") >= k, F.element_at("s", k)).cast("double").alias("kth"))
    # an annulus block of the first visit gives at most k rows to a query, and a query has few of them
    rest = meet(asked.join(kth, "query_id", "left").select("query_id", "x", "group", "kth"), False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8(vectors: DataFrame) -> DataFrame:
    return search(integers(vectors), F.col("vec_id") % 20 == 0)


OP8_SQL = """
with v as (
  select vec_id, [floor(64 * x::double)::bigint for x in embedding] as x from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, [c::double for c in x] as x from v where len(x) = (select len(x) from v group by 1 order by count(*) desc, 1 limit 1)),
p as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from u q join u c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 20
"""
