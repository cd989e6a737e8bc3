"""Exact top-k inner products by vector-approximation files.

Every vector is approximated by the cell of a fixed grid it lies in, one byte a component. Cells
alone bound a score from both sides. They are scanned first; exact vectors are then read in the
order of the bounds until the k-th best score is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.sources.scratch import materialize


def _numbered(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """row, id and v = floor(scale * component) of the rows that take part."""
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("x").isNotNull()).filter(~F.coalesce(bad, F.lit(False)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", v.alias("v"))


def _edges(rows: DataFrame, bits: int) -> np.ndarray:
    """Least number of each cell, by component; a further column ends the last cell. Missing components are 0."""
    spans = rows.select(F.posexplode("v")).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi"))
    found = sorted(spans.collect(), key=lambda r: r.pos)
    lo = np.array([min(r.lo, 0) for r in found], np.int64)
    hi = np.array([max(r.hi, 0) for r in found], np.int64) + 1
    cells = 1 << bits
    return lo[:, None] + (hi - lo)[:, None] * np.arange(cells + 1) // cells


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(lists)), sizes), at] = lists.flatten().to_numpy()
    return out


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
    scale: int = 256, bits: int = 6, most_rows: int = 65_536, most_queries: int = 4_096, least_cells: int = 48,
) -> DataFrame:
    """The ``k`` highest scores of each query: query_id, rank (from 1), vec_id, score.

    A component counts as floor(scale * component); the score is the integer inner product, which
    must fit 64 bits. Queries are the rows that ``queries`` holds for (a condition on ``vectors``);
    candidates are all rows with another id. Equal scores go by the smaller id. Rows whose id or
    vector is null, or whose vector holds a null or a number that isn't finite, take no part. Shorter vectors count as
    padded with zeros. A repeated row is several candidates, but one query (of the least vector, if
    they differ). With fewer candidates than ``k`` all are given; no row or no query, no result.

    Approximations and queries meet in a grid of blocks of at most ``most_rows`` by
    ``most_queries``; a block keeps what its bounds cannot rule out.
    """
    asked = vectors.filter(queries)
    rows = materialize(_numbered(vectors, key, vector, scale), "vectors")
    edges = _edges(rows, bits)
    width = len(edges)
    mine = _numbered(asked, key, vector, scale).groupBy("id").agg(F.min("v").alias("q")).withColumnRenamed("id", "query")
    mine = materialize(mine, "queries")
    n, m = rows.count(), mine.count()
    size = max(1, min(most_rows, n // least_cells))
    across, down = -(-n // size) or 1, -(-m // most_queries) or 1
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(edges)

    def approximate(batches):
        e = shared.value
        for b in batches:
            v = _matrix(pa.chunked_array([b.column("v")]), width)
            codes = np.stack([np.searchsorted(e[d], v[:, d], side="right") - 1 for d in range(width)], 1) if width else v
            codes = np.ascontiguousarray(codes.astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], ["row", "id", "code"]
            )

    def scan(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        e, found = shared.value, []
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(-1, width)
        least, most = (e[np.arange(width), codes.astype(np.int64) + s].astype(np.float64) - s for s in (0, 1))
        row, ids = (left.column(c).to_numpy() for c in ("row", "id"))
        query, q = right.column("query").to_numpy(), _matrix(right.column("q"), width).astype(np.float64)
        step = max(1, (1 << 22) // max(1, len(row)))
        for i in range(0, len(query), step):
            up, down_ = np.maximum(q[i : i + step], 0), np.minimum(q[i : i + step], 0)
            low, high = up @ least.T + down_ @ most.T, up @ most.T + down_ @ least.T
            own = query[i : i + step, None] == ids[None]
            low[own] = high[own] = -np.inf
            enough = np.full(len(low), -np.inf)
            if low.shape[1] >= k:
                enough = np.partition(low, -k, axis=1)[:, -k]
            a, b = np.nonzero((high >= enough[:, None] - np.abs(enough[:, None]) * 1e-12) & ~own)
            found.append((query[i + a], row[b], ids[b], low[a, b], high[a, b]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0)] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c).cast(t) for c, t in zip(columns, kinds)], names=["query", "row", "vec", "low", "high"])

    codes = rows.mapInArrow(approximate, "row long, id long, code binary")
    placed = codes.withColumn("i", F.pmod(F.xxhash64("row"), F.lit(across)))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    spread = mine.withColumn("j", F.pmod(F.xxhash64("query"), F.lit(down)))
    spread = spread.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    bounds = placed.groupBy("i", "j").cogroup(spread.groupBy("i", "j")).applyInArrow(
        scan, "query long, row long, vec long, low double, high double"
    )
    bounds = materialize(bounds, "bounds")
    by_low = Window.partitionBy("query").orderBy(F.desc("low"))
    sure = F.nth_value("low", k).over(by_low.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    open_ = bounds.withColumn("sure", sure).filter("sure is null or high >= sure - abs(sure) * 1e-12")
    by_high = Window.partitionBy("query").orderBy(F.desc("high"), "row")
    open_ = materialize(open_.withColumn("place", F.row_number().over(by_high)), "open_bounds")

    def exact(pairs: DataFrame) -> DataFrame:
        product = F.aggregate(
            F.zip_with("q", "v", lambda x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x
        )
        read = pairs.join(rows.select("row", "v"), "row").join(mine, "query")
        return read.select("query", "vec", product.alias("score"), "row")

    first = materialize(exact(open_.filter(F.col("place") <= k)), "first_scores")
    reached = first.groupBy("query").agg(F.min("score").alias("reached"))
    rest = open_.filter(F.col("place") > k).join(reached, "query").filter("high >= reached")
    scores = first.unionByName(exact(rest.select("query", "vec", "row")))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec", "row")
    ranked = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
