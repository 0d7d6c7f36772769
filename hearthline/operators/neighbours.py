"""Exact nearest neighbours and minority oversampling.

Neighbours are found without comparing everything with everything: points are assigned to
the nearest of a few pivots, first compared within a bounded block of their own cell, and
then sent only to cells that the triangle inequality cannot rule out. Cells are cut into
blocks of bounded size by hash, so a crowded cell, or many copies of one point, is spread
over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline import fixed_values as fv
from hearthline.operators.sampling import hash_rank, uniform
from hearthline.session import cut_lineage

FOUND = "query_id string, neighbour_id string, distance double"
#: Distances that a slice of queries holds at once.
SLICE_CELLS = 2_000_000
#: Blocks that a large table is cut into, and the rows of a block that no table exceeds. Points and
#: queries are copied once for each block of the other side, so more blocks mean more copies.
BLOCKS, MOST_ROWS = 64, 65_536


def rows_of_block(asked: int, total: int) -> int:
    """`asked` rows for a small table; for a large one as many as make BLOCKS blocks, up to MOST_ROWS."""
    return max(asked, min(MOST_ROWS, math.ceil(total / BLOCKS)))


def _closest(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of `points` for every query, a point never its own neighbour, none beyond a
    query's `reach` where it has one.

    Matrix products say which points may be among them, up to a bound on their rounding; only those
    get a distance. Vectors with values that are no numbers have no neighbours.
    """
    empty = pd.DataFrame({"query_id": pd.Series(dtype=str), "neighbour_id": pd.Series(dtype=str),
                          "distance": pd.Series(dtype=float)})
    if not len(queries) or not len(points):
        return empty
    x, y = np.array(queries["vector"].tolist(), float), np.array(points["vector"].tolist(), float)
    names, own = points["id"].to_numpy(), queries["id"].to_numpy()
    reach = queries["reach"].fillna(np.inf).to_numpy(float) if "reach" in queries else np.full(len(x), np.inf)
    keep, numbers = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
    x, own, reach, y, names = x[keep], own[keep], reach[keep], y[numbers], names[numbers]
    if not len(x) or not len(y):
        return empty
    codes = pd.factorize(np.concatenate([names, own]), use_na_sentinel=False)[0]
    name_codes, own_codes = codes[:len(names)], codes[len(names):]
    with np.errstate(over="ignore", invalid="ignore"):
        middle = y.mean(axis=0)
        x0, y0 = x - middle, y - middle
        x2, y2 = (x0 * x0).sum(axis=1), (y0 * y0).sum(axis=1)
        slack = 16 * (x.shape[1] + 8) * np.finfo(float).eps * (
            x2 + y2.max() + x.shape[1] * (np.abs(middle).max() + np.abs(y).max()) ** 2)
    out = []
    step = max(1, min(256, SLICE_CELLS // len(y)))
    for start in range(0, len(x), step):
        part = slice(start, min(start + step, len(x)))
        with np.errstate(over="ignore", invalid="ignore"):
            about = x2[part, None] + y2[None, :] - 2 * (x0[part] @ y0.T)
            about[own_codes[part, None] == name_codes[None, :]] = np.inf
            limit = reach[part] ** 2 * (1 + 1e-12)
            if k < len(y):
                limit = np.minimum(limit, np.partition(about, k - 1, axis=1)[:, k - 1])
            # a bound beyond all numbers rules out nothing
            possible = ~(about > (limit + 2 * slack[part])[:, None]) & (own_codes[part, None] != name_codes[None, :])
        for i in np.flatnonzero(possible.any(axis=1)):
            at = np.flatnonzero(possible[i])
            with np.errstate(over="ignore"):
                distance = np.sqrt(((x[start + i] - y[at]) ** 2).sum(axis=1))
            best = np.lexsort((names[at], distance))[:k]
            out += [(own[start + i], names[at[j]], float(distance[j])) for j in best
                    if distance[j] <= reach[start + i] and np.isfinite(distance[j])]
    return pd.DataFrame(out, columns=["query_id", "neighbour_id", "distance"]) if out else empty


def nearest_neighbours(points: DataFrame, key: str, vector: str, k: int, pivots: int = 32,
                       block_rows: int = 2048, query_rows: int = 8192) -> DataFrame:
    """(query_id, neighbours): the k nearest other points, nearest first.

    `pivots` rows and one summary row per pivot visit the driver; nothing else does. Blocks and
    slices of queries have `block_rows` and `query_rows` rows, more in large tables.
    """
    named = points.select(F.col(key).cast("string").alias("id"),
                          F.transform(F.col(vector), lambda v: v.cast("double")).alias("vector"))
    chosen = named.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
    centres = np.array([r["vector"] for r in chosen])

    @F.pandas_udf("cell int, to_pivot double")
    def assign(vectors: pd.Series) -> pd.DataFrame:
        x = np.array(vectors.tolist())
        distance = np.sqrt(((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
        cell = distance.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "to_pivot": distance[np.arange(len(x)), cell]})

    placed = cut_lineage(named.withColumn("_a", assign("vector")).select("id", "vector", "_a.*"))
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("to_pivot").alias("radius")).collect()}
    total = sum(r["n"] for r in cells.values())
    blocks = {c: max(1, math.ceil(r["n"] / rows_of_block(block_rows, total))) for c, r in cells.items()}
    radius = np.array([cells[c]["radius"] if c in cells else -np.inf for c in range(len(centres))])
    n_blocks = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    blocked = placed.withColumn("block", F.pmod(
        F.xxhash64("id", F.lit(7)), F.element_at(n_blocks, F.col("cell")).cast("long")).cast("int"))

    own = blocked.groupBy("cell", "block").applyInPandas(lambda pdf: _closest(pdf, pdf, k), FOUND)
    own = cut_lineage(own)
    reach = own.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).select(
        F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("d")).alias("reach"))

    @F.pandas_udf("array<int>")
    def candidate_cells(vectors: pd.Series, limits: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist())
        distance = np.sqrt(((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2))
        limit = limits.fillna(np.inf).to_numpy()[:, None]
        near = (distance - radius[None, :] - 1e-9 <= limit) & np.isfinite(radius)[None, :]
        return pd.Series([np.flatnonzero(row).astype("int32") for row in near])

    chunks = max(1, math.ceil(total / rows_of_block(query_rows, total)))
    chunk = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(chunks)).cast("int")
    open_queries = blocked.join(reach, "id", "left").filter(
        F.col("reach").isNull() | (F.col("reach") > 0))
    sent = open_queries.select(
        "id", "vector", "reach", F.col("cell").alias("own_cell"), F.col("block").alias("own_block"),
        F.explode(candidate_cells("vector", "reach")).alias("cell"), chunk.alias("chunk"),
    ).withColumn("block", F.explode(F.sequence(F.lit(0), (F.element_at(n_blocks, F.col("cell")) - 1)))).filter(
        (F.col("cell") != F.col("own_cell")) | (F.col("block") != F.col("own_block"))
    ).select("cell", "block", "chunk", F.col("id").alias("sent_id"), F.col("vector").alias("sent_vector"), "reach")
    held = blocked.select("cell", "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
                          "id", "vector")
    by = ["cell", "block", "chunk"]
    other = sent.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(
        lambda q, p: _closest(q.rename(columns={"sent_id": "id", "sent_vector": "vector"}), p, k), FOUND)
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k)
    return own.unionByName(other).groupBy("query_id").agg(best.alias("neighbours"))


def smote_oversample(df: DataFrame, label: str, key: str, vector: str, ratio: float = fv.SMOTE_TARGET_RATIO,
                     trigger: float = fv.SMOTE_TRIGGER_RATIO, k: int = fv.SMOTE_NEIGHBOURS,
                     seed: int = 42, carry: Sequence[str] = ()) -> DataFrame:
    """Rows (key, vector, label, synthetic): the input, and, when negatives outnumber
    positives more than `trigger` to one, interpolated positives up to `ratio` x negatives.

    Columns in `carry` follow, synthetic rows having those of their base row. Base rows take
    turns by hash rank; the neighbour and the position between the two points
    come from hashes of the row's key and the copy's number.
    """
    base = df.select(F.col(key).cast("string").alias(key),
                     F.transform(F.col(vector), lambda v: v.cast("double")).alias(vector),
                     F.col(label).cast("int").alias(label), F.lit(False).alias("synthetic"), *carry)
    sizes = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    need = int(sizes.neg * ratio) - sizes.pos
    if sizes.pos < 2 or sizes.neg / sizes.pos <= trigger or need <= 0:
        return base
    minority = base.filter(F.col(label) == 1)
    found = nearest_neighbours(minority, key, vector, k).withColumnRenamed("query_id", key)
    turns = hash_rank(minority, [label], [key], seed)
    copies = (F.lit(need // sizes.pos) + (F.col("hash_rank") <= need % sizes.pos).cast("int")).cast("int")
    drawn = (
        turns.select(key, vector, *carry, copies.alias("copies")).filter(F.col("copies") > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .join(found, key)
        .withColumn("pick", (F.floor(uniform([key, "copy"], seed) * F.size("neighbours")) + 1).cast("int"))
        .select(key, vector, *carry, "copy", F.element_at("neighbours", F.col("pick"))["neighbour_id"].alias("other"),
                uniform([key, "copy"], seed + 1).alias("step"))
    )
    others = minority.select(F.col(key).alias("other"), F.col(vector).alias("_to"))
    made = drawn.join(others, "other").select(
        F.concat_ws("+", F.col(key), F.col("copy").cast("string")).alias(key),
        F.zip_with(F.col(vector), F.col("_to"), lambda a, b: a + F.col("step") * (b - a)).alias(vector),
        F.lit(1).alias(label), F.lit(True).alias("synthetic"), *carry)
    return base.unionByName(made)
