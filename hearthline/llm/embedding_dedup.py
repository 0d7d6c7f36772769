"""Embedding near-dedup by NN-descent on cosine similarity.

Equal vectors are one class. A first neighbour graph comes from several random-hyperplane orders:
vectors are range partitioned by their sign code and one projection, and neighbours are the best
among those nearby in the order, so crowded codes are cut into blocks like any others. The graph
is refined by neighbours-of-neighbours joins: at every node its neighbours, and those that have it
as a neighbour, are compared with each other, and better ones enter the lists: K of any similarity,
and links up to MOST_LINKS. Orders and sign bits grow with the number of vectors. An audit
compares a bounded sample of vectors, half of them known to have links, with all others by brute
force; while the recall of listed links is below TARGET, there are further rounds with new orders,
and after MOST_ROUNDS an error.

Edges at or above the threshold are links. A list of MOST_LINKS links is full, and its component a
crowd: every vector whose angle to the crowd's pivot allows a link with some member is compared
with the members that it could be linked with, in blocks, so crowds lose no link to another
component. A crowd's members are counted by their
angle to a pivot: two whose angles add up to no more than the threshold's are linked, two whose
angles differ by more are not, and only pairs in between are compared. A group of thousands of
near copies is so counted without its pairs.

Edge cases: null, empty and zero vectors and those with null or non-finite components have no
links and are their own component; vectors are compared with those of their own length; rows
that repeat a vec_id are different rows with the same component; rows without vec_id are not
compared; an empty table gives no rows; columns besides `vec_id` and `embedding` are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.graph import connected_components
from hearthline.llm.shipping import shipped
from hearthline.session import cut_lineage

THRESHOLD = 0.95
NEIGHBOURS = 8
#: Orders for the first graph, sign bits in a code, and rows in a block of an order.
ORDERS, BITS, BLOCK = 6, 10, 160
ROUNDS, MOST_ROUNDS = 1, 12
#: Links in a list at which it is full, and pivots that the driver sends out at a time.
MOST_LINKS, PIVOTS = 64, 2048
#: Rows in a block of a crowd.
CROWD_BLOCK = 256
#: Recall of links at which the audit is content, and vectors it looks at.
TARGET, AUDITED = 0.98, 400
#: Degrees in a step of the pivot angles.
STEP = 0.01
#: Angles nearer than this to a limit are compared exactly.
CLOSE = 1e-6

EDGES = "u long, v long, sim double"


def units(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) and classes (node, weight, dim, unit) of usable vectors."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))
    usable = (rows.filter("vec_id is not null and size(x) > 0")
              .filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
              .filter(F.exists("x", lambda c: c != 0)))
    largest = F.array_max(F.transform("x", lambda c: F.abs(c)))
    scaled = usable.withColumn("largest", largest).withColumn("x", F.transform("x", lambda c: c / F.col("largest")))
    unit = scaled.withColumn("norm", norm).select("vec_id", F.size("x").alias("dim"), F.xxhash64("x").alias("h1"),
                                                  F.xxhash64(F.lit(1), "x").alias("h2"), "x", "norm")

    def packed(batches):
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "dim": b["dim"], "h1": b["h1"], "h2": b["h2"],
                                "unit": [(np.asarray(x, np.float64) / n).tobytes() for x, n in zip(b["x"], b["norm"])]})

    usable = cut_lineage(unit.mapInPandas(packed, "vec_id long, dim int, h1 long, h2 long, unit binary"))
    first = usable.groupBy("h1", "h2", "dim").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    members = cut_lineage(usable.select("vec_id", "h1", "h2", "dim").join(first, ["h1", "h2", "dim"]).select("vec_id", "node").distinct())
    classes = (usable.join(first, ["h1", "h2", "dim"]).filter("vec_id = node").dropDuplicates(["node"])
               .select("node", "weight", "dim", "unit"))
    return members, cut_lineage(classes)


def best_in_block(node: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    sims = x @ x.T
    np.fill_diagonal(sims, -2.0)
    k = min(k, len(node) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return pd.DataFrame({"u": np.repeat(node, k), "v": node[best].ravel(), "sim": np.take_along_axis(sims, best, 1).ravel()})


def ordered_neighbours(classes: DataFrame, orders: range, k: int, bits: int = BITS) -> DataFrame:
    """The best neighbours of every node among those near it in some random orders."""
    def coded(batches):
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = units(part["unit"])
                for order in orders:
                    planes = np.random.default_rng([order, dim]).standard_normal((dim, bits + 1))
                    side = x @ planes
                    code = (side[:, :bits] > 0) @ (1 << np.arange(bits))
                    yield pd.DataFrame({"order_no": order, "dim": dim, "code": code, "side": side[:, bits],
                                        "node": part["node"].to_numpy(), "unit": part["unit"].to_numpy()})

    def compared(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held) < 4 * BLOCK:
                continue
            yield from blocks(held)
            held = held.iloc[-(BLOCK // 2):].reset_index(drop=True)
        if held is not None:
            yield from blocks(held)

    def blocks(rows):
        for _, part in rows.groupby(["order_no", "dim"], sort=False):
            node, x = part["node"].to_numpy(np.int64), units(part["unit"])
            for at in range(0, max(1, len(node) - BLOCK // 2), BLOCK // 2):
                if len(node[at:at + BLOCK]) > 1:
                    yield best_in_block(node[at:at + BLOCK], x[at:at + BLOCK], k)

    keys = ["order_no", "dim", "code", "side"]
    spread = classes.select("node", "dim", "unit").mapInPandas(
        coded, "order_no int, dim int, code long, side double, node long, unit binary")
    return spread.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInPandas(compared, EDGES)


def best_lists(edges: DataFrame, k: int, threshold: float, most: int) -> DataFrame:
    """The k best of every node, and its links beyond them up to `most`."""
    by_sim = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return (edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("nth", F.row_number().over(by_sim))
            .filter((F.col("nth") <= k) | ((F.col("sim") >= threshold) & (F.col("nth") <= most))).drop("nth"))


def refined(lists: DataFrame, classes: DataFrame, k: int, threshold: float, most: int) -> DataFrame:
    """Edges among the neighbours of each node that are better than what the lists hold."""
    low = F.when(F.col("n") >= most, F.col("low")).when(
        F.col("n") >= k, F.least("low", F.lit(threshold - CLOSE))).otherwise(-2.0)
    worst = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low")).select(
        F.col("u").alias("node"), low.alias("low"))
    best, drawn = Window.partitionBy("u").orderBy(F.desc("sim"), "v"), F.xxhash64("u", "v")
    forward = lists.withColumn("nth", F.row_number().over(best)).withColumn(
        "turn", F.row_number().over(Window.partitionBy("u").orderBy(drawn)))
    forward = forward.filter((F.col("nth") <= k) | (F.col("turn") <= k))
    backward = lists.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy(drawn))).filter(F.col("nth") <= k)
    around = forward.select(F.col("u").alias("centre"), F.col("v").alias("node")).union(
        backward.select(F.col("v").alias("centre"), F.col("u").alias("node"))).distinct()
    gathered = (around.join(classes.select("node", "unit"), "node").join(worst, "node")
                .groupBy("centre").agg(F.collect_list(F.struct("node", "unit", "low")).alias("near")))  # at most 3k

    def local(batches):
        for b in batches:
            out = []
            for near in b["near"]:
                if len(near) < 2:
                    continue
                node = np.array([r["node"] for r in near], np.int64)
                low = np.array([r["low"] for r in near])
                x = units([r["unit"] for r in near])
                sims = x @ x.T
                np.fill_diagonal(sims, -3.0)
                i, j = np.nonzero(sims > low[:, None])
                out.append((node[i], node[j], sims[i, j]))
            if out:
                yield pd.DataFrame({"u": np.concatenate([o[0] for o in out]), "v": np.concatenate([o[1] for o in out]),
                                    "sim": np.concatenate([o[2] for o in out])}).drop_duplicates(["u", "v"])

    return gathered.select("near").mapInPandas(local, EDGES)


def full_nodes(lists: DataFrame, threshold: float, most: int) -> DataFrame:
    return (lists.filter(F.col("sim") >= threshold).groupBy("u").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= most).select(F.col("u").alias("node")))


def audit(classes: DataFrame, lists: DataFrame, threshold: float, sample: int, most: int) -> float:
    """Share of the links of a bounded sample, found by brute force, that are listed at either end.

    Half of the sample is drawn from vectors with a listed link. Links of full lists are left
    out; they are found by their crowd. 1.0 where the whole sample has no link."""
    by_hash = F.xxhash64(F.lit("audit"), "node")
    linked = lists.filter(F.col("sim") >= threshold).select(F.col("u").alias("node")).distinct()
    full = full_nodes(lists, threshold, most)
    drawn = [rows.join(full, "node", "left_anti").orderBy(by_hash).limit(sample // 2).select("node", "dim", "unit")
             for rows in (classes.join(linked, "node", "left_semi"), classes)]
    picked = drawn[0].union(drawn[1]).dropDuplicates(["node"]).collect()
    shared = shipped(classes.sparkSession, [(r["node"], r["dim"], bytes(r["unit"])) for r in picked])

    def brute(batches):
        queries = shared()
        for b in batches:
            for dim, part in b.groupby("dim"):
                own = [q for q in queries if q[1] == dim]
                if own:
                    node, x = part["node"].to_numpy(np.int64), units(part["unit"])
                    ids, y = np.array([q[0] for q in own]), units([q[2] for q in own])
                    i, j = np.nonzero(x @ y.T >= threshold)
                    keep = node[i] != ids[j]
                    yield pd.DataFrame({"u": ids[j][keep], "v": node[i][keep]})

    true = classes.select("node", "dim", "unit").mapInPandas(brute, "u long, v long")
    true = true.join(full.toDF("v"), "v", "left_anti")
    near = lists.filter(F.col("sim") >= threshold)
    listed = near.select("u", "v").union(near.select("v", "u")).distinct().withColumn("hit", F.lit(1))
    found = true.join(listed, ["u", "v"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return found["hit"] / found["n"] if found["n"] else 1.0


def neighbour_lists(classes: DataFrame, threshold: float, k: int, most: int) -> tuple[DataFrame, float]:
    size = max(2, classes.count())
    bits = max(BITS, math.ceil(math.log2(size / BLOCK)))  # about a block for every code
    orders = ORDERS + bits - BITS
    lists = cut_lineage(best_lists(ordered_neighbours(classes, range(orders), k, bits), k, threshold, most))
    done = 0
    while True:
        for _ in range(ROUNDS):
            lists = cut_lineage(best_lists(lists.union(refined(lists, classes, k, threshold, most)), k, threshold, most))
        recall = audit(classes, lists, threshold, AUDITED, most)
        done += ROUNDS
        if recall >= TARGET:
            return lists, recall
        if done >= MOST_ROUNDS:
            raise RuntimeError(f"recall of links is {recall:.3f} after {done} rounds, below {TARGET}")
        more = ordered_neighbours(classes, range(orders * done, orders * (done + 1)), k, bits)
        lists = cut_lineage(best_lists(lists.union(more), k, threshold, most))


def crowd_links(classes: DataFrame, components: DataFrame, crowds: DataFrame, threshold: float) -> DataFrame:
    """a, b: for every crowd and every vector outside that is linked with some member, one such link
    at least, by comparison with all members that the angles to the pivot allow."""
    limit = math.degrees(math.acos(threshold)) + CLOSE
    inside = components.join(crowds, "component", "left_semi").join(classes, "node").select("component", "node", "dim", "unit")
    pivots = inside.filter("node = component").select("component", F.col("unit").alias("pivot"))

    def angles(batches):
        for b in batches:
            chord = np.linalg.norm(units(b["unit"]) - units(b["pivot"]), axis=1)
            yield pd.DataFrame({"component": b["component"], "node": b["node"], "unit": b["unit"],
                                "angle": np.degrees(2 * np.arcsin(np.minimum(1.0, chord / 2)))})

    placed = "component long, node long, unit binary, angle double"
    members = cut_lineage(inside.join(pivots, "component").select("component", "node", "unit", "pivot").mapInPandas(angles, placed))
    radius = members.groupBy("component").agg(F.max("angle").alias("radius"))
    centres = cut_lineage(inside.filter("node = component").join(radius, "component").select("component", "dim", "unit", "radius"))
    outside = classes.join(components, "node", "left").select("node", "dim", "unit", F.coalesce("component", "node").alias("own"))
    chunks = max(1, math.ceil(centres.count() / PIVOTS))
    near = None
    for chunk in range(chunks):
        some = centres.filter(F.pmod(F.xxhash64("component"), F.lit(chunks)) == chunk).collect()  # about PIVOTS rows
        shared = shipped(classes.sparkSession, [(r["component"], r["dim"], bytes(r["unit"]), r["radius"]) for r in some])

        def reach(batches, shared=shared):
            crowd = shared()
            for b in batches:
                for dim, part in b.groupby("dim"):
                    own = [c for c in crowd if c[1] == dim]
                    if not own:
                        continue
                    x, p = units(part["unit"]), units([c[2] for c in own])
                    name, wide = np.array([c[0] for c in own]), np.array([c[3] for c in own])
                    angle = np.degrees(np.arccos(np.clip(x @ p.T, -1, 1)))
                    i, j = np.nonzero((angle <= wide + limit + STEP) & (part["own"].to_numpy()[:, None] != name))
                    yield pd.DataFrame({"component": name[j], "node": part["node"].to_numpy()[i],
                                        "unit": part["unit"].to_numpy()[i], "angle": angle[i, j]})

        found = outside.mapInPandas(reach, placed)
        near = found if near is None else near.union(found)

    def blocks(rows: DataFrame, side: str) -> DataFrame:
        """Rows of a crowd in blocks, near in angle because they share a step of it."""
        held = Window.partitionBy("component", "ring").orderBy("node")
        cut = rows.withColumn("ring", F.floor("angle").cast("long")).withColumn(
            "block", F.floor((F.row_number().over(held) - 1) / CROWD_BLOCK))
        return cut.groupBy("component", "ring", "block").agg(F.collect_list(F.struct("node", "unit")).alias(side)).select(
            "component", F.col("ring").alias(f"{side}_ring"), side)

    both = blocks(cut_lineage(near), "x").join(blocks(members, "y"), "component").filter(
        F.abs(F.col("x_ring") - F.col("y_ring")) <= math.ceil(limit) + 1)

    def compared(batches):
        for b in batches:
            for xs, ys in zip(b["x"], b["y"]):
                sims = units([r["unit"] for r in xs]) @ units([r["unit"] for r in ys]).T
                best = sims.argmax(axis=1)
                hit = np.nonzero(sims[np.arange(len(xs)), best] >= threshold)[0]
                yield pd.DataFrame({"a": [xs[i]["node"] for i in hit], "b": [ys[best[i]]["node"] for i in hit]}, dtype="int64")

    return both.select("x", "y").mapInPandas(compared, "a long, b long").distinct()


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """node and the weight it is linked with, for members (node, component, weight, unit) of
    components with saturated lists."""
    limit = math.degrees(math.acos(threshold))
    pivots = members.filter("node = component").select("component", F.col("unit").alias("pivot"))

    def angles(batches):
        for b in batches:
            x, p = units(b["unit"]), units(b["pivot"])
            # from the chord, which is exact for small angles too
            angle = np.degrees(2 * np.arcsin(np.minimum(1.0, np.linalg.norm(x - p, axis=1) / 2)))
            yield pd.DataFrame({"node": b["node"], "component": b["component"], "weight": b["weight"], "unit": b["unit"], "angle": angle})

    placed = cut_lineage(
        members.join(pivots, "component").select("node", "component", "weight", "unit", "pivot")
        .mapInPandas(angles, "node long, component long, weight long, unit binary, angle double")
        .withColumn("bin", F.floor(F.col("angle") / STEP).cast("long"))
        .withColumn("sure", F.floor((F.lit(limit - CLOSE) - F.col("angle")) / STEP).cast("long") - 1))
    # weight at angles up to `sure`: bins and questions in one order, at most 180 / STEP of each
    bins = placed.groupBy("component", "bin").agg(F.sum("weight").alias("w"))
    asked = placed.select("component", F.col("sure").alias("bin"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("asks")).distinct()
    order = Window.partitionBy("component").orderBy("bin").rangeBetween(Window.unboundedPreceding, 0)
    upto = (bins.withColumn("asks", F.lit(False)).union(asked).withColumn("upto", F.sum("w").over(order))
            .filter("asks").select("component", F.col("bin").alias("sure"), "upto"))
    counted = placed.join(upto, ["component", "sure"]).select(
        "node", (F.col("upto") - F.when(F.col("bin") <= F.col("sure"), F.col("weight")).otherwise(0)).alias("linked"))

    widest = placed.groupBy("component").agg(F.max("bin").alias("widest"))
    x = placed.join(widest, "component").filter("widest > sure").select(
        "component", F.col("node").alias("x"), F.col("unit").alias("x_unit"), F.col("angle").alias("x_angle"), F.col("sure").alias("x_sure"))
    y = placed.select("component", "node", "weight", "unit", "angle", "bin")
    between = x.join(y, (x.component == y.component) & (y.bin > x.x_sure) & (F.abs(y.angle - x.x_angle) <= limit + CLOSE)
                     & (y.node != x.x)).select("x", "x_unit", "unit", "weight")

    def compared(batches):
        for b in batches:
            ok = (units(b["x_unit"]) * units(b["unit"])).sum(1) >= threshold
            yield b.loc[ok].groupby("x", as_index=False)["weight"].sum().rename(columns={"x": "node", "weight": "linked"})

    exact = between.mapInPandas(compared, "node long, linked long")
    return counted.union(exact).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row, then the audited recall."""
    members, classes = classes_of(embeddings)
    most = max(neighbours, MOST_LINKS)
    lists, recall = neighbour_lists(classes, threshold, neighbours, most)
    near = lists.filter(F.col("sim") >= threshold)
    links = cut_lineage(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    components = cut_lineage(connected_components(links, "a", "b"))
    full = full_nodes(lists, threshold, most)
    crowds = cut_lineage(components.join(full, "node", "left_semi").select("component").distinct())
    if not crowds.isEmpty():
        across = cut_lineage(crowd_links(classes, components, crowds, threshold))
        components = cut_lineage(connected_components(links.union(across), "a", "b"))
    long_lists = full_nodes(lists, threshold, neighbours)
    dense = cut_lineage(components.join(long_lists, "node", "left_semi").select("component").distinct())
    weights = classes.select("node", "weight")
    inside = components.join(dense, "component", "left_semi").join(classes, "node").select("node", "component", "weight", "unit")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
    outside = (both.join(components, "node").join(dense, "component", "left_anti")
               .join(weights.toDF("other", "w"), "other").groupBy("node").agg(F.sum("w").alias("linked")))
    linked = dense_links(inside, threshold).union(outside)
    per_class = weights.join(linked, "node", "left").join(components, "node", "left").select(
        "node", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("root"))
    known = members.join(per_class, "node").select(F.col("vec_id").alias("m_id"), "n", "root").groupBy("m_id").agg(
        F.max("n").alias("n"), F.min("root").alias("root"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    return rows.join(known, F.col("vec_id") == F.col("m_id"), "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("root", "vec_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))
