"""Layouts in the plane by rounds of forces, with far nodes taken together by cells of a hierarchy of grids."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.plans.fixpoint import Rounds, cut


def scattered(g: Graph, salt: int = 0) -> DataFrame:
    """(id, x, y): nodes at drawn places of a square whose side is the root of their number."""
    side = math.sqrt(max(1, g.nodes.count()))
    return g.nodes.select("id", (uniform(f"x{salt}", "id") * side).alias("x"), (uniform(f"y{salt}", "id") * side).alias("y"))


def repulsion(pos: DataFrame, q: float = 0.0, occupancy: int = 4) -> DataFrame:
    """(id, fx, fy): the sum over all other nodes j of (p - p_j) / |p - p_j| ** (q + 2), far nodes by the centres of their cells.

    Level l cuts the box of all nodes into 2^l x 2^l cells. At each level a node meets the cells inside its parent cell's neighbourhood
    that don't touch its own cell, at most 27; what touches it is left to the next level, and at the last one to the nodes
    themselves. A cell's list of such cells is made once for all its nodes. Levels follow from the number of nodes, so that last cells hold about
    `occupancy` nodes where nodes are spread evenly.
    """
    box = pos.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count(F.lit(1)).alias("n")).first()
    if not box.n:
        return pos.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    side = (box.side or 1.0) * (1 + 1e-9)
    last = max(1, math.ceil(math.log(max(1.0, box.n / occupancy), 4)))

    def cell(level, c, low):
        return F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(side) * F.pow(F.lit(2.0), level)), F.pow(F.lit(2.0), level) - 1).cast("long")

    at = pos.select("id", "x", "y", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("l"))
    at = at.withColumns({"cx": cell(F.col("l"), "x", box.x), "cy": cell(F.col("l"), "y", box.y)})
    cells = cut(at.groupBy("l", "cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")))
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("s")
    # children of the parent's neighbours, less those that touch the cell
    parents = cells.select("l", "cx", "cy", F.expr("cx div 2").alias("px"), F.expr("cy div 2").alias("py"))
    around = parents.select("l", "cx", "cy", "px", "py", shift).select("l", "cx", "cy", (F.col("px") + F.col("s.dx")).alias("px"), (F.col("py") + F.col("s.dy")).alias("py"))
    others = cells.select("l", F.expr("cx div 2").alias("px"), F.expr("cy div 2").alias("py"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), "n", "mx", "my")
    apart = (F.abs(F.col("cx") - F.col("ox")) > 1) | (F.abs(F.col("cy") - F.col("oy")) > 1)
    far = around.join(others, ["l", "px", "py"]).where(apart).groupBy("l", "cx", "cy").agg(F.collect_list(F.struct("n", "mx", "my")).alias("far"))  # at most 27

    def pull(c, m):
        d2 = lambda o: F.pow(F.col("x") - o["mx"], F.lit(2)) + F.pow(F.col("y") - o["my"], F.lit(2))
        return F.aggregate("far", F.lit(0.0), lambda acc, o: acc + o["n"] * (F.col(c) - o[m]) / F.pow(d2(o), F.lit((q + 2) / 2)))

    distant = at.join(far, ["l", "cx", "cy"]).select("id", pull("x", "mx").alias("fx"), pull("y", "my").alias("fy"))
    low = at.where(F.col("l") == last).select("id", "x", "y", "cx", "cy")
    near = low.select("id", "x", "y", "cx", "cy", shift).select("id", "x", "y", (F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    near = near.join(low.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy"), ["cx", "cy"]).where("id <> o")
    d2 = F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("y") - F.col("oy"), F.lit(2))
    push = [F.when(d2 > 0, (F.col(c) - F.col("o" + c)) / F.pow(d2, F.lit((q + 2) / 2))).otherwise(0.0).alias(f"f{c}") for c in ("x", "y")]
    both = distant.union(near.select("id", *push)).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    return pos.select("id").join(both, "id", "left").fillna(0.0, ["fx", "fy"])


def exact_repulsion(pos: DataFrame, block: int = 1024) -> DataFrame:
    """(id, fx, fy): the sum over all other nodes j of (p - p_j) / |p - p_j|^2, every pair tried, a pair of blocks of about `block` nodes at a time.

    A block is sent once to each other one, so n / block copies of the nodes are shuffled, and a task holds no more than two blocks' pairs.
    """
    k = max(1, math.ceil(pos.count() / block))
    tasks = max(k, int(pos.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = pos.select("id", "x", "y", F.pmod(F.xxhash64("id"), F.lit(k)).alias("block"))
    packs = cut(dealt.groupBy("block").agg(F.collect_list(F.struct("id", "x", "y")).alias("p")).select("block", *(F.col(f"p.{c}").alias(c) for c in ("id", "x", "y"))))
    asked = packs.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))).repartition(tasks, "other")
    others = packs.select(F.col("block").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, y, ox, oy = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(5))
                dx, dy = x[:, None] - ox, y[:, None] - oy
                d2 = dx * dx + dy * dy
                d2[d2 == 0] = np.inf  # the node itself
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((dx / d2).sum(1)), pa.array((dy / d2).sum(1))], names=["id", "fx", "fy"])

    parts = asked.join(others, "other").select("id", "x", "y", "ox", "oy").mapInArrow(run, "id long, fx double, fy double")
    return parts.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def stress(g: Graph, pos: DataFrame) -> DataFrame:
    """One row: the sum over edges of (distance - 1) squared."""
    a, b = (pos.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")) for c in ("src", "dst"))
    d = F.sqrt(F.pow(F.col("xsrc") - F.col("xdst"), F.lit(2)) + F.pow(F.col("ysrc") - F.col("ydst"), F.lit(2)))
    return g.without_loops().edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum(F.pow(d - 1, F.lit(2))), F.lit(0.0)).alias("stress"))


def maxent_stress(g: Graph, sweeps: int = 5, alphas: tuple[float, ...] = (1.0, 0.3, 0.09, 0.027, 0.008), q: float = 0.0, salt: int = 0, history: list | None = None) -> DataFrame:
    """(id, x, y): edges drawn towards length one, all nodes apart: local stress with an entropy whose weight alpha falls in phases of `sweeps` rounds.

    A round sets each node to the mean of the places that its neighbours ask for, plus alpha times the repulsion over its degree. Nodes without
    edges keep their drawn place. history receives the stress after each phase.
    """
    loop = Rounds(g.nodes.sparkSession, "layout")
    arcs = loop.put("arcs", g.without_loops().both().select("src", "dst").distinct())
    deg = loop.put("deg", arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("rho")))
    pos = loop.put("pos", scattered(g, salt))
    for alpha in alphas:
        for _ in range(sweeps):
            a, b = (pos.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")) for c in ("src", "dst"))
            d = F.sqrt(F.pow(F.col("xsrc") - F.col("xdst"), F.lit(2)) + F.pow(F.col("ysrc") - F.col("ydst"), F.lit(2)))
            ask = [F.sum(F.col(f"{c}dst") + F.when(d > 0, (F.col(f"{c}src") - F.col(f"{c}dst")) / d).otherwise(0.0)).alias(f"s{c}") for c in ("x", "y")]
            asked = arcs.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(*ask)
            moved = pos.join(deg, "id", "left").join(asked, "id", "left").join(repulsion(pos, q), "id")
            new = [F.coalesce((F.col(f"s{c}") + alpha * F.col(f"f{c}")) / F.col("rho"), F.col(c)).alias(c) for c in ("x", "y")]
            pos = loop.put("pos", moved.select("id", *new))
        if history is not None:
            history.append(stress(g, pos).first()[0])
    out = cut(pos)
    loop.close()
    return out


def fruchterman_reingold(g: Graph, rounds: int = 20, salt: int = 0) -> DataFrame:
    """(id, x, y): springs along edges, repulsion between all nodes, and steps that shrink from a tenth of the side to nothing."""
    loop = Rounds(g.nodes.sparkSession, "layout")
    arcs = loop.put("arcs", g.without_loops().both().select("src", "dst").distinct())
    pos = loop.put("pos", scattered(g, salt))
    side = math.sqrt(max(1, g.nodes.count()))
    for i in range(rounds):
        heat = side / 10 * (1 - i / rounds)
        a, b = (pos.select(F.col("id").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")) for c in ("src", "dst"))
        d = F.sqrt(F.pow(F.col("xsrc") - F.col("xdst"), F.lit(2)) + F.pow(F.col("ysrc") - F.col("ydst"), F.lit(2)))
        drawn = arcs.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(*[F.sum((F.col(f"{c}dst") - F.col(f"{c}src")) * d).alias(f"s{c}") for c in ("x", "y")])
        force = pos.join(drawn, "id", "left").join(repulsion(pos), "id").select("id", "x", "y", *[(F.coalesce(f"s{c}", F.lit(0.0)) + F.col(f"f{c}")).alias(f"t{c}") for c in ("x", "y")])
        size = F.sqrt(F.pow("tx", F.lit(2)) + F.pow("ty", F.lit(2)))
        step = F.when(size > 0, F.least(size, F.lit(heat)) / size).otherwise(0.0)
        pos = loop.put("pos", force.select("id", *[(F.col(c) + F.col(f"t{c}") * step).alias(c) for c in ("x", "y")]))
    out = cut(pos)
    loop.close()
    return out
