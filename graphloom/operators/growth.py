"""Graphs that grow and change by a random rule, as events (seq, step, type, u, v, w)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph, numbered
from graphloom.operators.dynamic import difference
from graphloom.operators.generators import near_links, scattered_points
from graphloom.plans.fixpoint import Rounds, cut


def _events(parts: list[DataFrame]) -> DataFrame:
    """Events of (step, o, type, u, v, w), numbered in the order of step, o and ends."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return numbered(every, ["step", "o", "u", "v"], "seq").select("seq", "step", "type", "u", "v", "w")


def _nodes(ids: DataFrame, kind: str, step, o: int) -> DataFrame:
    return ids.select(step.cast("long").alias("step"), F.lit(o).alias("o"), F.lit(kind).alias("type"), F.col("id").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("w"))


def batches(present: int, arriving: int, share: float) -> list[int]:
    """Sizes of the steps in which nodes arrive: a share of those present, at least one."""
    out = []
    while arriving:
        out.append(min(arriving, max(1, int(present * share))))
        present, arriving = present + out[-1], arriving - out[-1]
    return out


def burn(arcs: DataFrame, starts: DataFrame, p: float, backward: float = 0.0, salt: int = 0) -> DataFrame:
    """(fire, id): the nodes that each fire of starts (fire, id) burns.

    A burning node sets fire to a geometric number of those neighbours that the fire has not reached, drawn without repetition: with mean
    p / (1 - p) along arcs (src, dst, way) of way 0, and with p times backward in p's place along those of way 1. All fires burn side by side,
    a wave at a time, and end when they die out.
    """
    loop = Rounds(arcs.sparkSession, "fires")
    front = burnt = loop.put("burnt", starts.select("fire", "id"))
    chance = F.when(F.col("way") == 0, F.lit(p)).otherwise(F.lit(p * backward))
    while not front.isEmpty():
        unreached = front.join(arcs.withColumnRenamed("src", "id"), "id").select("fire", F.col("id").alias("by"), F.col("dst").alias("id"), "way").join(burnt, ["fire", "id"], "left_anti")
        order = Window.partitionBy("fire", "by", "way").orderBy(uniform(f"burn{salt}", "fire", "by", "id"), "id")
        most = F.when(chance > 0, F.floor(F.log(1 - uniform(f"many{salt}", "fire", "by", "way")) / F.log(chance))).otherwise(0)
        picked = unreached.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
        front = loop.put("front", picked.select("fire", "id").distinct())
        burnt = loop.put("burnt", burnt.union(front))
    out = cut(burnt)
    loop.close()
    return out


def forest_fire_growth(g: Graph, arrivals: DataFrame, p: float, directed: bool = False, backward: float = 1.0, share: float = 0.1, salt: int = 0) -> DataFrame:
    """Events of the nodes (id) that join g in the order of their ids: each lights a fire at a node drawn from those present and links to all that burns.

    Nodes arrive in steps of a share of those present, and all of a step burn through the graph as it was when the step began, so the number of
    steps grows with the logarithm of the growth; a share of 0 is one node a step. In a directed graph a fire goes along arcs with p and
    against them with p * backward; otherwise backward is not used. Arrivals must not be nodes of g, which needs a node.
    """
    if not 0 <= p < 1 or not 0 <= p * backward < 1:
        raise ValueError("burning chances must lie in [0, 1)")
    old = numbered(g.nodes.select("id"), ["id"], "at")
    present = old.count()
    if not present:
        raise ValueError("the first fire needs a node")
    new = numbered(arrivals.select("id").distinct(), ["id"], "at").withColumn("at", F.col("at") + present)
    loop = Rounds(g.nodes.sparkSession, "growth")
    places = cut(old.union(new.select("id", "at")))
    first = g.edges.where("src <> dst").select("src", "dst")
    links, events = loop.put("links", first), []
    for step, size in enumerate(batches(present, places.count() - present, share)):
        arcs = links.select("src", "dst", F.lit(0).alias("way")).union(links.select(F.col("dst"), F.col("src"), F.lit(int(directed)).alias("way"))).distinct()
        joins = places.where((F.col("at") >= present) & (F.col("at") < present + size))
        draws = joins.select(F.col("id").alias("fire"), F.floor(uniform(f"ambassador{salt}", "id") * present).cast("long").alias("at"))
        burnt = burn(loop.put("arcs", arcs), draws.join(places.where(F.col("at") < present), "at").select("fire", "id"), p, backward, salt)
        at = F.lit(step)
        events += [_nodes(joins, "NODE_ADDITION", at, 0), burnt.select(at.cast("long").alias("step"), F.lit(1).alias("o"), F.lit("EDGE_ADDITION").alias("type"), F.col("fire").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("w"))]
        links, present = loop.put("links", links.union(burnt.select(F.col("fire"), F.col("id")))), present + size
    out = _events(events or [_nodes(places.where("false"), "NODE_ADDITION", F.lit(0), 0)])
    loop.close()
    return out


def pub_web_churn(points: DataFrame, steps: int, centers: int, spread: float, radius: float, most: int, share: float = 0.05, salt: int = 0) -> DataFrame:
    """Events of a web of points (id, x, y) on the unit torus, of which a share leaves in each step while as many new ones come.

    Step 0 adds the nodes and links that are there. Those that leave are drawn without repetition. New points fall, with equal chances, within spread
    of one of the centres or anywhere. Two points are linked when each is among the other's most nearest within radius, with a weight of 0.01 over the
    squared distance. A step's events are the links and nodes that go, the nodes that come, and the links that come or change their weight.
    """
    pts = cut(points.select("id", "x", "y"))
    web = cut(near_links(pts, radius, most))
    zero = F.lit(0)
    events = [_nodes(pts, "NODE_ADDITION", zero, 2), web.select(zero.cast("long").alias("step"), F.lit(3).alias("o"), F.lit("EDGE_ADDITION").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), "w")]
    number, fresh = pts.agg(F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(-1)) + 1).first()
    moving = int(number * share)
    for step in range(1, steps + 1):
        dealt = cut(numbered(pts.withColumn("draw", uniform(f"leave{salt}:{step}", "id")), ["draw", "id"], "rank"))
        left = dealt.where(F.col("rank") < moving).select("id")
        come = scattered_points(pts.sparkSession.range(fresh, fresh + moving), centers, spread, salt)
        after = cut(dealt.where(F.col("rank") >= moving).select("id", "x", "y").union(come))
        new = cut(near_links(after, radius, most))
        change = difference(Graph(pts.select("id"), web, False), Graph(after.select("id"), new, False))
        at = F.lit(step)
        order = F.when(F.col("type") == "EDGE_REMOVAL", 0).otherwise(3)
        events += [_nodes(left, "NODE_REMOVAL", at, 1), _nodes(come, "NODE_ADDITION", at, 2), change.select(at.cast("long").alias("step"), order.alias("o"), "type", "u", "v", "w")]
        pts, web, fresh = after, new, fresh + moving
    return _events(events)
