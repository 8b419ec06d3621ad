"""Evolving graphs: event tables (seq, step, type, u, v, w) and what folds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import uniform
from graphloom.graph import Graph
from graphloom.plans.fixpoint import cut

#: The event types of the data model.
TYPES = ("NODE_ADDITION", "NODE_REMOVAL", "NODE_RESTORATION", "EDGE_ADDITION", "EDGE_REMOVAL", "EDGE_WEIGHT_UPDATE", "EDGE_WEIGHT_INCREMENT", "TIME_STEP")


def fold_edges(events: DataFrame) -> DataFrame:
    """(u, v, w): edges alive after all events. What counts is the last event that sets or removes an edge, and the increments after it."""
    e = events.where(F.col("type").startswith("EDGE")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "seq", "type", F.coalesce("w", F.lit(1.0)).alias("w"))
    setting = F.when(F.col("type") != "EDGE_WEIGHT_INCREMENT", F.col("seq"))
    last = e.groupBy("u", "v").agg(F.max(setting).alias("at"), F.max_by("type", setting).alias("type"), F.max_by("w", setting).alias("w"))
    more = e.where("type = 'EDGE_WEIGHT_INCREMENT'").join(last.select("u", "v", "at"), ["u", "v"]).where("at is null or seq > at").groupBy("u", "v").agg(F.sum("w").alias("more"))
    return last.join(more, ["u", "v"], "left").where("coalesce(type, '') <> 'EDGE_REMOVAL'").select("u", "v", (F.coalesce(F.when(F.col("type").isNotNull(), F.col("w")), F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("w"))


def fold_nodes(events: DataFrame) -> DataFrame:
    n = events.where(F.col("type").startswith("NODE")).groupBy(F.col("u").alias("id")).agg(F.max_by("type", "seq").alias("type"))
    return n.where("type <> 'NODE_REMOVAL'").select("id")


def graph_from_events(events: DataFrame) -> Graph:
    e = fold_edges(events).select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    nodes = fold_nodes(events).union(e.select(F.explode(F.array("src", "dst")))).distinct()
    return Graph.from_edges(e, nodes)


def size_timeline(events: DataFrame) -> DataFrame:
    """(step, m): edges alive at the end of each step."""
    e = events.where("type in ('EDGE_ADDITION', 'EDGE_REMOVAL')").select("step", "seq", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.expr("cast(type = 'EDGE_ADDITION' as int)").alias("on"))
    was = F.coalesce(F.lag("on").over(Window.partitionBy("u", "v").orderBy("seq")), F.lit(0))
    change = e.select("step", (F.col("on") - was).alias("d")).groupBy("step").agg(F.sum("d").alias("d"))
    return change.select("step", F.sum("d").over(Window.orderBy("step")).alias("m"))  # a row for each step


def difference(before: Graph, after: Graph) -> DataFrame:
    """Events that turn one graph into the other."""
    a, b = before.edges.withColumnRenamed("w", "x"), after.edges.withColumnRenamed("w", "y")
    e = a.join(b, ["src", "dst"], "full").where("not x <=> y")
    kind = F.when(F.col("x").isNull(), "EDGE_ADDITION").when(F.col("y").isNull(), "EDGE_REMOVAL").otherwise("EDGE_WEIGHT_UPDATE")
    return e.select(kind.alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), F.col("y").alias("w"))


def path_events(spark: SparkSession, n: int) -> DataFrame:
    """A path grown by one node a step."""
    r = spark.range(n)
    parts = F.array(F.struct(F.lit(0).alias("o"), F.lit("NODE_ADDITION").alias("type"), F.col("id").alias("u"), F.lit(None).cast("long").alias("v")), F.struct(F.lit(1).alias("o"), F.lit("EDGE_ADDITION").alias("type"), (F.col("id") - 1).alias("u"), F.col("id").alias("v")), F.struct(F.lit(2).alias("o"), F.lit("TIME_STEP").alias("type"), F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v")))
    return r.select(F.col("id").alias("step"), F.explode(parts).alias("e")).where("e.type <> 'EDGE_ADDITION' or step > 0").select((F.col("step") * 3 + F.col("e.o")).alias("seq"), "step", "e.type", "e.u", "e.v", F.lit(1.0).alias("w"))


def growth_events(g: Graph) -> DataFrame:
    """The growth of a graph by node id: a step adds a node and its edges to earlier ones."""
    nodes = g.nodes.select(F.col("id").alias("step"), F.lit(0).alias("o"), F.lit("NODE_ADDITION").alias("type"), F.col("id").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("w"))
    edges = g.edges.select(F.col("dst").alias("step"), F.lit(1).alias("o"), F.lit("EDGE_ADDITION").alias("type"), F.col("src").alias("u"), F.col("dst").alias("v"), "w")
    order = Window.partitionBy("step").orderBy("o", "u")
    return nodes.union(edges).select((F.col("step") * (1 << 24) + F.row_number().over(order)).alias("seq"), "step", "type", "u", "v", "w")


def seir(g: Graph, starts: DataFrame, steps: int, chance: float = 0.5, exposed: int = 2, infectious: int = 7, salt: int = 0) -> DataFrame:
    """(step, state, nodes): a census of susceptible, exposed, infectious and removed nodes; all nodes change at once in a step."""
    arcs = cut(g.both().where("src <> dst").select("src", "dst"))
    x = cut(g.nodes.join(starts.select("id", F.lit(1).alias("hit")), "id", "left").select("id", F.when(F.col("hit").isNotNull(), "I").otherwise("S").alias("state"), F.lit(0).alias("since")))
    out = None
    for t in range(steps + 1):
        census = x.groupBy("state").agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(t).alias("step"), "state", "nodes")
        out = census if out is None else out.union(census)
        if t == steps:
            return out
        caught = x.where("state = 'I'").select(F.col("id").alias("src")).join(arcs, "src").where(uniform(f"seir{salt}:{t}", "src", "dst") < chance).select(F.col("dst").alias("id"), F.lit(1).alias("hit")).distinct()
        s, age = F.col("state"), t + 1 - F.col("since")
        new = F.when((s == "S") & F.col("hit").isNotNull(), "E").when((s == "E") & (age >= exposed), "I").when((s == "I") & (age >= infectious), "R").otherwise(s)
        x = cut(x.join(caught, "id", "left").select("id", new.alias("state"), F.when(new != s, t + 1).otherwise(F.col("since")).alias("since")))
