"""A graph as two DataFrames: nodes (id) and edges (src, dst, w).

Undirected edges are one row each with src <= dst; a self loop is one row. All methods are plans; none
collects.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.hashrand import uniform
from graphloom.plans.fixpoint import cut


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, nodes: DataFrame | None = None, directed: bool = False) -> Graph:
        """Normal form: longs, weight 1 unless given, src <= dst where undirected, ends as nodes."""
        w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
        e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("w"))
        if not directed:
            e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
        if nodes is None:
            nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return Graph(nodes.select(F.col("id").cast("long").alias("id")), e, directed)

    def cut(self) -> Graph:
        return replace(self, nodes=cut(self.nodes), edges=cut(self.edges))

    def both(self) -> DataFrame:
        """(src, dst, w) in either direction; loops once; arcs as they are where directed."""
        if self.directed:
            return self.edges.select("src", "dst", "w")
        e = self.edges.select("src", "dst", "w")
        return e.union(e.where("src <> dst").select("dst", "src", "w"))

    # -- sizes and degrees
    def degrees(self) -> DataFrame:
        """(id, deg, wdeg, vol): neighbours, their weight, and the weight with loops twice; 0 for isolated nodes."""
        d = self.both().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"), F.sum("w").alias("wdeg"), F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w"))).alias("vol"))
        return self.nodes.join(d, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("deg", "wdeg", "vol")])

    def in_degrees(self) -> DataFrame:
        d = self.transpose().both().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
        return self.nodes.join(d, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))

    def isolated(self) -> DataFrame:
        return self.nodes.join(self.both().select(F.col("src").alias("id")).union(self.both().select("dst")).distinct(), "id", "left_anti")

    def summary(self) -> DataFrame:
        """One row: n, m, loops, weight, density (without loops)."""
        e = self.edges.agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum(F.expr("cast(src = dst as bigint)")), F.lit(0)).alias("loops"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("weight"))
        n = self.nodes.agg(F.count(F.lit(1)).alias("n"))
        pairs = F.col("n") * (F.col("n") - 1) / (1 if self.directed else 2)
        return n.join(e).select("n", "m", "loops", "weight", F.when(F.col("n") > 1, (F.col("m") - F.col("loops")) / pairs).otherwise(0.0).alias("density"))

    # -- changes of shape
    def subgraph(self, ids: DataFrame) -> Graph:
        keep = ids.select("id")
        e = self.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, nodes=self.nodes.join(keep, "id", "left_semi"), edges=e.select("src", "dst", "w"))

    def transpose(self) -> Graph:
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")) if self.directed else self

    def to_undirected(self) -> Graph:
        """Arcs lose their direction; parallel ones add up."""
        e = Graph.from_edges(self.edges, self.nodes)
        return replace(e, edges=e.edges.groupBy("src", "dst").agg(F.sum("w").alias("w")))

    def unweighted(self) -> Graph:
        return replace(self, edges=self.edges.select("src", "dst", F.lit(1.0).alias("w")))

    def without_loops(self) -> Graph:
        return replace(self, edges=self.edges.where("src <> dst"))

    def merge(self, other: Graph) -> Graph:
        """Union of nodes and of edges; an edge of both keeps this graph's weight."""
        e = self.edges.withColumn("o", F.lit(0)).union(other.edges.withColumn("o", F.lit(1)))
        return replace(self, nodes=self.nodes.union(other.nodes).distinct(), edges=e.groupBy("src", "dst").agg(F.min_by("w", "o").alias("w")))

    def append(self, other: Graph) -> Graph:
        """Disjoint union: the other's ids are moved past this graph's largest."""
        by = self.nodes.agg(F.coalesce(F.max("id"), F.lit(-1)) + 1).first()[0]
        return replace(self, nodes=self.nodes.union(other.nodes.select(F.col("id") + by)), edges=self.edges.union(other.edges.select(F.col("src") + by, F.col("dst") + by, "w")))

    def remove_nodes(self, ids: DataFrame) -> Graph:
        return self.subgraph(self.nodes.join(ids.select("id"), "id", "left_anti"))

    def upsert_edges(self, changed: DataFrame, add: bool = False) -> Graph:
        """Set the weight of the edges in changed (src, dst, w), or add to it; absent ones are new."""
        c = Graph.from_edges(changed, directed=self.directed).edges.withColumnRenamed("w", "n")
        w = F.coalesce(F.col("w"), F.lit(0.0)) + F.coalesce(F.col("n"), F.lit(0.0)) if add else F.coalesce("n", "w")
        return replace(self, edges=self.edges.join(c, ["src", "dst"], "full").select("src", "dst", w.alias("w")))

    def remove_edges(self, gone: DataFrame) -> Graph:
        g = Graph.from_edges(gone, directed=self.directed).edges
        return replace(self, edges=self.edges.join(g, ["src", "dst"], "left_anti"))

    def swap_edges(self, pairs: DataFrame) -> Graph:
        """Each row (s1, t1, s2, t2) of pairs turns these two edges into (s1, t2) and (s2, t1)."""
        old = pairs.select(F.explode(F.array(F.struct(F.col("s1").alias("src"), F.col("t1").alias("dst")), F.struct(F.col("s2").alias("src"), F.col("t2").alias("dst")))).alias("e")).select("e.*")
        new = pairs.select(F.explode(F.array(F.struct(F.col("s1").alias("src"), F.col("t2").alias("dst")), F.struct(F.col("s2").alias("src"), F.col("t1").alias("dst")))).alias("e")).select("e.*")
        return replace(self, edges=self.remove_edges(old).edges.union(Graph.from_edges(new, directed=self.directed).edges))

    def index_edges(self) -> DataFrame:
        """Edges with eid, 0-based in the order of (src, dst), numbered without a global sort in one task."""
        return numbered(self.edges, ["src", "dst"], "eid")

    def compact_ids(self) -> DataFrame:
        """(id, new_id): ids without holes, in their order."""
        return numbered(self.nodes, ["id"], "new_id")

    def relabel(self, ids: DataFrame) -> Graph:
        """Rename by (id, new_id)."""
        a, b = (ids.select(F.col("id").alias(c), F.col("new_id").alias("n" + c)) for c in ("src", "dst"))
        e = self.edges.join(a, "src").join(b, "dst").select(F.col("nsrc").alias("src"), F.col("ndst").alias("dst"), "w")
        return Graph.from_edges(e, ids.select(F.col("new_id").alias("id")), self.directed)

    def contract(self, parts: DataFrame) -> Graph:
        """One node for each subset of parts (id, subset); weights add up and inner weight becomes a loop."""
        e = self.edges.join(parts.select(F.col("id").alias("src"), F.col("subset").alias("a")), "src").join(parts.select(F.col("id").alias("dst"), F.col("subset").alias("b")), "dst")
        e = Graph.from_edges(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), directed=self.directed).edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))
        return Graph(parts.select(F.col("subset").alias("id")).distinct(), e, self.directed)

    # -- tests, scans and draws
    def has_multi_edges(self) -> DataFrame:
        return self.edges.groupBy("src", "dst").count().where("count > 1")

    def neighbors(self, ids: DataFrame) -> DataFrame:
        return self.both().join(ids.select(F.col("id").alias("src")), "src", "left_semi")

    def random_nodes(self, k: int, salt: int = 0) -> DataFrame:
        return self.nodes.orderBy(uniform(f"node{salt}", "id"), "id").limit(k)

    def random_edges(self, k: int, salt: int = 0) -> DataFrame:
        """k edges by a draw, told by their places in its order, so that no task holds them all."""
        drawn = numbered(self.edges.withColumn("__u", uniform(f"edge{salt}", "src", "dst")), ["__u", "src", "dst"], "__at")
        return drawn.where(F.col("__at") < k).drop("__u", "__at")

    def random_neighbors(self, salt: int = 0) -> DataFrame:
        """(id, neighbor): one neighbour of each node that has any."""
        return self.both().groupBy(F.col("src").alias("id")).agg(F.min_by("dst", uniform(f"next{salt}", "src", "dst")).alias("neighbor"))


def numbered(df: DataFrame, keys: list[str | Column], name: str) -> DataFrame:
    """df with 0-based numbers in the order of keys: ranges are numbered on their own and moved by the sizes of those before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # a row for each partition
    before = sizes.select("__p", (F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__p").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__p", "__own", "__before")


def cumulated(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value up to and with each row in the order of keys: ranges are summed on their own and moved by the sums of those before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id()))
    # a row for each partition
    sums = dealt.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = sums.select("__p", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__own", own).join(F.broadcast(before), "__p").withColumn(name, F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")
