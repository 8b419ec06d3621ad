"""Graphs that the tables imply, as plans and as SQL."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import Graph


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"))


#: Order lines to a partition, about.
DEALT = 250_000


def _dealt(lines: DataFrame) -> int:
    """Partitions for the lines of orders and for their pairs: they grow with the table, so what a task holds does not."""
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(lines.count() / DEALT))


def co_orders(spark: SparkSession, d: str, least: int = 1) -> Graph:
    """Parts linked by the number of orders that hold both, where that is at least `least`.

    Lines are sent once, by order; pairs hardly repeat within a task, so they are sent as they are and counted where they arrive.
    """
    lines = table(spark, d, "lineitem")
    n = _dealt(lines)
    op = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).repartition(n, "o").distinct()
    pairs = op.join(op.withColumnRenamed("p", "q"), "o").where("p < q").select(F.col("p").alias("src"), F.col("q").alias("dst"))
    e = pairs.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return Graph.from_edges(e.where(F.col("w") >= least), parts(spark, d))


def suppliers(spark: SparkSession, d: str, over: float = 1.2) -> Graph:
    """Suppliers linked by the number of orders that both deliver to, where it exceeds the mean of all linked pairs by a factor."""
    os = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    e = os.join(os.withColumnRenamed("s", "t"), "o").where("s < t").groupBy(F.col("s").alias("src"), F.col("t").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    mean = e.agg(F.avg("w").alias("mean"))
    e = e.join(F.broadcast(mean)).where(F.col("w") > F.lit(over) * F.col("mean")).drop("mean")  # one row
    return Graph.from_edges(e, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


def part_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()


def sequences(spark: SparkSession, d: str, least: int = 2) -> Graph:
    """Arcs from the part of a line to that of the order's next line, seen at least `least` times."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    n = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and src <> dst")
    e = n.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")).where(F.col("w") >= least)
    return Graph.from_edges(e, parts(spark, d), directed=True)


def brands(spark: SparkSession, d: str) -> DataFrame:
    """(id, subset): parts by brand, the brand named by its least part."""
    p = table(spark, d, "part")
    names = p.groupBy("p_brand").agg(F.min("p_partkey").alias("subset"))
    return p.join(names, "p_brand").select(F.col("p_partkey").alias("id"), "subset")


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("subset"))


def visits(spark: SparkSession, d: str) -> DataFrame:
    """(seq, step, type, u, v, w): each event ties its user to the next event's; errors untie them. A step is a day."""
    e = table(spark, d, "events")
    w = Window.partitionBy("day").orderBy("event_id")
    x = e.select(F.col("event_id").alias("seq"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.col("user_id").alias("u"), "event_type", F.col("event_id"))
    x = x.select("seq", F.col("day").alias("step"), "u", F.lead("u").over(w).alias("v"), "event_type").where("v is not null and u <> v")
    return x.select("seq", "step", F.when(F.col("event_type") == "error", "EDGE_REMOVAL").otherwise("EDGE_ADDITION").alias("type"), "u", "v", F.lit(1.0).alias("w"))


_OP = {
    "op": "select distinct l_orderkey as o, l_partkey as p from lineitem",
    "pp": "select a.p as src, b.p as dst, count(*)::double as w from op a join op b on a.o = b.o and a.p < b.p group by 1, 2",
}
_SQ = "select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem"
_EDGES = {
    "pp": _OP | {"e": "select * from pp"},
    "pp2": _OP | {"e": "select * from pp where w >= 2"},
    "ss": {
        "os": "select distinct l_orderkey as o, l_suppkey as s from lineitem",
        "sp": "select a.s as src, b.s as dst, count(*)::double as w from os a join os b on a.o = b.o and a.s < b.s group by 1, 2",
        "e": "select src, dst, w from sp where w > 1.2 * (select avg(w) from sp)",
        "nodes": "select s_suppkey as id from supplier",
    },
    "seq": {"sq": _SQ, "e": "select src, dst, count(*)::double as w from sq where dst is not null and src <> dst group by 1, 2 having count(*) >= 2"},
    "visits": {
        "vx": "select event_id as seq, (ts::date - date '1970-01-01')::bigint as step, user_id as u, lead(user_id) over (partition by ts::date order by event_id) as v, event_type from events",
        "ev": "select seq, step, case when event_type = 'error' then 'EDGE_REMOVAL' else 'EDGE_ADDITION' end as type, u, v, least(u, v) as a, greatest(u, v) as b from vx where v is not null and u <> v",
    },
}
_COMMON = {
    "nodes": "select p_partkey as id from part",
    "bo": "select src, dst, w from e union all select dst, src, w from e",
    "deg": "select id, count(dst) as deg, coalesce(sum(w), 0.0) as wdeg from nodes left join bo on src = id group by id",
    "br": "select p_partkey as id, min(p_partkey) over (partition by p_brand) as subset from part",
    "sz": "select p_partkey as id, p_size::bigint as subset from part",
}


def sql(graph: str, body: str, recursive: bool = False) -> str:
    """A query over e, nodes, bo (both directions), deg, br and sz (partitions), of graph pp, pp2 (at least two orders), ss (suppliers) or seq; only what it names is defined, and computed once."""
    tables = _EDGES[graph] | ({t: q for t, q in _COMMON.items() if t not in _EDGES[graph]} if graph != "visits" else {})
    used, texts = set(), [body]
    while texts:
        found = {t for t in tables if re.search(rf"\b{t}\b", texts[-1])} - used
        texts.pop()
        used |= found
        texts += [tables[t] for t in found]
    head = ", ".join(f"{t} as materialized ({q})" for t, q in tables.items() if t in used)
    rest = body.lstrip()
    if not head:
        return f"with {'recursive ' if recursive else ''}{rest.lstrip(', ')}" if rest.startswith(",") else rest
    return f"with {'recursive ' if recursive else ''}{head}{body}"
