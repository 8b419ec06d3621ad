"""Writers of graph, partition, cover and event files. A format with one body is written by plans, in ordered parts."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph


def _lines(df: DataFrame, order: list[str], text: Column, path: str, head: list[str] = [], tail: list[str] = []) -> None:  # noqa: B006
    """Ordered lines, in part files whose names sort in order; head and tail are the first and last parts' own lines."""
    spark = df.sparkSession
    body = df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], text.alias("value")).withColumn("z", F.lit(1))
    nulls = [F.lit(None).cast(t).alias(c) for c, t in body.dtypes[: len(order)]]

    def extra(rows: list[str], z: int) -> DataFrame:
        return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string").select(*nulls, "value", F.lit(z).alias("z"), "i")

    whole = body.withColumn("i", F.lit(0))
    if head:
        whole = whole.union(extra(head, 0))
    if tail:
        whole = whole.union(extra(tail, 2))
    keys = ["z", *[f"o{i}" for i in range(len(order))], "i"]
    whole.orderBy(*keys).select("value").write.mode("overwrite").text(path)


def edge_list(g: Graph, path: str, separator: str = "\t", first: int = 0, weights: bool = False) -> None:
    parts = [(F.col("src") + first).cast("string"), (F.col("dst") + first).cast("string")] + ([F.col("w").cast("string")] if weights else [])
    _lines(g.edges, ["src", "dst"], F.concat_ws(separator, *parts), path)


def metis(g: Graph, path: str, weights: bool = False) -> None:
    if g.directed:
        raise ValueError("the format holds undirected graphs")
    n, m = g.nodes.count(), g.edges.count()
    item = F.concat_ws(" ", (F.col("dst") + 1).cast("string"), *([F.col("w").cast("string")] if weights else []))
    rows = g.both().groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", item.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    _lines(g.nodes.join(rows, "id", "left"), ["id"], F.coalesce("t", F.lit("")), path, [f"{n} {m}" + (" 1" if weights else "")])


def snap(g: Graph, path: str) -> None:
    _lines(g.edges, ["src", "dst"], F.concat_ws(" ", F.lit("a"), (F.col("src") + 1).cast("string"), (F.col("dst") + 1).cast("string")), path, [f"p {g.nodes.count()} {g.edges.count()} u u 0"])


def gml(g: Graph, path: str) -> None:
    items = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("  node [ id "), "id", F.lit(" ]")).alias("t")).union(g.edges.select(F.lit(1), "src", "dst", F.concat(F.lit("  edge [ source "), "src", F.lit(" target "), "dst", F.lit(" weight "), "w", F.lit(" ]"))))
    _lines(items, ["k", "a", "b"], F.col("t"), path, ["graph [", f"  directed {int(g.directed)}"], ["]"])


def dot(g: Graph, path: str) -> None:
    arrow = " -> " if g.directed else " -- "
    _lines(g.edges, ["src", "dst"], F.concat(F.lit("  "), "src", F.lit(arrow), "dst", F.lit(";")), path, ["digraph G {" if g.directed else "graph G {"], ["}"])


def dot_partition(g: Graph, parts: DataFrame, path: str) -> None:
    hue = F.concat(F.lit('" [style=filled, color="'), F.format_string("%.3f", F.pmod(F.xxhash64("subset"), F.lit(1000)) / 1000.0), F.lit(' 0.5 0.9"];'))
    items = parts.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit('  "'), "id", hue).alias("t")).union(g.edges.select(F.lit(1), "src", "dst", F.concat(F.lit('  "'), "src", F.lit('" -- "'), "dst", F.lit('";'))))
    _lines(items, ["k", "a", "b"], F.col("t"), path, ["graph G {"], ["}"])


def graphml(g: Graph, path: str) -> None:
    items = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit('<node id="'), "id", F.lit('"/>')).alias("t")).union(g.edges.select(F.lit(1), "src", "dst", F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('"><data key="w">'), "w", F.lit("</data></edge>"))))
    _lines(items, ["k", "a", "b"], F.col("t"), path, ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="w" for="edge" attr.name="weight" attr.type="double"/>', f'<graph edgedefault="{"directed" if g.directed else "undirected"}">'], ["</graph>", "</graphml>"])


def gexf(g: Graph, path: str) -> None:
    items = g.nodes.select(F.lit(0).alias("k"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit('<node id="'), "id", F.lit('"/>')).alias("t")).union(g.edges.select(F.lit(2), "src", "dst", F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('" weight="'), "w", F.lit('"/>'))))
    items = items.union(g.nodes.sparkSession.createDataFrame([(1, 0, 0, "</nodes><edges>")], "k int, a long, b long, t string"))
    _lines(items, ["k", "a", "b"], F.col("t"), path, ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', f'<graph defaultedgetype="{"directed" if g.directed else "undirected"}"><nodes>'], ["</edges></graph>", "</gexf>"])


def graph_tool(g: Graph, path: str, big_endian: bool = False, most: int = 5_000_000) -> None:
    """The .gt binary format is one stream: its one file is written by one task, up to `most` edges."""
    if g.edges.limit(most + 1).count() > most:
        raise ValueError(f"a .gt file of over {most} edges is not written")
    n, directed = g.nodes.agg(F.max("id")).first()[0], g.directed
    n = 0 if n is None else n + 1
    end = ">" if big_endian else "<"
    kind, width = next((k, w) for k, w, top in (("u1", 1, 1 << 8), ("u2", 2, 1 << 16), ("u4", 4, 1 << 32), ("u8", 8, 1 << 64)) if n < top)

    def build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [[batch.column(i).to_numpy() for i in range(2)] for batch in it]
        src, dst = (np.concatenate([r[i] for r in rows]) if rows else np.empty(0, np.int64) for i in range(2))
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        count = np.bincount(src, minlength=n).astype(np.int64)
        # eight bytes for a node's number of neighbours, then these
        at = 8 * np.arange(n) + width * (np.cumsum(count) - count)
        body = np.zeros(8 * n + width * len(src), np.uint8)
        put = lambda where, v, t, w: [body.__setitem__(where + i, v.astype(f"{end}{t}").view(np.uint8).reshape(-1, w)[:, i]) for i in range(w)]
        put(at, count, "u8", 8)
        put(8 * (src + 1) + width * np.arange(len(src)), dst, kind, width)
        for k in range(0, len(body), 1 << 24):
            piece = body[k : k + (1 << 24)].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["data"])

    head = bytes([0xE2, 0x9B, 0xBE, 0x20, 0x67, 0x74, 1, int(big_endian)]) + struct.pack(f"{end}Q", 0) + bytes([int(directed)]) + struct.pack(f"{end}Q", n)
    pieces = g.edges.select("src", "dst").coalesce(1).mapInArrow(build, "data binary")
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    store.create_dir(place.rpartition("/")[0])
    with store.open_output_stream(place) as f:
        f.write(head)
        for r in pieces.toLocalIterator():
            f.write(bytes(r.data))


def partition(parts: DataFrame, path: str) -> None:
    _lines(parts, ["id"], F.col("subset").cast("string"), path)


def cover(members: DataFrame, path: str) -> None:
    rows = members.groupBy("subset").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("t"))
    _lines(rows, ["subset"], F.col("t"), path)


def matrix_market(m: DataFrame, path: str) -> None:
    s = m.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.count(F.lit(1)).alias("n")).first()
    _lines(m, ["i", "j"], F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")), path, ["%%MatrixMarket matrix coordinate real general", f"{(s.i if s.i is not None else -1) + 1} {(s.j if s.j is not None else -1) + 1} {s.n}"])


def events(ev: DataFrame, path: str) -> None:
    """DGS004 text."""
    t = F.col("type")
    edge = F.concat(F.col("u").cast("string"), F.lit("-"), F.col("v").cast("string"))
    weight = F.concat(F.lit(" weight="), F.coalesce("w", F.lit(1.0)).cast("string"))
    text = (
        F.when(t == "NODE_ADDITION", F.concat(F.lit("an "), "u"))
        .when(t == "NODE_REMOVAL", F.concat(F.lit("dn "), "u"))
        .when(t == "NODE_RESTORATION", F.concat(F.lit("rn "), "u"))
        .when(t == "EDGE_ADDITION", F.concat(F.lit("ae "), edge, F.lit(" "), "u", F.lit(" "), "v", weight))
        .when(t == "EDGE_REMOVAL", F.concat(F.lit("de "), edge))
        .when(t == "EDGE_WEIGHT_UPDATE", F.concat(F.lit("ce "), edge, weight))
        .when(t == "EDGE_WEIGHT_INCREMENT", F.concat(F.lit("ie "), edge, weight))
        .otherwise(F.concat(F.lit("st "), F.col("step").cast("string")))
    )
    _lines(ev, ["seq"], text, path, ["DGS004", "graph 0 0"])


WRITERS = {"edgelist": edge_list, "metis": metis, "snap": snap, "gml": gml, "dot": dot, "graphml": graphml, "gexf": gexf, "gt": graph_tool}


def write_graph(g: Graph, path: str, format: str, **options) -> None:
    WRITERS[format](g, path, **options)


def convert(spark, source: str, source_format: str, target: str, target_format: str) -> None:
    from graphloom.sources.readers import read_graph

    write_graph(read_graph(spark, source, source_format), target, target_format)
