"""Readers of graph, partition, cover and event files. Text formats are parsed by plans over lines; binary ones in the task that holds the file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph, numbered
from graphloom.plans.fixpoint import cut

UNITS = {"\t": r"\t", " ": r"\s+", ",": ",", ";": ";"}


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(value, line): the lines of a file, or of a folder's files by name, with 0-based numbers, counted without one task reading all."""
    raw = spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("o"))
    return numbered(raw, ["f", "b", "o"], "line").select("value", "line")


def edge_list(spark: SparkSession, path: str, separator: str = "\t", first: int = 0, comment: str = "#", continuous: bool = True, directed: bool = False) -> Graph:
    """`u sep v [sep w]`; ids from first on, or (not continuous) any strings, numbered by first appearance. Of repeated edges the first counts."""
    raw = lines(spark, path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    p = F.split(F.trim("value"), UNITS.get(separator, separator))
    e = raw.select("line", p.getItem(0).alias("a"), p.getItem(1).alias("b"), F.when(F.size(p) > 2, p.getItem(2).cast("double")).otherwise(1.0).alias("w"))
    if continuous:
        e = e.select("line", (F.col("a").cast("long") - first).alias("src"), (F.col("b").cast("long") - first).alias("dst"), "w")
        top = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
        nodes = spark.range(0 if top is None else top + 1)
    else:
        seen = e.select(F.explode(F.array(F.struct((F.col("line") * 2).alias("o"), F.col("a").alias("name")), F.struct((F.col("line") * 2 + 1).alias("o"), F.col("b").alias("name")))).alias("x")).groupBy("x.name").agg(F.min("x.o").alias("o"))
        ids = numbered(seen, ["o"], "id").select("name", "id")
        e = e.join(ids.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b")
        nodes = ids.select("id")
    if not directed:
        e = e.select("line", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    e = e.groupBy("src", "dst").agg(F.min_by("w", "line").alias("w"))
    return Graph.from_edges(e, nodes, directed)


def snap(spark: SparkSession, path: str) -> Graph:
    """Tab-separated pairs with # comments; ids are numbered by first appearance."""
    return edge_list(spark, path, "\t", continuous=False)


def metis(spark: SparkSession, path: str) -> Graph:
    """`n m [fmt [ncon]]`, then a line for each node with its 1-based neighbours; fmt ending in 1 has weights, node weights are passed over."""
    body = lines(spark, path).where(~F.col("value").startswith("%"))
    body = numbered(body, ["line"], "row").select("row", F.trim("value").alias("value"))
    head = [int(x) for x in body.where("row = 0").first().value.split()]
    n, fmt, ncon = head[0], head[2] if len(head) > 2 else 0, head[3] if len(head) > 3 else (1 if len(head) > 2 and head[2] // 10 % 10 else 0)
    parts = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    e = body.where(F.col("row").between(1, n)).select((F.col("row") - 1).alias("src"), F.slice(parts, ncon + 1, 1 << 30).alias("p") if ncon else parts.alias("p"))
    if fmt % 10:
        e = e.select("src", F.posexplode("p").alias("k", "x"), "p").where("k % 2 = 0").select("src", (F.col("x").cast("long") - 1).alias("dst"), F.element_at("p", F.col("k") + 2).cast("double").alias("w"))
    else:
        e = e.select("src", F.explode("p").alias("x")).select("src", (F.col("x").cast("long") - 1).alias("dst"), F.lit(1.0).alias("w"))
    return Graph.from_edges(e.where("src <= dst"), spark.range(n))


def konect(spark: SparkSession, path: str, ignore_loops: bool = False) -> Graph:
    """`% sym|asym|bip weighting`, optional `% m n n`, then `u v [w ...]`, 1-based."""
    head = lines(spark, path).where("line = 0").first().value.split()
    directed = "asym" in head
    body = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    p = F.split(F.trim("value"), r"[\s,]+")
    weighted = not any(x in head for x in ("unweighted", "positive"))
    e = body.select((p.getItem(0).cast("long") - 1).alias("src"), (p.getItem(1).cast("long") - 1).alias("dst"), F.when(F.size(p) > 2, p.getItem(2).cast("double")).otherwise(1.0).alias("w") if weighted else F.lit(1.0).alias("w"))
    if "bip" in head:
        left = e.agg(F.max("src") + 1).first()[0] or 0
        e = e.select("src", (F.col("dst") + left).alias("dst"), "w")
    e = e.where("src <> dst") if ignore_loops else e
    top = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return Graph.from_edges(e, spark.range(0 if top is None else top + 1), directed)


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of a coordinate file, 0-based; a symmetric one is mirrored, a pattern has ones."""
    head = lines(spark, path).where("line = 0").first().value.lower().split()
    body = numbered(lines(spark, path).where(~F.col("value").startswith("%") & (F.trim("value") != "")), ["line"], "row").where("row > 0")
    p = F.split(F.trim("value"), r"\s+")
    m = body.select((p.getItem(0).cast("long") - 1).alias("i"), (p.getItem(1).cast("long") - 1).alias("j"), F.lit(1.0).alias("v") if "pattern" in head else p.getItem(2).cast("double").alias("v"))
    return m.union(m.where("i <> j").select("j", "i", "v")) if "symmetric" in head else m


def gml(spark: SparkSession, path: str) -> Graph:
    """`node [ id .. ]` and `edge [ source .. target .. ]` blocks. Files are cut at closing brackets, so a large one is many tasks' work."""
    pieces = spark.read.option("lineSep", "]").text(path)
    directed = bool(pieces.where(F.col("value").rlike(r"\bdirected\s+1\b")).limit(1).count())
    block = pieces.select(F.regexp_extract("value", r"(?s).*\b(node|edge)\s*\[", 1).alias("kind"), F.regexp_extract("value", r"(?s).*\b(?:node|edge)\s*\[(.*)", 1).alias("b"))
    number = lambda key: F.expr(f"try_cast(regexp_extract(b, '\\\\b{key}\\\\s+(-?[0-9]+)', 1) as bigint)")
    nodes = block.where("kind = 'node'").select(number("id").alias("id")).where("id is not null")
    w = F.expr("try_cast(regexp_extract(b, '\\\\b(?:weight|value)\\\\s+([-+.0-9eE]+)', 1) as double)")
    e = block.where("kind = 'edge'").select(number("source").alias("src"), number("target").alias("dst"), F.coalesce(w, F.lit(1.0)).alias("w"))
    return Graph.from_edges(e.where("src is not null and dst is not null"), nodes, directed)


def _parsed(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows of whole files, parsed where they are read."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                yield parse(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _graph_of(rows: DataFrame, directed: bool) -> Graph:
    """Rows (src, dst, w); a node alone is a row without dst."""
    return Graph.from_edges(rows.where("dst is not null"), rows.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct(), directed)


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["src", "dst", "w"]).astype({"src": "Int64", "dst": "Int64", "w": "float64"})


def _tags(spark: SparkSession, path: str) -> DataFrame:
    """(line, tag, value): a row for each piece of an XML file that ends in >, cut where the file is split, so that no task holds all of it."""
    return cut(lines(spark, path, ">").select("line", F.regexp_extract("value", r"<\s*(?:\w+:)?(/?\w+)", 1).alias("tag"), "value"))


def _attribute(name: str) -> Column:
    return F.nullif(F.regexp_extract("value", rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def _xml_graph(tags: DataFrame, weights: DataFrame | None, directed: str) -> Graph:
    """Nodes and edges by their attributes, ids numbered by first appearance; weights (line, w) of edges, or their own attribute."""
    nodes = tags.where("tag = 'node'").select("line", F.lit(0).alias("k"), _attribute("id").alias("name"))
    e = tags.where("tag = 'edge'").select("line", _attribute("source").alias("a"), _attribute("target").alias("b"), F.coalesce(_attribute("weight").try_cast("double"), F.lit(1.0)).alias("w"))
    if weights is not None:
        e = e.drop("w").join(weights, "line", "left").fillna(1.0, ["w"])
    said = nodes.union(e.select("line", F.lit(0), "a")).union(e.select("line", F.lit(1), "b"))
    ids = cut(numbered(said.groupBy("name").agg(F.min(F.struct("line", "k")).alias("o")), ["o"], "id").select("name", "id"))
    e = e.join(ids.select(F.col("name").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("name").alias("b"), F.col("id").alias("dst")), "b")
    flag = bool(tags.where((F.col("tag") == "graph") & F.col("value").contains(directed)).limit(1).count())
    return Graph.from_edges(e.select("src", "dst", "w"), ids.select("id"), flag)


def graphml(spark: SparkSession, path: str) -> Graph:
    """Weights are in the data elements whose key is declared as weight."""
    tags = _tags(spark, path)
    keys = tags.where((F.col("tag") == "key") & (_attribute("attr.name") == "weight")).select(_attribute("id").alias("key"))
    data = tags.where("tag = 'data'").select("line", _attribute("key").alias("key")).join(F.broadcast(keys), "key", "left_semi").select("line", F.lit("data").alias("tag"))  # a row for each declared key
    # among edges and their weights, a weight follows its edge; its text is the next piece
    order = numbered(tags.where("tag in ('edge', 'node')").select("line", "tag").union(data), ["line"], "row")
    of = order.where("tag = 'data'").select(F.col("line").alias("at"), (F.col("row") - 1).alias("row")).join(order.where("tag = 'edge'").select("line", "row"), "row")
    text = tags.select((F.col("line") - 1).alias("at"), F.regexp_extract("value", r"^([^<]*)<", 1).try_cast("double").alias("w"))
    return _xml_graph(tags, of.join(text, "at").select("line", "w"), 'edgedefault="directed"')


def gexf(spark: SparkSession, path: str) -> Graph:
    return _xml_graph(_tags(spark, path), None, 'defaultedgetype="directed"')


def graph_tool(spark: SparkSession, path: str) -> Graph:
    """The .gt binary format: magic, version, endianness, comment, directed flag, nodes, and each node's out-neighbours."""

    def parse(data: bytes) -> pd.DataFrame:
        if data[:6] != bytes([0xE2, 0x9B, 0xBE, 0x20, 0x67, 0x74]):
            raise ValueError("not a .gt file")
        end = ">" if data[7] else "<"
        at = 8
        (n,) = struct.unpack_from(f"{end}Q", data, at)
        at += 8 + n
        directed = data[at]
        (n,) = struct.unpack_from(f"{end}Q", data, at + 1)
        at += 9
        width = next(w for w, top in ((1, 1 << 8), (2, 1 << 16), (4, 1 << 32), (8, 1 << 64)) if n < top)
        counts, texts, unpack = np.empty(n, np.int64), [], struct.Struct(f"{end}Q").unpack_from
        for u in range(n):
            (k,) = unpack(data, at)
            counts[u] = k
            if k:
                texts.append(data[at + 8 : at + 8 + k * width])
            at += 8 + k * width
        to = np.frombuffer(b"".join(texts), f"{end}u{width}").astype(np.int64)
        # a row for each node, which tells whether arcs have directions, and one for each arc
        src = pd.array(np.r_[np.arange(n), np.repeat(np.arange(n), counts)], "Int64")
        dst = pd.array(np.r_[np.zeros(n, np.int64), to], "Int64")
        dst[:n] = pd.NA
        return pd.DataFrame({"src": src, "dst": dst, "w": np.r_[np.full(n, float(directed)), np.ones(len(to))]})

    rows = _parsed(spark, path, parse, "src long, dst long, w double")
    directed = bool(rows.where("dst is null and w = 1").limit(1).count())
    return _graph_of(rows, directed)


def dibap(spark: SparkSession, path: str) -> Graph:
    """The .gi binary format, big-endian: magic, n, arcs, node and edge weight sizes, then offsets, weights and targets of both directions."""

    def parse(data: bytes) -> pd.DataFrame:
        if data[:4] != b"GI\x00\x01" and data[:2] != b"BI":
            raise ValueError("not a .gi file")
        n, m, nodew, edgew, _ = struct.unpack_from(">5i", data, 4)
        at = 24
        first = struct.unpack_from(f">{n + 1}i", data, at)
        at += 4 * (n + 1) + 4 * n * (1 if nodew else 0)
        to = struct.unpack_from(f">{m}i", data, at)
        at += 4 * m
        w = struct.unpack_from(f">{m}i", data, at) if edgew else [1] * m
        rows: list = [(u, None, None) for u in range(n)]
        for u in range(n):
            rows += [(u, to[i], float(w[i])) for i in range(first[u], first[u + 1]) if u <= to[i]]
        return _frame(rows)

    return _graph_of(_parsed(spark, path, parse, "src long, dst long, w double"), False)


# -- partitions, covers, events, rasters


def partition(spark: SparkSession, path: str) -> DataFrame:
    """A subset per line, the line's number is the node; lines that begin with * or # are passed over."""
    body = lines(spark, path).where(~F.col("value").rlike(r"^[*#]") & (F.trim("value") != ""))
    return numbered(body, ["line"], "id").select("id", F.trim("value").cast("long").alias("subset"))


def edge_list_partition(spark: SparkSession, path: str, separator: str = "\t", first: int = 0) -> DataFrame:
    p = F.split(F.trim("value"), UNITS.get(separator, separator))
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select((p.getItem(0).cast("long") - first).alias("id"), p.getItem(1).cast("long").alias("subset"))


def cover(spark: SparkSession, path: str) -> DataFrame:
    """(id, subset): a line lists a subset's members."""
    return lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.explode(F.split(F.trim("value"), r"\s+").cast("array<bigint>")).alias("id"), F.col("line").alias("subset"))


def edge_list_cover(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(id, subset): a line is a node and its subsets."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select((p.getItem(0).cast("long") - first).alias("id"), F.explode(F.slice(p, 2, 1 << 30).cast("array<bigint>")).alias("subset"))


def events(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """(seq, step, type, u, v, w) of a DGS004 file; names are whole numbers from first on."""
    from pyspark.sql.window import Window

    body = lines(spark, path).where("line > 1 and trim(value) <> '' and not value like '#%'")
    p = F.split(F.trim("value"), r"\s+")
    tag = p.getItem(0)
    kind = F.create_map(*[F.lit(x) for kv in (("an", "NODE_ADDITION"), ("dn", "NODE_REMOVAL"), ("rn", "NODE_RESTORATION"), ("ae", "EDGE_ADDITION"), ("de", "EDGE_REMOVAL"), ("ce", "EDGE_WEIGHT_UPDATE"), ("ie", "EDGE_WEIGHT_INCREMENT"), ("st", "TIME_STEP")) for x in kv])
    name = p.getItem(1)
    pair = F.split(name, "-")
    u = F.when(tag == "ae", p.getItem(2)).when(tag.isin("de", "ce", "ie"), pair.getItem(0)).when(tag == "st", F.lit(None)).otherwise(name)
    v = F.when(tag == "ae", p.getItem(3)).when(tag.isin("de", "ce", "ie"), F.get(pair, F.lit(1)))
    w = F.regexp_extract("value", r"weight=([-+.\deE]+)", 1)
    rows = body.select(F.col("line").alias("seq"), F.element_at(kind, tag).alias("type"), (u.cast("long") - first).alias("u"), (v.cast("long") - first).alias("v"), F.when(w == "", None).otherwise(w).cast("double").alias("w"))
    # steps are few beside events: number them by ranges, then look up each event's
    st = numbered(rows.where("type = 'TIME_STEP'").select("seq"), ["seq"], "step").select("seq", "step")
    marked = rows.join(st, "seq", "left").withColumn("p", F.floor(F.col("seq") / 65536))
    own = F.last("step", ignorenulls=True).over(Window.partitionBy("p").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    before = marked.groupBy("p").agg(F.max("step").alias("s"))
    carried = before.select("p", F.max("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))  # a row for each 65536 lines
    out = marked.withColumn("own", own).join(carried, "p")
    return out.select("seq", (F.coalesce("own", "carried", F.lit(-1)) + 1).alias("step"), "type", "u", "v", "w")


def raster(spark: SparkSession, path: str, scale: float = 1.0, salt: int = 0) -> DataFrame:
    """(id, x, y): drawn points in the unit square, as many in each cell as its value times scale says; header lines (`ncols` and so on) are passed over."""
    from graphloom.functions.hashrand import uniform

    body = lines(spark, path).where(F.col("value").rlike(r"^\s*[-\d]"))
    rows = numbered(body, ["line"], "row").select("row", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("p"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("p")).alias("cols")).first()
    cells = rows.select("row", F.posexplode("p").alias("col", "v")).select("row", "col", F.round(F.greatest(F.col("v").cast("double"), F.lit(0.0)) * scale).cast("int").alias("n")).where("n > 0")
    pts = cells.select("row", "col", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    pts = pts.select(((F.col("col") + uniform(f"x{salt}", "row", "col", "k")) / size.cols).alias("x"), ((F.col("row") + uniform(f"y{salt}", "row", "col", "k")) / size.rows).alias("y"))
    return numbered(pts, ["y", "x"], "id").select("id", "x", "y")


READERS = {"edgelist": edge_list, "snap": snap, "metis": metis, "konect": konect, "gml": gml, "graphml": graphml, "gexf": gexf, "gt": graph_tool, "gi": dibap}


def read_graph(spark: SparkSession, path: str, format: str, **options) -> Graph:
    return READERS[format](spark, path, **options)


def read_graphs(spark: SparkSession, paths: dict[str, str], format: str, **options) -> dict[str, Graph]:
    return {name: read_graph(spark, path, format, **options) for name, path in paths.items()}
