"""Lineage cuts in shared storage, and the connected-components fixpoint built on them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote and no plan reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Run df once and keep its rows as a table in the shared folder; later plans start from those files.

    A table's size is what its files hold. A checkpoint keeps the size that the planner had guessed, and where a loop joins
    a state with itself such guesses square from round to round, until planning a round takes minutes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/graphloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop in the shared folder. A name holds its latest version and the one before, which the latest was made from; older ones are deleted.

    What outlives the loop is cut() before close().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.versions: dict[str, int] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        at = self.versions[name] = self.versions.get(name, -1) + 1
        path = f"{self.folder}/{name}/{at}"
        df.write.parquet(path)
        if at >= 2:
            remove(self.spark, f"{self.folder}/{name}/{at - 2}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self.versions.pop(name, None)
            remove(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        remove(self.spark, self.folder)


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame, DataFrame], bool], rounds: int = 100) -> DataFrame:
    """Apply step until changed(old, new) is false; each round's state is cut."""
    for _ in range(rounds):
        new = cut(step(state))
        if not changed(state, new):
            return new
        state = new
    raise RuntimeError(f"no fixpoint within {rounds} rounds")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): each node that has an edge with the smallest id that it reaches.

    Each round every node, and the node that names its component, takes the least name next to any node of the component; then names are
    followed one step. Because whole components hook onto others at once, the number of rounds grows with the logarithm of the
    longest path, whatever the order of ids. Self loops are allowed; edges with a null end are ignored.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = cut(e.union(e.select("b", "a")).distinct())
    loop = Rounds(edges.sparkSession, "components")
    state = loop.put("state", both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(state.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        seen = loop.put("seen", state.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "c").alias("m")))
        hook = seen.groupBy(F.col("was").alias("id")).agg(F.min("m").alias("h"))
        hooked = loop.put("hooked", seen.join(hook, "id", "left").select("id", F.least("m", "h").alias("component"), "was"))
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = loop.put("state", hooked.join(up, "component").select("id", F.col("top").alias("component"), (F.col("top") != F.col("was")).alias("moved")))
        moving = new.where("moved").limit(1).count()
        state = new.select("id", "component")
        if not moving:
            out = cut(state)
            loop.close()
            return out
