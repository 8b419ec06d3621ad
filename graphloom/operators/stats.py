"""Profiles: statistics of a measure, correlations, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, cumulated


def describe(scores: DataFrame) -> DataFrame:
    """One row of min, max, mean, quartiles, sample deviation, skewness and excess kurtosis of score."""
    q = F.percentile("score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return scores.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"), F.max("score").alias("highest"), F.avg("score").alias("mean"), q.alias("q"), F.stddev_samp("score").alias("deviation"), F.skewness("score").alias("skewness"), F.kurtosis("score").alias("kurtosis")).select("n", "lowest", "highest", "mean", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "deviation", "skewness", "kurtosis")


def outliers(scores: DataFrame, k: float = 1.5) -> DataFrame:
    """(id, score) beyond k interquartile ranges from the quartiles."""
    d = describe(scores).select("q1", "q3", "iqr")
    return scores.join(F.broadcast(d)).where((F.col("score") < F.col("q1") - k * F.col("iqr")) | (F.col("score") > F.col("q3") + k * F.col("iqr"))).select("id", "score")  # one row


def bins(scores: DataFrame, n: int = 20) -> DataFrame:
    """(bin, count) over n equal widths from the least to the greatest value."""
    d = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n), F.lit(n - 1)))
    return scores.join(F.broadcast(d)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))  # one row


def pearson(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("score", "other"), "id").agg(F.corr("score", "other").alias("pearson"), F.covar_samp("score", "other").alias("covariance"))


def mean_ranks(scores: DataFrame) -> DataFrame:
    """(id, rank) ascending, equal values share their mean rank; ranks come from counts per value."""
    held = scores.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    place = cumulated(held, ["score"], "c", "upto").select("score", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank"))
    return scores.join(place, "score").select("id", "rank")


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = mean_ranks(a).withColumnRenamed("rank", "x"), mean_ranks(b).withColumnRenamed("rank", "y")
    return x.join(y, "id").agg(F.corr("x", "y").alias("spearman"))


def fechner(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of the products of signs of deviations; zero counts as positive."""
    j = a.join(b.withColumnRenamed("score", "other"), "id")
    m = j.agg(F.avg("score").alias("ma"), F.avg("other").alias("mb"))
    sign = lambda c, mean: F.when(F.col(c) - F.col(mean) < 0, -1.0).otherwise(1.0)
    return j.join(F.broadcast(m)).agg(F.avg(sign("score", "ma") * sign("other", "mb")).alias("fechner"))  # one row


def degree_distribution(g: Graph) -> DataFrame:
    return g.degrees().groupBy("deg").agg(F.count(F.lit(1)).alias("nodes"))


def clustering_per_degree(g: Graph) -> DataFrame:
    from graphloom.operators.triangles import local_clustering

    return g.degrees().select("id", "deg").join(local_clustering(g), "id").groupBy("deg").agg(F.avg("lcc").alias("mean_lcc"))


def core_sequence(g: Graph) -> DataFrame:
    from graphloom.operators.centrality import core_numbers

    return core_numbers(g).groupBy("core").agg(F.count(F.lit(1)).alias("nodes"))


def overview(g: Graph) -> DataFrame:
    """One row of sizes, degrees, components and clustering."""
    from graphloom.operators.components import component_sizes
    from graphloom.operators.triangles import global_clustering

    d = g.degrees().agg(F.min("deg").alias("min_deg"), F.max("deg").alias("max_deg"), F.avg("deg").alias("mean_deg"), F.sum(F.expr("cast(deg = 0 as bigint)")).alias("isolated"))
    c = component_sizes(g).agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    return g.summary().join(d).join(c).join(global_clustering(g))  # one row each
