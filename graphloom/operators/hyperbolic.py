"""Random hyperbolic graphs as a banded range join of a point table with itself.

Points lie in a disk of radius R; two are linked when their hyperbolic distance is below R. The disk is
cut into rings of radius. A point looks for partners of no greater radius in its own ring and in those
further in; for a ring with inner radius b, all partners of a point of radius r lie within the angle
theta(r, b) = arccos((cosh r cosh b - cosh R) / (sinh r sinh b)), so the point is sent to the few
angular buckets of that ring that the interval touches, and an equi-join on (ring, bucket) with the exact
distance as a filter finds every edge once. Bucket widths shrink with the ring's own interval.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.hashrand import acosh_radius, uniform
from graphloom.graph import Graph


def expected_degree(n: int, alpha: float, R: float) -> float:
    gamma = 2 * alpha + 1
    xi = (gamma - 1) / (gamma - 2)
    return (2 / math.pi) * xi * xi * n * (math.exp(-R / 2) + math.exp(-alpha * R) * (alpha * (R / 2) * ((math.pi / 4) / alpha**2 - (math.pi - 1) / alpha + (math.pi - 2)) - 1))


def target_radius(n: int, degree: float, exponent: float) -> float:
    """R at which the expected degree is the wanted one, by bisection."""
    alpha = (exponent - 1) / 2
    lo, hi = 1e-3, 4 * math.log(max(n, 2)) + 20
    for _ in range(100):
        mid = (lo + hi) / 2
        if expected_degree(n, alpha, mid) > degree:
            lo = mid
        else:
            hi = mid
    return lo


def points(spark: SparkSession, n: int, alpha: float, R: float, salt: int = 0) -> DataFrame:
    """(id, phi, r) for ids 0 .. n - 1, each from its own draws."""
    return place(spark.range(n), alpha, R, salt)


def place(ids: DataFrame, alpha: float, R: float, salt: int = 0) -> DataFrame:
    return ids.select("id", (uniform(f"{salt}:1", "id") * (2 * math.pi)).alias("phi"), acosh_radius(uniform(f"{salt}:2", "id"), alpha, R).alias("r"))


def prepared(pts: DataFrame) -> DataFrame:
    """Adds what the distance test needs: cosh and sinh of r, and the direction."""
    return pts.select("id", "phi", "r", F.cosh("r").alias("c"), F.sinh("r").alias("s"), F.cos("phi").alias("px"), F.sin("phi").alias("py"))


def cosh_distance(a: str = "a", b: str = "b") -> Column:
    dot = F.col(f"{a}.px") * F.col(f"{b}.px") + F.col(f"{a}.py") * F.col(f"{b}.py")
    return F.col(f"{a}.c") * F.col(f"{b}.c") - F.col(f"{a}.s") * F.col(f"{b}.s") * dot


def poincare_radius(r: Column) -> Column:
    """The radius in the Poincaré disk of a native radius."""
    return F.sqrt((F.cosh(r) - 1) / (F.cosh(r) + 1))


def bands(R: float, width: float = 1.0) -> list[float]:
    """Inner radii of the rings: the inner half of the disk is one, further out they are about width apart."""
    half = R / 2
    k = max(1, math.ceil((R - half) / width))
    return [0.0, *(half + i * (R - half) / k for i in range(k))]


def _reach(r: float, b: float, R: float) -> float:
    """The half interval of angles in which a point of radius r can have partners of radius b or more."""
    if r + b <= R or b <= 0:
        return math.pi
    x = (math.cosh(r) * math.cosh(b) - math.cosh(R)) / (math.sinh(r) * math.sinh(b))
    return math.acos(max(-1.0, min(1.0, x)))


def edges(pts: DataFrame, R: float, width: float = 1.0) -> DataFrame:
    """(src, dst): every pair nearer than R once; src is the farther out (by r, phi, id)."""
    limits = bands(R, width)
    # angular buckets of a ring: about as wide as the interval of a point on its inner rim
    slots = [max(1, min(1 << 22, int(math.pi / max(1e-9, _reach(max(b, R / 2 + 1e-9), max(b, R / 2 + 1e-9), R))))) if b > 0 else 1 for b in limits]
    p = prepared(pts)
    ring = F.size(F.filter(F.array(*map(F.lit, limits)), lambda b: b <= F.col("r"))) - 1
    all_slots = F.array(*map(F.lit, slots))
    two_pi = 2 * math.pi
    inside = p.select(F.struct("id", "phi", "r", "c", "s", "px", "py").alias("b"), ring.alias("ring"), F.least(F.floor(F.col("phi") / two_pi * F.element_at(all_slots, ring + 1)), F.element_at(all_slots, ring + 1) - 1).cast("int").alias("slot"))
    rings = [F.struct(F.lit(i).alias("ring"), F.lit(b).alias("b"), F.lit(k).alias("k"), F.lit(math.cosh(b)).alias("cb"), F.lit(math.sinh(b)).alias("sb")) for i, (b, k) in enumerate(zip(limits, slots, strict=True))]
    asks = p.select(F.struct("id", "phi", "r", "c", "s", "px", "py").alias("a"), F.explode(F.array(*rings)).alias("t")).where("t.b <= a.r")
    x = (F.col("a.c") * F.col("t.cb") - math.cosh(R)) / (F.col("a.s") * F.col("t.sb"))
    half = F.when((F.col("t.b") <= 0) | (F.col("a.r") + F.col("t.b") <= R), math.pi).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))) + 1e-9)
    asks = asks.withColumn("half", half)
    lo = F.floor((F.col("a.phi") - F.col("half")) / two_pi * F.col("t.k"))
    hi = F.floor((F.col("a.phi") + F.col("half")) / two_pi * F.col("t.k"))
    # an interval of the whole circle names every bucket once
    span = F.when(hi - lo + 1 >= F.col("t.k"), F.sequence(F.lit(0).cast("bigint"), F.col("t.k").cast("bigint") - 1)).otherwise(F.sequence(lo, hi))
    sent = asks.select("a", F.col("t.ring").alias("ring"), F.col("t.k").alias("k"), F.explode(span).alias("s")).select("a", "ring", F.pmod("s", "k").cast("int").alias("slot"))
    near = sent.join(inside, ["ring", "slot"])
    order = F.struct("b.r", "b.phi", "b.id") < F.struct("a.r", "a.phi", "a.id")
    return near.where(order & (cosh_distance() < math.cosh(R))).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))


def warm_edges(pts: DataFrame, R: float, temperature: float, farthest: float = 2.0, salt: int = 0) -> DataFrame:
    """Edges with probability 1 / (exp((d - R) / 2T) + 1), from pairs up to farthest past R, where the chance is slight."""
    wide = R + farthest
    near = edges(pts, wide)
    p = prepared(pts)
    a, b = p.select(F.col("id").alias("src"), F.struct("c", "s", "px", "py").alias("a")), p.select(F.col("id").alias("dst"), F.struct("c", "s", "px", "py").alias("b"))
    d = F.acosh(F.greatest(F.lit(1.0), cosh_distance()))
    chance = 1 / (F.exp((d - R) / (2 * temperature)) + 1)
    return near.join(a, "src").join(b, "dst").where(uniform(f"warm{salt}", "src", "dst") < chance).select("src", "dst")


def graph(spark: SparkSession, n: int, degree: float = 10, exponent: float = 3.0, salt: int = 0) -> Graph:
    R = target_radius(n, degree, exponent)
    pts = points(spark, n, (exponent - 1) / 2, R, salt)
    return Graph.from_edges(edges(pts, R), pts.select("id"))


def moved(pts: DataFrame, R: float, alpha: float, step: int, by: float = 0.05, salt: int = 0) -> DataFrame:
    """The points after one step of motion: each turns by up to by radians, and its radius drifts by its draw."""
    phi = F.col("phi") + (uniform(f"turn{salt}:{step}", "id") - 0.5) * 2 * by
    u = (F.cosh(alpha * F.col("r")) - 1) / (math.cosh(alpha * R) - 1) + (uniform(f"drift{salt}:{step}", "id") - 0.5) * by
    u = F.abs(u)
    u = F.when(u > 1, 2 - u).otherwise(u)
    return pts.select("id", (phi - F.floor(phi / (2 * math.pi)) * 2 * math.pi).alias("phi"), acosh_radius(u, alpha, R).alias("r"))


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(type, u, v): removals and additions that lead from one edge set to another."""
    a, b = (e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")) for e in (before, after))
    return a.join(b, ["u", "v"], "left_anti").select(F.lit("EDGE_REMOVAL").alias("type"), "u", "v").union(b.join(a, ["u", "v"], "left_anti").select(F.lit("EDGE_ADDITION"), "u", "v"))
