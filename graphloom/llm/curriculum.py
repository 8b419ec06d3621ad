"""Operator 12: sources mixed to target weights over a training run.

Each source has a schedule: its weight as a piecewise linear function of training time 0..1. The integral of
a schedule is the source's weight; weights share the tokens wanted, no source giving more than `most` times
what it has, and what such sources can't give is shared anew. A source's documents, in the order of a hash,
form a stream that is read again when it ends; the source's demand up to time t is its target times the
share of its schedule's integral up to t. The inverse of that demand at the middle of a document's place in
the stream is the document's training position, and documents are sorted by ranges of positions.

Places in a stream are running sums of sizes. A source is dealt by the leading bits of the hash into
`buckets`; their sums give where each starts, and only inside a bucket rows are summed one after another, so a
source of a third of all rows is many tasks' work. Sums are integers and the order is one of hashes: reruns
agree. The last document that a source's target reaches is cut to the words still wanted, so taken
words are the target rounded down. To the driver come single rows of sums.

Defined cases: a null or empty text has size 0 and is never taken; null sources are one source, the last; a
null id is ordered by its text like any other; rows equal in id, source and text are as many
documents and take their places in turn (in `training_order` all with the other columns of one of them);
other columns pass through `training_order` unless they bear the names that it adds; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.graph import numbered
from graphloom.plans.fixpoint import cut

Knots = Sequence[tuple[float, float]]

#: Schedules dealt in turn to the sources, with integrals 3, 1 and 2: one that fades, one that grows, one that peaks halfway.
SCHEDULES: tuple[Knots, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)))
WORDS = "[^\\x20\\x09-\\x0D]+"


def areas(knots: Knots) -> list[float]:
    """The schedule's integral up to each knot."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or min(w for _, w in knots) < 0 or max(w for _, w in knots) <= 0:
        raise ValueError("a schedule goes from time 0 to 1 by rising times, with weights that are not negative and not all 0")
    out = [0.0]
    for (t, v), (u, w) in zip(knots, knots[1:]):
        out.append(out[-1] + (u - t) * (v + w) / 2)
    return out


def time_sql(knots: Knots, share: str) -> str:
    """SQL for the time by which a share (0..1) of the schedule's integral is used up: the root of a quadratic in one segment."""
    upto, parts = areas(knots), []
    num = lambda x: f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))
    for i, ((t, v), (u, w)) in enumerate(zip(knots, knots[1:])):
        rest = f"greatest({share} * {num(upto[-1])} - {num(upto[i])}, 0e0)"
        root = f"sqrt(greatest({num(v * v)} + {num(2 * (w - v) / (u - t))} * {rest}, 0e0))"
        parts.append((f"{share} * {num(upto[-1])} <= {num(upto[i + 1])}", f"case when {rest} > 0e0 then {num(t)} + 2e0 * {rest} / ({num(v)} + {root}) else {num(t)} end"))
    return "least(case " + " ".join(f"when {c} then {x}" for c, x in parts[:-1]) + (" else " if parts[:-1] else "when true then ") + parts[-1][1] + " end, 1e0)"


def _targets(sources: DataFrame, schedules: Sequence[Knots], share: float, most: int) -> DataFrame:
    """sources (named, s, source_size) with turn (its schedule) and target."""
    ranked = cut(numbered(sources.withColumn("last", ~F.col("named")), ["last", "s"], "rank").drop("last"))
    turn = (F.col("rank") % len(schedules)).cast("int")
    weight = F.element_at(F.array(*[F.lit(areas(k)[-1]) for k in schedules]), turn + 1)
    known = ranked.select("named", "s", "source_size", turn.alias("turn"), weight.alias("weight"))
    total, weights = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    rest, free = share * total, weights
    while True:
        above = F.col("weight") * rest > most * F.col("source_size") * F.lit(free)
        n, held, open_ = known.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if not n or not open_ or (share * total - most * held, open_) == (rest, free):
            break
        rest, free = share * total - most * held, open_
    fair = F.col("weight") * F.lit(float(rest)) / F.lit(float(free) or 1.0)
    return known.withColumn("target", F.when(above, (most * F.col("source_size")).cast("double")).otherwise(fair)).drop("weight")


def _key(id_col: str, text_col: str, seed: int):
    """60 bits of a hash of id and text."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _before(column: str, by: list[str], order: list[str]):
    """The sum of the column over the earlier rows."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, most: int = 2, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, pieces, key) per document.

    pieces are (epoch, words, position): in each reading of the stream the words taken and their training time. share is
    the sum of the targets over the sum of all sizes (at most `most`); schedules go in turn to the sources by code point.
    """
    if share > most:
        raise ValueError("no source gives more than `most` times its size, so all together don't either")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    named = F.col(source_col).isNotNull()
    d = cut(docs.select(F.col(id_col).alias("doc_id"), named.alias("named"), F.coalesce(F.col(source_col), F.lit("")).alias("s"), size.alias("size"), _key(id_col, text_col, seed).alias("key")))
    d = d.withColumn("b", F.floor(F.col("key") / F.lit((1 << 60) // buckets)).cast("int"))
    sums = cut(d.groupBy("named", "s", "b").agg(F.sum("size").alias("n")))
    goals = _targets(sums.groupBy("named", "s").agg(F.sum("n").alias("source_size")), schedules, share, most)
    begins = _before("n", ["named", "s"], ["b"])
    offsets = sums.withColumn("begins", begins).join(goals, ["named", "s"]).select("named", "s", "b", "begins", "source_size", "turn", "target")
    own = _before("size", ["named", "s", "b"], ["key", "doc_id", "size"])
    placed = d.withColumn("own", own).join(offsets, ["named", "s", "b"]).withColumn("place", F.col("begins") + F.col("own"))
    wanted = F.floor("target").cast("long")
    pieces = []
    for e in range(most):
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - e * F.col("source_size") - F.col("place")))
        middle = f"((({e} * source_size + place) * 2 + w{e}) / 2e0 / target)"
        placed = placed.withColumn(f"w{e}", words)
        when = F.expr("case turn " + " ".join(f"when {i} then {time_sql(k, middle)}" for i, k in enumerate(schedules)) + " end")
        pieces.append(F.when(F.col(f"w{e}") > 0, F.struct(F.lit(e).alias("epoch"), F.col(f"w{e}").alias("words"), when.alias("position"))))
    taken = sum((F.col(f"w{e}") for e in range(1, most)), F.col("w0"))
    return placed.select("doc_id", F.when(F.col("named"), F.col("s")).alias("source"), "size", "source_size", "target", taken.alias("taken"), F.array_compact(F.array(*pieces)).alias("pieces"), "key")


def training_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, **settings) -> DataFrame:
    """The rows to train on: docs with epoch, words and position, once for each piece, sorted by ranges of positions; the text of a piece that is cut is its first words joined by spaces."""
    mixed = mixture(docs, id_col, source_col, text_col, seed=seed, **settings)
    pieces = mixed.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("key").alias("__key"), F.col("size").alias("__size"), F.explode("pieces").alias("__piece"))
    texts = docs.drop("epoch", "words", "position").withColumn("__key", _key(id_col, text_col, seed))
    once = texts.dropDuplicates([id_col, source_col, "__key"]).withColumnsRenamed({"__key": "__k"})
    same = (F.col("__key") == F.col("__k")) & F.col("__id").eqNullSafe(F.col(id_col)) & F.col("__source").eqNullSafe(F.col(source_col))
    part = F.array_join(F.slice(F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), 1, F.col("__piece.words").cast("int")), " ")
    rows = pieces.join(once, same).withColumn(text_col, F.when(F.col("__piece.words") < F.col("__size"), part).otherwise(F.col(text_col)))
    out = rows.select(*[c for c in once.columns if c != "__k"], F.col("__piece.epoch").alias("epoch"), F.col("__piece.words").alias("words"), F.col("__piece.position").alias("position"))
    return out.orderBy("position", id_col, "epoch")


def op12_curriculum(spark, sf_dir: str) -> DataFrame:
    mixed = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first = F.when(F.size("pieces") > 0, F.round(F.col("pieces")[0]["position"], 9))
    return mixed.withColumn("first_position", first).orderBy(F.col("first_position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken", "first_position")


ORACLE = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
  ('0x' || substr(md5(concat_ws(':', '0', doc_id::varchar, md5(text))), 1, 15))::bigint as key from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % {len(SCHEDULES)} as turn from d group by source),
w as (select *, {[areas(k)[-1] for k in SCHEDULES]}[turn + 1]::double as weight from s),
k as (select *, sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding) as held,
  sum(weight) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding) as used, sum(source_size) over () as total, sum(weight) over () as weights from w),
c as (select *, weight * (1.5e0 * total - 2 * coalesce(held, 0)) > 2 * source_size * (weights - coalesce(used, 0e0)) as above from k),
f as (select *, 1.5e0 * total - 2 * coalesce(sum(source_size) filter (where above) over (), 0) as rest, sum(weight) filter (where not above) over () as free from c),
g as (select source, source_size, turn, case when above then (2 * source_size)::double else weight * rest / coalesce(free, 1e0) end as target from f),
p as (select d.doc_id, d.size, g.source_size, g.turn, g.target, coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as place
  from d join g on d.source is not distinct from g.source),
t as (select *, greatest(0, least(size, floor(target)::bigint - place)) as w0, greatest(0, least(size, floor(target)::bigint - source_size - place)) as w1 from p)
select doc_id, size, source_size, target, (w0 + w1)::bigint as taken,
  case when w0 > 0 then round(case turn {" ".join(f"when {i} then {time_sql(k, '((place * 2 + w0) / 2e0 / target)')}" for i, k in enumerate(SCHEDULES))} end, 9) end as first_position from t
"""
