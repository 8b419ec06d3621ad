"""Operator 8: corpus-wide removal of repeated lines, in DataFrame functions only.

The hashes of all lines are written once to the shared folder, dealt by range of (hash, bucket of the
document) and sorted by document and position behind it, so that a line which a third of all documents
hold still lies in many tasks. Streaming over that order marks each document's first occurrence of a
key; a bucket's counts are added up over the few buckets of a key, and what comes back per document is
a compressed keep bitmap (64 lines a word, words without a dropped line are left out), never text.

Defined cases: a null or empty text is one empty line; a null doc_id can hold lines but is no
document of its own for the count and never the keeper, so its repeated lines go wherever the key is
repeated enough; rows that repeat a doc_id count as one document, and each of them loses its own
lines; other columns pass through untouched. With counts, columns named n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans.fixpoint import cut

BLANK = " \t\n\x0b\x0c\r"
#: Buckets of documents: a key's rows are dealt in up to so many parts.
BUCKETS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """(h, g, b, id, t, at): two independent 64-bit hashes of each line's key (128 bits do not collide at corpus size), a bucket of the document, its id, hash of its text, and the line's position."""
    said = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.posexplode(lines(F.col(text_col))).alias("at", "line"))
    said = said.select("id", "t", "at", key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    bucket = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("id")), F.lit(BUCKETS)).cast("short")
    return said.select(F.xxhash64("k").alias("h"), F.xxhash64(F.lit(1), "k").alias("g"), bucket.alias("b"), "id", "t", "at")


def first_occurrences(hashed: DataFrame) -> DataFrame:
    """hashed, dealt by range and sorted, with a flag on each document's first occurrence of a key."""
    dealt = hashed.repartitionByRange("h", "g", "b").sortWithinPartitions("h", "g", "b", "id", "at")
    before = F.lag("id").over(Window.partitionBy("h", "g", "b").orderBy("id", "at"))
    return dealt.withColumn("first", F.col("id").isNotNull() & (before.isNull() | (before != F.col("id"))))


def repeated_keys(hashed: DataFrame, min_docs: int = 5) -> DataFrame:
    """(h, g, b, keeper): the buckets of keys that at least min_docs documents hold, and the largest of these."""
    shares = first_occurrences(hashed).groupBy("h", "g", "b").agg(F.count_if("first").alias("n"), F.max("id").alias("top"))
    of_key = Window.partitionBy("h", "g")
    told = shares.select("h", "g", "b", F.sum("n").over(of_key).alias("docs"), F.max("top").over(of_key).alias("keeper"))
    return told.where(F.col("docs") >= min_docs).select("h", "g", "b", "keeper")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, t, kept): for each document (id, hash t of its text) that loses lines, a map from word number to 64 keep bits; words kept whole are left out."""
    hashed = cut(hashes(docs, id_col, text_col, min_chars))
    lost = hashed.join(repeated_keys(hashed, min_docs), ["h", "g", "b"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    words = lost.groupBy("id", "t", F.expr("at div 64").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, at % 64))").alias("bits"))
    return words.groupBy("id", "t").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, counts: bool = False, count_chars: str | None = None) -> DataFrame:
    """docs with the kept lines as text; with counts also n_lines and n_dropped in front; a column count_chars becomes the length of the new text."""
    marks = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).select(F.col("id").alias("__mark_id"), F.col("t").alias("__mark_t"), F.col("kept").alias("__bits"))
    joined = docs.join(marks, F.col(id_col).eqNullSafe(F.col("__mark_id")) & (F.xxhash64(text_col) == F.col("__mark_t")), "left")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i % 64)
    kept = F.filter(F.col("__lines"), lambda line, i: F.coalesce(F.element_at("__bits", F.expr("0L") + F.floor(i / 64)), F.lit(-1).cast("long")).bitwiseAND(bit(i)) != 0)
    out = joined.withColumn("__lines", lines(F.col(text_col))).withColumn("__kept", F.when(F.col("__bits").isNull(), F.col("__lines")).otherwise(kept))
    text = F.when(F.col("__bits").isNull(), F.col(text_col)).otherwise(F.array_join("__kept", "\n"))
    extra = {"n_lines": F.size("__lines").cast("long"), "n_dropped": (F.size("__lines") - F.size("__kept")).cast("long")} if counts else {}
    cols = [text.alias(c) if c == text_col else F.length(text).cast(dict(docs.dtypes)[c]).alias(c) if c == count_chars else F.col(c) for c in docs.columns if c not in extra]
    return out.select(*(v.alias(n) for n, v in extra.items()), *cols)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs, counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
with l as (select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
r as (select k, max(doc_id) as keeper from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
m as (select l.doc_id, l.pos, l.line, r.keeper is not null and l.doc_id <> r.keeper as gone from l left join r on l.k = r.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
