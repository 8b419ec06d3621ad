"""Operator 5: I-Match fingerprints with randomised lexicons, in DataFrame functions only.

The lexicon holds the terms that occur in a middle share of all documents. Of a text, its distinct
lexicon terms are sorted, and a signature is the hash of those that fall in one of several random
subsets of the lexicon; a fingerprint is the row of signatures. Subsets range from half of the lexicon
to a few thousandths, so the share of equal signatures falls gradually as texts part.

A term of the lexicon is in at least min_share of the documents, so it has at most (distinct terms of
a document on average) / min_share terms at any corpus size: it travels in the plan as a hashed
table, and a text's terms are looked up where the text lies, without a shuffle.

The next document is found with one shuffle of the texts: documents are dealt by ranges of doc_id, and
the first of each range is sent to the range before as well.

Defined cases: a null text is empty; a text without lexicon terms has the hash of its whole as its
fingerprint, alike to equal texts only; null ids come last in the descending order; among rows of one
id the order is by a hash of the text; a single document is its own next one; an empty table gives no
rows.
"""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.line_dedup import LOWER, UPPER

#: Shares of the lexicon in the random subsets, in 65536ths; REPEATS subsets of each.
SHARES = (32768, 16384, 8192, 4096, 2048, 1024, 512, 256)
REPEATS = 4
SUBSETS = len(SHARES) * REPEATS
WIDTH = 8
BETWEEN = r"[\x00-@\[-`{-\x7f]+"


def terms(text: Column) -> Column:
    """Distinct runs of ASCII letters and non-ASCII characters, A-Z in lower case."""
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1), lambda t: t != ""))


def lexicon(docs: DataFrame, n_docs: int, min_share: float = 0.005, max_share: float = 0.1) -> DataFrame:
    """(t, m): terms in a middle share of the documents, with bit k of m set if the term is in subset k."""
    counted = docs.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    band = counted.where((F.col("n") >= max(2.0, min_share * n_docs)) & (F.col("n") <= max_share * n_docs))
    bits = [F.when(F.conv(F.substring(F.md5(F.concat("t", F.lit(f":{k}")).cast("binary")), 1, 4), 16, 10).cast("int") < SHARES[k % len(SHARES)], F.lit(1 << k)).otherwise(0).cast("long") for k in range(SUBSETS)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return band.select("t", total.alias("m"))


def table(lex: DataFrame) -> tuple[Column, int]:
    """The lexicon as a constant array of short chains by hash, and its length."""
    found = lex.select("t", "m", F.xxhash64("t").alias("h")).collect()  # bounded: see above
    size = max(1, 2 * len(found))
    chains: list[list] = [[] for _ in range(size)]
    for r in sorted(found):
        chains[r.h % size].append({"t": r.t, "m": r.m})
    return F.from_json(F.lit(json.dumps(chains)), "array<array<struct<t:string,m:bigint>>>"), size


def fingerprint(text: Column, chains: Column, size: int) -> Column:
    known = F.flatten(F.transform(terms(text), lambda t: F.filter(F.element_at(chains, (F.pmod(F.xxhash64(t), F.lit(size)) + 1).cast("int")), lambda e: e["t"] == t)))

    def signature(k: Column, all_terms: Column) -> Column:
        kept = F.filter(all_terms, lambda e: F.call_function("shiftright", e["m"], k).bitwiseAND(F.lit(1).cast("long")) == 1)
        joined = F.array_join(kept["t"], " ")
        return F.element_at(F.transform(F.array(joined), lambda s: F.when(s == "", F.lit("-" * WIDTH)).otherwise(F.substring(F.md5(s.cast("binary")), 1, WIDTH))), 1)

    # transforms of one element: they bind the sorted terms, and then the joined signatures, so that each is evaluated once
    joined = F.transform(F.array(F.array_sort(known)), lambda ts: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: signature(k, ts)), ""))
    return F.element_at(F.transform(joined, lambda s: F.when(s == "-" * (WIDTH * SUBSETS), F.concat(F.lit("text:"), F.md5(text.cast("binary")))).otherwise(s)), 1)


def likeness(a: Column, b: Column) -> Column:
    """Equal signatures as a share of those that either fingerprint has."""
    at = F.sequence(F.lit(0), F.lit(SUBSETS - 1))

    def part(x: Column, k: Column) -> Column:
        return F.substring(x, k * WIDTH + 1, F.lit(WIDTH))

    said = F.size(F.filter(at, lambda k: (part(a, k) != "-" * WIDTH) | (part(b, k) != "-" * WIDTH)))
    same = F.size(F.filter(at, lambda k: (part(a, k) == part(b, k)) & (part(a, k) != "-" * WIDTH)))
    return F.when(a == b, F.lit(1.0)).when(a.startswith("text:") | b.startswith("text:"), F.lit(0.0)).otherwise(same / said)


def _cuts(docs: DataFrame) -> list[int]:
    """Ids that part the documents into about four ranges for each shuffle partition."""
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first().q
    return sorted(set(found or []))


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are less than the id, by a search in two steps; -1 for a null id."""
    if not cuts:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    step = max(1, isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    tops = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps([*groups, []])), "array<array<bigint>>")
    which = F.size(F.filter(tops, lambda c: c < doc_id))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(which * step + F.size(F.filter(F.element_at(inner, which + 1), lambda c: c < doc_id)))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """docs (doc_id, text) with part, again and h, each part holding the rows after its own; and the window in which the next row leads."""
    placed = docs.withColumn("part", _range_of(F.col("doc_id"), _cuts(docs)))
    tops = {r.part: r.top for r in placed.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # a row for each range
    order = sorted(tops, reverse=True)
    low = -1
    targets = [0] * (max(order, default=0) - low + 1)
    first = [None] * len(targets)
    for i, p in enumerate(order):
        targets[p - low] = order[i - 1] if i else order[-1]
        first[p - low] = tops[p]
    at = F.col("part") - low + 1
    target = F.element_at(F.from_json(F.lit(json.dumps(targets)), "array<int>"), at)
    leads = F.col("doc_id").eqNullSafe(F.element_at(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), at))
    one = F.struct("part", F.lit(False).alias("again"))
    rows = placed.select("doc_id", "text", F.explode(F.when(leads, F.array(one, F.struct(target.alias("part"), F.lit(True).alias("again")))).otherwise(F.array(one))).alias("p"))
    rows = rows.select("doc_id", "text", "p.part", "p.again", F.xxhash64("text").alias("h"))
    return rows, Window.partitionBy("part").orderBy("again", F.col("doc_id").desc_nulls_last(), "h")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    chains, size = table(lexicon(docs, docs.count()))
    rows, w = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    led = rows.withColumn("next", F.lead("text").over(w))
    led = led.select("doc_id", "part", "again", "h", "text", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.coalesce(F.col("next"), F.col("text")).substr(F.lit(1), half)).alias("edited"))
    done = led.select("doc_id", "part", "again", "h", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("text"), chains, size).alias("fingerprint"), fingerprint(F.col("edited"), chains, size).alias("edited_fingerprint"))
    out = done.withColumn("after", F.lead("fingerprint").over(w)).where(~F.col("again"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.coalesce("after", "fingerprint")).alias("near_next"))


def op5_imatch(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
x as (select *, coalesce(lead(t) over w, first_value(t) over w) as nt from d window w as (order by doc_id desc)),
e as (select doc_id, 0 as side, t from x union all select doc_id, 1, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) from x),
g as (select doc_id, side, unnest(list_distinct(list_filter(string_split_regex(translate(t, '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda s: s <> ''))) as w from e),
c as (select w from g where side = 0 group by w having count(*) >= greatest(2.0, 0.005 * (select count(*) from documents)) and count(*) <= 0.1 * (select count(*) from documents)),
k as (select unnest(range({SUBSETS})) as k),
s as (select w, k from c, k where ('0x' || substr(md5(w || ':' || k), 1, 4))::int < ([{", ".join(map(str, SHARES))}])[k % {len(SHARES)} + 1]),
f as (select doc_id, side, k, substr(md5(string_agg(w, ' ' order by w)), 1, {WIDTH}) as sig from g join s using (w) group by all),
p as (select e.doc_id, e.side, e.t, case when count(sig) = 0 then 'text:' || md5(any_value(e.t)) else string_agg(coalesce(sig, '{"-" * WIDTH}'), '' order by k.k) end as fp
  from e cross join k left join f on f.doc_id = e.doc_id and f.side = e.side and f.k = k.k group by e.doc_id, e.side, e.t),
r as (select a.doc_id, a.t, a.fp as fingerprint, b.fp as edited_fingerprint, sha256(b.t) as edited_sha256, coalesce(lead(a.fp) over w, first_value(a.fp) over w) as after
  from p a join p b on a.doc_id = b.doc_id and a.side = 0 and b.side = 1 window w as (order by a.doc_id desc)),
m as (select *, [{", ".join(f"substr(fingerprint, {1 + WIDTH * k}, {WIDTH})" for k in range(SUBSETS))}] as x, [{", ".join(f"substr(edited_fingerprint, {1 + WIDTH * k}, {WIDTH})" for k in range(SUBSETS))}] as y, [{", ".join(f"substr(after, {1 + WIDTH * k}, {WIDTH})" for k in range(SUBSETS))}] as z from r)
select doc_id, length(t)::bigint as n_chars, edited_sha256, fingerprint, edited_fingerprint,
  case when fingerprint = edited_fingerprint then 1.0::double when fingerprint like 'text:%' or edited_fingerprint like 'text:%' then 0.0::double
    else len(list_filter(range({SUBSETS}), lambda i: x[i + 1] = y[i + 1] and x[i + 1] <> '{"-" * WIDTH}'))::double / len(list_filter(range({SUBSETS}), lambda i: x[i + 1] <> '{"-" * WIDTH}' or y[i + 1] <> '{"-" * WIDTH}')) end as near_edited,
  case when fingerprint = after then 1.0::double when fingerprint like 'text:%' or after like 'text:%' then 0.0::double
    else len(list_filter(range({SUBSETS}), lambda i: x[i + 1] = z[i + 1] and x[i + 1] <> '{"-" * WIDTH}'))::double / len(list_filter(range({SUBSETS}), lambda i: x[i + 1] <> '{"-" * WIDTH}' or z[i + 1] <> '{"-" * WIDTH}')) end as near_next
from m
"""
