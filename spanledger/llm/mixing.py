"""Mixing sources to target weights by systematic sampling.

Expected copies of a source's documents are summed up in an order, one random offset is added, and a document is
taken once for every integer that its step crosses. Everything is a DataFrame operation. A source's documents are
never in one place: a rank is the number of smaller ones (from counts by size), plus that of equal size in earlier
buckets (from counts by bucket), plus the rank in a bucket, which holds 1/4096 of the documents of one source and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import numbered, shielded, stored, uniform, words

#: Weights of the sources in code point order, again and again; null comes last.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mixing-1"


def sizes(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, _total) with _target: shares by weight, none above ``most`` times the source's size.

    The level that open sources reach a unit of weight rises with every round, as the excess of those that are
    full is dealt anew; each round is one sum over the sources, and there are as many as sources that fill at most.
    """
    order = [F.col("source").asc_nulls_last()]
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    df = stored(numbered(sources, order, "_i").withColumn("_weight", F.get(kinds, (F.col("_i") % len(weights)).cast("int"))).drop("_i"))
    total, weight = df.agg(F.sum("_total"), F.sum("_weight")).first()
    total = total or 0
    level, before = (share * total / weight if weight else 0.0), None
    full = lambda x: F.col("_total") * most <= F.col("_weight") * F.lit(x)
    while level != before and total:
        done, left = df.agg(F.sum(F.when(full(level), F.col("_total"))), F.sum(F.when(~full(level), F.col("_weight")))).first()
        if not left:
            break
        before, level = level, (share * total - most * (done or 0)) / left
    return df.withColumn("_target", F.least(F.col("_total") * most, F.col("_weight") * F.lit(float(level)))).drop("_weight")


def mixed(docs: DataFrame, seed: str = SEED, ties: tuple[str, ...] = ()) -> DataFrame:
    """docs, which have doc_id, source and _size, with _total and _target of the source, and _copies.

    Null is a source like any other; documents without a word have size 0 and are dealt copies as others are; an
    empty table gives none. Repeated rows are documents of their own, and those of one doc_id come in the order of the
    columns ``ties``. Long texts are counted whole. Equal input and seed give equal results. docs may have further
    columns if ``shielded`` has named them.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    tie = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N"))).cast("binary"))
    rows = docs.withColumn("_key", key).withColumn("_tie", tie).withColumn("_bucket", F.substring("_tie", 1, 3))
    counts = stored(rows.groupBy("_key", "source", "_size", "_bucket").agg(F.count("*").alias("_n")))
    sources = targets(counts.groupBy("source").agg(F.sum(F.col("_size") * F.col("_n")).alias("_total"))).withColumn("_key", key).drop("source")
    upto = (Window.unboundedPreceding, -1)
    of_size = counts.groupBy("_key", "_size").agg(F.sum("_n").alias("_n"))
    of_size = of_size.select("_key", "_size", F.coalesce(F.sum("_n").over(Window.partitionBy("_key").orderBy("_size").rowsBetween(*upto)), F.lit(0)).alias("_smaller"))
    of_size = of_size.join(sources, "_key")
    of_bucket = counts.select("_key", "_size", "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy("_key", "_size").orderBy("_bucket").rowsBetween(*upto)), F.lit(0)).alias("_earlier"))
    base = of_bucket.join(of_size, ["_key", "_size"]).select("_key", "_size", "_bucket", (F.col("_smaller") + F.col("_earlier")).alias("_base"), "_total", "_target")
    own = F.row_number().over(Window.partitionBy("_key", "_size", "_bucket").orderBy("_tie", "doc_id", *ties))
    out = rows.withColumn("_own", own).join(base, ["_key", "_size", "_bucket"])
    step = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0))
    offset, rank = uniform(F.lit(seed), F.col("_key")), F.col("_base") + F.col("_own")
    copies = F.floor(step * rank + offset) - F.floor(step * (rank - 1) + offset)
    return out.withColumn("_copies", copies.cast("long")).drop("_key", "_tie", "_bucket", "_own", "_base")


def reports(docs: DataFrame) -> DataFrame:
    """Of every document its size, its source's size and target, and the words that the mix takes of it; see mixed.

    Columns of docs other than doc_id, source and text are not read.
    """
    narrow = stored(docs.select("doc_id", "source", sizes(F.col("text")).alias("_size")))
    return mixed(narrow).select("doc_id", F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def taken(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever they are named.

    Null and blank texts have size 0 and are dealt copies as others are; rows that share a doc_id are ordered by all
    their columns, so that reruns take the same ones; see mixed.
    """
    inner, named = shielded(docs, "doc_id", "source", "text")
    rows = inner.withColumn("_size", sizes(F.col("text"))).withColumn("_row", F.xxhash64(*inner.columns))
    out = mixed(rows, ties=("_row",)).where("_copies > 0")
    return named(out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '\\N')) AS tie,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, coalesce('s' || source, 'n') AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
o AS (
  SELECT *, 2.0::DOUBLE * total / weight AS fills,
         (1.5::DOUBLE * sum(total) OVER () - 2.0::DOUBLE * coalesce(sum(total) OVER (ORDER BY 2.0::DOUBLE * total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 2.0::DOUBLE * total / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
l AS (SELECT coalesce((SELECT level FROM o WHERE level < fills ORDER BY fills, source NULLS LAST LIMIT 1), 0.0::DOUBLE) AS level),
t AS (SELECT source, k, total, least(2.0::DOUBLE * total, weight * l.level) AS target FROM w, l),
r AS (
  SELECT d.doc_id, d.size, t.total, t.target, CASE WHEN t.total > 0 THEN t.target / t.total ELSE 0.0::DOUBLE END AS step,
         CAST(('0x' || substr(md5('{SEED}|' || t.k), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY t.k ORDER BY d.size, d.tie, d.doc_id) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target, CAST(size * (floor(step * rank + u) - floor(step * (rank - 1) + u)) AS BIGINT) AS taken FROM r
"""
