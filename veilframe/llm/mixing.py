"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key, scaled by the inverse of its quality
weight; a source's documents in the order of their keys are a weighted sample
without replacement of any size. A source whose target is e whole epochs and a
rest gives each document e times, and the documents in order of their keys
until their sizes make up the rest.

The prefix sums need no task that sees a whole source: keys fall into equal
buckets, sums of buckets are added up first, and sorting stays within buckets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def sizes(docs: DataFrame, labels: DataFrame | None = None, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """doc_id, source, size in words, and the sampling key of each document.

    The quality weight is 2 for documents labelled 1, 0.5 for 0, 1 for others;
    of several labels of a document the largest counts. Null texts have size 0.
    """
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draw = F.conv(F.substring(F.md5(F.concat(text_id, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    u = (draw + F.lit(0.5)) / F.lit(float(1 << 52))
    out = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"))
    weight = F.lit(1.0)
    if labels is not None:
        quality = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        out = out.join(quality, "doc_id", "left")
        weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return out.select("doc_id", "source", "size", (-F.ln("u") / weight).alias("key"))


def targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """by_source: source, source_size. Adds target: all words dealt by weight, at most `most` times a source's size.

    Sources in code point order, null last, weigh as in weights, repeating.
    What exceeds a cap is dealt again by weight: the targets are
    min(level * weight, cap), and the level is that of the first source, by
    cap / weight, which it fits under.
    """
    listed = ", ".join(map(str, weights))
    return by_source.sparkSession.sql(f"""
      WITH weighed AS (
        SELECT source, source_size, {most} * source_size AS cap,
               element_at(array({listed}), CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS INT)) AS weight
        FROM {{by_source}}),
      steps AS (
        SELECT *, sum(source_size) OVER () AS total,
               sum(cap) OVER (up) - cap AS capped, sum(weight) OVER () - (sum(weight) OVER (up) - weight) AS open_weight
        FROM weighed WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
      leveled AS (SELECT *, CAST(total - capped AS DOUBLE) / open_weight AS level FROM steps),
      found AS (SELECT min_by(level, CAST(cap AS DOUBLE) / weight) AS level FROM leveled WHERE level * weight <= cap)
      SELECT source, source_size, least(coalesce(found.level, 0) * weight, CAST(cap AS DOUBLE)) AS target
      FROM weighed, found""", by_source=by_source)


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: int = 7, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for each document.

    copies counts how often the document is in the mix, taken is that times its
    size. Documents of equal key are taken in order of doc_id, null last. The
    last one is taken if that brings the source nearer to its target. Repeated
    rows are documents of their own. Sources of no words have target 0.
    """
    drawn = written(sizes(docs, labels, seed, weights), "sizes")
    number = max(4, math.isqrt(drawn.count()))
    drawn = drawn.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * number))
    buckets = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    aim = targets(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    buckets = buckets.withColumn("before", before)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    buckets = buckets.join(aim, same(buckets, aim), "left").select(buckets["source"].alias("b_source"), F.col("bucket").alias("b_bucket"), "before", "source_size", "target")
    joined = drawn.join(buckets, (F.col("bucket") == F.col("b_bucket")) & F.col("source").eqNullSafe(F.col("b_source")))
    order = Window.partitionBy("source", "bucket").orderBy("key", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.col("before") + F.sum("size").over(order) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    copies = epochs + F.when((F.col("size") > 0) & (prefix + F.col("size") / 2 <= rest), 1).otherwise(0)
    out = joined.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op8_mixing(spark, sf_dir):
    """The mix of all documents; nulls, ties and repeats as in mix()."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(documents(spark, sf_dir), labels).select("doc_id", "size", "source_size", "target", "taken")


#: The same by one ordered pass over each source. {documents} is a table of doc_id, text and source.
SQL = r"""
WITH quality AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
drawn AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':7'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
  FROM {documents} d LEFT JOIN quality q ON d.doc_id = q.doc_id),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sums),
steps AS (
  SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER up - cap AS capped,
         sum(weight) OVER () - (sum(weight) OVER up - weight) AS open_weight
  FROM weighed WINDOW up AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
leveled AS (SELECT *, (total - capped)::DOUBLE / open_weight::DOUBLE AS level FROM steps),
found AS (SELECT arg_min(level, cap::DOUBLE / weight) AS level FROM leveled WHERE level * weight <= cap),
aim AS (SELECT source, source_size, least(coalesce(found.level, 0) * weight, cap::DOUBLE) AS target FROM weighed, found),
ranked AS (
  SELECT d.*, a.source_size, a.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size AS prefix,
         CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS epochs
  FROM drawn d JOIN aim a ON d.source IS NOT DISTINCT FROM a.source),
mixed AS (
  SELECT *, (epochs + CASE WHEN size > 0 AND prefix + size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM ranked)
"""
OP8_SQL = SQL.replace("{documents}", "documents") + "SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"
