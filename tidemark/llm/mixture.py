"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

With DataFrame functions only. Sizes are summed by source; the sources are then few narrow rows.
The water level rises in rounds: each round fixes the sources at their cap and shares what is left
over the others by weight, until none is above. Inside a source the documents of a stratum (about
``STRATUM_ROWS`` documents by seeded hash, so a large source is many strata) are put in seeded
order: every document is taken the whole number of times, and the first of them once more until the
fraction of the stratum's words is reached, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import bounded_broadcast, materialize

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
STRATUM_ROWS = 1024
SEED = "mix-1"


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` (source, ...) with ``rank`` from 0 in order of code points, null last.

    Ranges of sources are numbered one by one; a range's first number comes from the counts of the
    ranges before it (as many rows as partitions).
    """
    key = (F.col("source").isNull(), F.coalesce("source", F.lit("")))
    ranged = materialize(sources.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    numbered = ranged.withColumn("row", inside).join(F.broadcast(parts.select("part", before.alias("first"))), "part")
    return numbered.withColumn("rank", F.col("first") + F.col("row")).drop("part", "row", "first")


def water_fill(sources: DataFrame) -> DataFrame:
    """source, source_size, target: 150 % of all sizes by weight, none above twice its source's size."""
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int"))
    rows = materialize(ranked_sources(sources).select("source", "source_size", weight.cast("long").alias("weight"), (MAX_EPOCHS * F.col("source_size")).alias("cap")), "weights")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"]
    hundredths, full = SHARE_PERCENT * total, -1
    level, capped, open_weight = 0.0, 0, 0
    while True:
        # cap <= weight * level, where level = (hundredths - 100 * capped) / (100 * open weight), in whole numbers
        full_now = F.lit(False) if full < 0 else F.col("cap").cast("decimal(38,0)") * (100 * open_weight) <= F.col("weight") * F.lit(hundredths - 100 * capped).cast("decimal(38,0)")
        got = rows.agg(F.coalesce(F.sum(F.when(full_now, F.col("cap"))), F.lit(0)).alias("cap"), F.coalesce(F.sum(F.when(~full_now, F.col("weight"))), F.lit(0)).alias("weight"), F.count_if(full_now).alias("n")).first()
        if got["n"] == full or not got["weight"]:
            if not got["weight"]:
                level = float("inf")
            break
        full, capped, open_weight = got["n"], int(got["cap"]), int(got["weight"])
        level = (hundredths - 100 * capped) / 100 / open_weight
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source).

    Null or empty text: size 0, taken 0. Null sources are one source, the last. Repeated rows are
    rows of their own. Null ids pass through, other columns are ignored, no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The text is part of the key, so that rows without an id, or with one id, are dealt to all strata.
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)), 256)
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.substring(key, 1, 15).alias("key"))
    sized = materialize(sized, "sizes")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sums = materialize(sums, "sources")
    targets = water_fill(sums.select("source", "source_size")).withColumnRenamed("source", "of")
    targets = targets.join(sums.select(F.col("source").alias("s"), "n_docs"), F.col("of").eqNullSafe(F.col("s"))).drop("s")
    strata = F.ceil(F.col("n_docs") / STRATUM_ROWS)
    targets = materialize(targets.withColumn("strata", strata), "targets")
    rows = sized.join(bounded_broadcast(targets, 100_000), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("stratum", F.pmod(F.conv(F.col("key"), 16, 10).cast("long"), F.col("strata")))
    group = Window.partitionBy("source", "stratum")
    order = group.orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("size").over(order) - F.col("size")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rows = rows.withColumn("before", before).withColumn("all", F.sum("size").over(group)).withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.floor(ratio))
    quota = F.floor(F.col("part") * F.col("all") + 0.5)
    again = F.greatest(F.least(quota - F.col("before"), F.col("size")), F.lit(0).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + again).cast("long").alias("taken"))


MIXTURE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) size,
                  substr(sha256('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS "key" FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, count(*) n_docs FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END weight, 2 * source_size cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) r FROM w),
a AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) capped,
             sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) open_weight FROM o),
z AS (SELECT CAST(sum(source_size) AS BIGINT) total FROM s),
l AS (SELECT coalesce(min_by((150 * CAST(total AS HUGEINT) - 100 * CAST(capped AS HUGEINT)) / 100.0 / CAST(open_weight AS DOUBLE), r), CAST('inf' AS DOUBLE)) AS level
      FROM a, z WHERE CAST(cap AS HUGEINT) * 100 * CAST(open_weight AS HUGEINT) > weight * (150 * CAST(total AS HUGEINT) - 100 * CAST(capped AS HUGEINT))),
t AS (SELECT source, source_size, n_docs, least(CAST(cap AS DOUBLE), weight * level) target FROM w, l),
x AS (SELECT d.doc_id, d.size, d.source, t.source_size, t.target, "key", CAST(('0x' || "key") AS BIGINT) % CAST(ceil(n_docs / 1024.0) AS BIGINT) stratum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, sum(size) OVER (PARTITION BY source, stratum ORDER BY "key", doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
             sum(size) OVER (PARTITION BY source, stratum) AS total, coalesce(target / nullif(source_size, 0), 0.0) ratio FROM x)
SELECT doc_id, size, source_size, target,
       CAST(floor(ratio) * size + greatest(least(floor((ratio - floor(ratio)) * total + 0.5) - before, size), 0) AS BIGINT) taken
FROM y
"""
