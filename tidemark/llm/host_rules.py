"""Quality rules with host verdicts, with DataFrame functions only.

Each text gets counts and its own base verdict. Rule failures are then added up by host (the
``source`` of a document), the hosts' failure rates are shrunk toward an empirical beta prior, and a
host whose shrunk rate is above ``HOST_RATE`` fails all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import SPACES, gram_hashes, let, words
from tidemark.llm.scratch import bounded_broadcast, materialize

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW_WORDS = 5
SYMBOLS = "#*$%&|<>"
SYMBOL_PERCENT = 10
DUP_LINE_PERCENT = 30
HOST_RATE = 0.5


def repeated_words(hashes: Column) -> Column:
    """Words inside 5-word windows that are found twice or more, the first included."""

    def covered(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["g"] == F.get(s, j)["g"]
            at = F.filter(s, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.array_sort(F.transform(at, lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW_WORDS - F.greatest(a["end"], p)).alias("n"), (p + WINDOW_WORDS).alias("end"))
        return let(ordered, lambda s: F.aggregate(twice(s), start, step, lambda a: a["n"]))

    none = F.lit(0).cast("long")
    return let(gram_hashes(hashes, WINDOW_WORDS), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(covered(g)))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of each text; null: none of anything."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(F.col("text"), SPACES),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n_symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), of_words.alias("w"), n_symbols.alias("n_symbols"), of_lines.alias("l"))
    return rows.select("doc_id", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def host_verdicts(counts: DataFrame) -> DataFrame:
    """source, n_docs, n_failed, shrunk_rate, host_ok of every host.

    The beta prior has the mean and the variance of the hosts' rates; hosts alike in rate give a
    prior of at most 1,000 documents, a single host or no failures one of 2.
    """
    hosts = counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    strength = F.least(F.greatest(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(2.0)), F.lit(1000.0))
    prior = prior.select("m", F.coalesce(strength, F.lit(2.0)).alias("k")).first()
    mean, k = F.lit(prior["m"] or 0.0), F.lit(prior["k"])
    shrunk = (F.col("n_failed") + mean * k) / (F.col("n_docs") + k)
    return hosts.select("source", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= HOST_RATE).alias("host_ok"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): counts, base_failed, kept and the host's figures.

    Null or empty text: no words, so base_failed. Null sources are one host. Repeated rows count each
    time. Null ids pass through, other columns are ignored, no rows give no rows.
    """
    counts = text_counts(docs)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    failed = base | (100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"))
    counts = materialize(counts.withColumn("base_failed", base).withColumn("failed", failed), "counts")
    hosts = materialize(host_verdicts(counts).withColumnRenamed("source", "host"), "verdicts")
    out = counts.join(bounded_broadcast(hosts, 100_000), F.col("source").eqNullSafe(F.col("host")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM documents),
g AS (SELECT doc_id, p, list_slice(w, p, p + 4) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) p FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT q) n FROM (SELECT doc_id, unnest(range(p, p + 5)) q FROM r) GROUP BY doc_id),
c AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) n_repeat_words, len(l) n_lines
      FROM d LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM c),
h AS (SELECT source, count(*) n, sum(CASE WHEN base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines THEN 1 ELSE 0 END) x FROM f GROUP BY source),
p AS (SELECT avg(x / n) m, var_samp(x / n) v FROM h),
k AS (SELECT m, coalesce(least(greatest(m * (1 - m) / nullif(v, 0) - 1, 2.0), 1000.0), 2.0) k FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (h.x + k.m * k.k) / (h.n + k.k) <= 0.5 kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source CROSS JOIN k
"""
