"""Benchmark decontamination by winnowing, with DataFrame functions only.

A fingerprint is the smallest hash of 8 successive 6-grams, so any 13 shared words share one. The
fingerprints of documents are joined with those of the benchmark. Hits are extended: for documents
that share any, every 13-word window is compared with the windows of the benchmark, and the union of
matching windows is what is hit. An item of fewer words is one window of its own length; documents
are looked through for those lengths (at most 12) as they occur in the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import ALPHANUMERIC_GAPS, gram_hashes, let, running_min, words
from tidemark.llm.scratch import bounded_broadcast, materialize

WINDOW_WORDS = 13
GRAM_WORDS = 6
WINNOW = WINDOW_WORDS - GRAM_WORDS + 1


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text, ALPHANUMERIC_GAPS, lower=True), lambda w: F.xxhash64(w))


def _fingerprints(hashes: Column, short: list[int]) -> Column:
    parts = [running_min(gram_hashes(hashes, GRAM_WORDS), WINNOW)]
    parts += [F.transform(gram_hashes(hashes, n), lambda g, n=n: F.xxhash64(F.lit(n), g)) for n in short]
    return F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0])


def _windows(hashes: Column, lengths: list[int]) -> Column:
    """(pos, len, hash) of all windows of the given lengths."""
    one = lambda n: F.transform(gram_hashes(hashes, n), lambda g, i: F.struct(i.alias("pos"), F.lit(n).alias("len"), g.alias("hash")))
    return F.concat(*[one(n) for n in lengths]) if len(lengths) > 1 else one(lengths[0])


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (pos, len) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(a: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        return F.struct((a["n"] + F.greatest(end - F.greatest(a["end"], s["pos"]), F.lit(0))).alias("n"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (ids
    sorted as strings), contaminated (n_hit > 0 and at least 5 % of the words). Null texts have no
    words; items without words or without an id occur nowhere; repeated rows are all returned; null
    doc_ids pass through; other columns are ignored; an empty benchmark hits nothing. ``with_hash`` adds
    text_hash (xxhash64 of the text), which with doc_id says what was judged.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    items = benchmark.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), _word_hashes(F.col("text")).alias("h"))
    items = materialize(items.filter(F.size("h") > 0), "items")
    short = sorted(r[0] for r in items.filter(F.size("h") < WINDOW_WORDS).select(F.size("h")).distinct().collect())
    lengths = [WINDOW_WORDS, *short]

    of_length = F.filter(_windows(F.col("h"), lengths), lambda w: w["len"] == F.least(F.size("h"), F.lit(WINDOW_WORDS)))
    windows = materialize(items.select("item_id", F.explode(of_length).alias("w")).select("item_id", "w.len", "w.hash").distinct(), "windows")
    own = F.when(F.size("h") >= WINDOW_WORDS, _fingerprints(F.col("h"), [])).otherwise(F.array_distinct(_fingerprints(F.col("h"), short)))
    prints = materialize(items.select(F.explode(own).alias("fp")).distinct(), "prints")

    both = let(_word_hashes(F.col("text")), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _fingerprints(h, short).alias("fps")))
    base = materialize(docs.select("doc_id", "th", both.alias("x")).select("doc_id", "th", "x.n_words", "x.fps"), "fingerprints")
    hits = base.select("doc_id", "th", F.explode("fps").alias("fp")).join(bounded_broadcast(prints), "fp")
    hits = materialize(hits.select("doc_id", "th").distinct(), "hits")

    near = docs.alias("d").join(bounded_broadcast(hits).alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.th") == F.col("k.th")), "left_semi")
    places = near.select("doc_id", "th", F.explode(let(_word_hashes(F.col("text")), lambda h: _windows(h, lengths))).alias("w"))
    # A window is looked up once for each place, its items once for each document that has it.
    kinds = bounded_broadcast(materialize(windows.select("len", "hash").distinct(), "kinds"))
    found = places.select("doc_id", "th", "w.pos", "w.len", "w.hash").join(kinds, ["len", "hash"])
    spans, hit = F.sort_array(F.collect_set(F.struct("pos", "len"))), F.collect_set(F.struct("len", "hash"))
    found = materialize(found.groupBy("doc_id", "th").agg(spans.alias("spans"), hit.alias("hit")), "spans")
    ids = found.select("doc_id", "th", F.explode("hit").alias("w")).select("doc_id", "th", "w.len", "w.hash").join(bounded_broadcast(windows), ["len", "hash"])
    ids = ids.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    found = found.select("doc_id", "th", _covered(F.col("spans")).alias("n_hit")).alias("s").join(ids.alias("i"), F.col("s.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("s.th").eqNullSafe(F.col("i.th"))))
    found = materialize(found.select("s.doc_id", "s.th", "n_hit", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("ids")), "found")

    out = base.select("doc_id", "th", "n_words").alias("b").join(bounded_broadcast(found).alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.th") == F.col("f.th")), "left")
    n_hit = F.coalesce("f.n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("b.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("f.n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("f.ids", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        *([F.col("b.th").alias("text_hash")] if with_hash else []),
    )


CONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM {docs}),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) l, list_slice(w, p, p + least(13, len(w)) - 1) g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) p FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, p, list_slice(w, p, p + l - 1) g FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) p FROM d, ls WHERE len(w) >= l)),
m AS (SELECT doc_id, p, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) q FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) n_items, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) i FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
