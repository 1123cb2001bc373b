"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each slot, one bit for each language; the AND of an n-gram's
slots says at once which languages contain it. A text's hits are counted by language over all its
n-grams, corrected for the filter's false positives, and the largest corrected count decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize
from tidemark.llm.textkit import mix, string_slices

# Labelled rows learned from, for each language about so many (by hash of the id).
SAMPLE_PER_LANGUAGE = 2000
GRAM_BYTES = 4
SLOTS = 1 << 18
LEAST_SHARE = 0.02
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte gram that begins at each byte (letters folded, all else a space), and which are whole."""
    b = np.concatenate((_FOLD[data], np.zeros(GRAM_BYTES, np.uint64)))
    n = len(data)
    code = (b[:n] << np.uint64(24)) | (b[1 : n + 1] << np.uint64(16)) | (b[2 : n + 2] << np.uint64(8)) | b[3 : n + 3]
    whole = np.ones(n, bool)
    for k in range(1, GRAM_BYTES):
        at = offsets[1:] - k
        whole[at[(at >= offsets[:-1])]] = False
    spaces = sum(((b[k : n + k] == 32).astype(np.int8) for k in range(GRAM_BYTES)), np.zeros(n, np.int8))
    return code, whole & (spaces <= 2)


def _slots(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(code)
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64)


class LanguageFilter:
    """One filter table for each 64 languages."""

    def __init__(self, languages: list[str], codes: np.ndarray, langs: np.ndarray):
        self.languages = languages
        self.tables = [np.zeros(SLOTS, np.uint64) for _ in range((len(languages) + 63) // 64)]
        self.false = np.zeros(len(languages))
        one, two = _slots(codes.astype(np.uint64))
        for k in range(len(languages)):
            table, bit = self.tables[k // 64], np.uint64(1) << np.uint64(k % 64)
            table[one[langs == k]] |= bit
            table[two[langs == k]] |= bit
            self.false[k] = float(((table & bit) > 0).mean()) ** 2

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Corrected hits, texts by languages."""
        code, whole = grams(data, offsets)
        one, two = _slots(code)
        number = np.diff(np.concatenate(([0], np.cumsum(whole, dtype=np.int64)))[offsets])
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for t, table in enumerate(self.tables):
            mask = table[one] & table[two]
            mask[~whole] = 0
            for k in range(64 * t, min(len(self.languages), 64 * t + 64)):
                bit = (mask >> np.uint64(k % 64)) & np.uint64(1)
                hits = np.diff(np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))[offsets])
                out[:, k] = np.maximum(hits - number * self.false[k], 0) / max(1 - self.false[k], 1e-9)
        return out


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> LanguageFilter:
    """Learn from rows with a language outside the held-out fold; a gram counts for a language if in 2 % of its texts."""
    rows = docs.filter(F.col("lang").isNotNull() & ~_held_out())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(SAMPLE_PER_LANGUAGE / sizes[k]))]), F.col("lang"))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches):
        for batch in batches:
            langs, parts = batch.column(0).to_pylist(), []
            for row, end, data, offsets in string_slices(batch.column(1)):
                code, whole = grams(data, offsets)
                for i in range(end - row):
                    own = slice(offsets[i], offsets[i + 1])
                    parts.append((langs[row + i], np.unique(code[own][whole[own]])))
            for lang in set(langs):
                codes, n = np.unique(np.concatenate([c for k, c in parts if k == lang]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(codes) + 1)), pa.array(np.append(codes.astype(np.int64), -1)), pa.array(np.append(n, langs.count(lang)))], ["lang", "gram", "n"])

    found = materialize(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    texts = {r["lang"]: r["n"] for r in found.filter("gram = -1").collect()}
    if not texts:
        return LanguageFilter(languages, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    least = F.element_at(F.create_map(*[x for k, n in texts.items() for x in (F.lit(k), F.lit(max(1.0, LEAST_SHARE * n)))]), F.col("lang"))
    kept = found.filter((F.col("gram") >= 0) & (F.col("n") >= least)).toPandas()
    return LanguageFilter(languages, kept["gram"].to_numpy(np.int64), kept["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy(np.int64))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    Null texts and texts without a letter are ``und`` with score 0. A tie goes to the first language
    by name. Null ids count as not held out; repeated rows are answered alike; other columns are
    ignored; with no labelled row everything is ``und``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def answer(batches):
        filters = model.value
        for batch in batches:
            for row, end, data, offsets in string_slices(batch.column(1)):
                n = end - row
                letters = np.diff(np.concatenate(([0], np.cumsum((_FOLD[data] >= 97) & (data < 128), dtype=np.int64)))[offsets]) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") if c != "�")
                if not filters.languages:
                    letters[:] = False
                    langs, score = [UNKNOWN] * n, np.zeros(n)
                else:
                    counts = filters.counts(data, offsets) + 1e-9
                    best = counts.argmax(1)
                    score = np.where(letters, counts.max(1) / counts.sum(1), 0.0)
                    langs = [filters.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", "text").mapInArrow(answer, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
