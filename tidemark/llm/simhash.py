"""SimHash near-duplicates: fingerprints of 64 bits that differ in few bits, by meeting in the middle.

A fingerprint's bit is 1 if over half of the text's word shingles have it in their XXH64. Equal
fingerprints collapse to one row first. Each distinct one then emits all variants within half the
radius (for two bits: itself and its 64 neighbours), and the variants are the shuffle key: two
fingerprints within the radius share the variants half-way between them, and those of one variant
are within the radius of each other. So a group has at most 65 members however many copies a text
has, and no group needs a cap. Pairs are verified and deduplicated.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.scratch import attach, discard, materialize

SHINGLE_WORDS = 3
RADIUS = 2
BITS = 64
SEED = 42
AT_ONCE = 1 << 16

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces, repeats included; of all words if they are fewer; A-Z count as a-z."""
    words = text.translate(_LOWER).split()  # bytes split at 0x20 and 0x09-0x0D, no other characters
    if len(words) <= size:
        return np.fromiter([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, spans = xxhash.xxh64_intdigest, zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes``, as a signed number; none: 0."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = np.ascontiguousarray(hashes[at : at + AT_ONCE]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) of every row of ``docs`` (doc_id, text)."""

    def sign(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(shingle_hashes(t.as_py(), size)) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sign, "doc_id long, fp long")


def _masks(flips: int) -> list[int]:
    """Every number of 64 bits with at most ``flips`` ones, signed."""
    made = [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in made]


def _colliding(radius: int):
    """Of rows (variant, fp) in order of variant the pairs a < b of one variant that differ in at most ``radius`` bits."""

    def pairs(batches) -> Iterator[pa.RecordBatch]:
        held_v, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in (*batches, None):
            if batch is None:
                v, f, ready = held_v, held_f, len(held_v)
            else:
                v, f = (np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate((held_v, held_f)))
                ready = int(np.searchsorted(v, v[-1])) if len(v) else 0  # the last group may go on
            held_v, held_f, v, f = v[ready:], f[ready:], v[:ready], f[:ready]
            one, two, at, d = [], [], np.arange(len(v)), 0
            while len(at):
                d += 1
                at = at[at + d < len(v)]
                at = at[v[at] == v[at + d]]
                one.append(np.minimum(f[at], f[at + d]))
                two.append(np.maximum(f[at], f[at + d]))
            if one:
                a, b = np.concatenate(one), np.concatenate(two)
                ok = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return pairs


def near_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The pairs a < b of the distinct numbers ``distinct`` (fp) that differ in at most ``radius`` bits (an even number)."""
    if radius % 2:
        raise ValueError("the radius is halved, so it must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(radius // 2)])
    ball = distinct.select(F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("variant"), "fp")
    return ball.repartition("variant").sortWithinPartitions("variant").mapInArrow(_colliding(radius), "a long, b long").distinct()


def simhash_classes(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links of every row of ``docs`` (doc_id, text; more columns are ignored).

    component_id is the smallest doc_id reachable over fingerprints that differ in at most ``radius``
    bits, the row's own included; n_links counts the other fingerprints within the radius. Null, empty
    and blank texts have the fingerprint zero and link like any other. Rows that repeat are all
    returned. A row without an id links too, and has its class's id: null if no row there has one.
    No rows: no rows.
    """
    signed = materialize(fingerprints(docs, size), "fingerprints")
    prints = materialize(signed.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "prints")
    links = materialize(near_fingerprints(prints.select("fp"), radius), "print-links")
    comps = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = materialize(comps.join(prints.select(F.col("fp").alias("node"), "first"), "node").join(degree, "node"), "print-classes")
    least = known.groupBy("comp").agg(F.min("first").alias("least"))
    linked = known.join(least, "comp").select(F.col("node").alias("fp"), "least", "n_links")
    marks = prints.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    marks = materialize(marks, "print-marks")
    discard(links, known)
    return attach(signed, marks, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
