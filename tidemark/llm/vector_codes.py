"""Product codes of vectors: integer Lloyd rounds, pruned by Elkan's bounds.

A vector is cut into equal parts and every part is coded by the nearest entry of its codebook. Rows
are written with an upper bound of the distance from each part to its entry and a lower bound to
every entry. After an update the bounds are shifted by how far the entries moved; an entry is looked
at only if no bound shows that it is farther than the present one. Pruning is strict, so an entry at
an equal distance is always looked at, and what is looked at is compared by integers: codes are those
of the full search. Codebooks are parts x entries rows of integers, whatever the number of vectors;
sums are made in the tasks and by one grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import attach, discard, materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Components are integers below this bound, so that squared distances are whole 64-bit numbers.
LARGEST = 1 << 28
AT_ONCE = 2048

STATE = "vec_id long, label string, v array<int>, codes binary, upper binary, lower binary, shift binary"


def integer_vectors(rows: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of the vectors without null and non-finite components.

    Empty vectors go too. The width is that of the first row by vec_id; vectors of other widths go. A
    width that is no multiple of ``parts`` is filled up with zeros. A component of 2^28 or more is an error.
    """
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0)).filter(whole)
    first = some.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(1).select(F.size("x").alias("w")).first()
    width = first.w if first else parts
    value = lambda c: F.floor(c * scale)
    safe = lambda c: F.when(F.abs(value(c)) < LARGEST, value(c).cast("int")).otherwise(F.raise_error(F.lit(f"a component is too large: scaled it must be below {LARGEST}")).cast("int"))
    fill = F.array_repeat(F.lit(0), -width % parts)
    return some.filter(F.size("x") == width).select("vec_id", "label", F.concat(F.transform("x", safe), fill).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _bytes(column: pa.Array, kind) -> np.ndarray:
    """Binary values of equal lengths as one row each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(kind).reshape(len(column), -1)


def _binary(table: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(table).view(np.uint8).reshape(len(table), -1)
    offsets = (np.arange(len(table) + 1) * raw.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def _up(x: np.ndarray) -> np.ndarray:
    """A float32 that is no smaller."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, whole numbers, of each row of ``x`` to each entry."""
    out = np.zeros((len(x), len(book)), np.int64)
    for d in range(book.shape[1]):
        step = x[:, d, None] - book[None, :, d]
        out += step * step
    return out


def _packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds in a byte each, rounded down, with one shift for a row."""
    most = lower.max(1, initial=0)
    shift = np.zeros(len(lower), np.uint8)
    while (over := most / np.exp2(shift) >= 256).any():
        shift[over] += 1
    return np.floor(lower / np.exp2(shift)[:, None]).astype(np.uint8), shift


class Books:
    """Codebooks (parts x entries x width, integers) and what a round needs to know of them: moves and distances between entries."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.moved = None if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
        gap = np.stack([np.sqrt(_squares(b, b).astype(np.float64)) for b in entries]) if len(entries) else np.zeros((0, 0, 0))
        self.half_gap = gap * (0.5 * (1 - 1e-12))

    def first(self, x: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, upper and lower bounds of a full search."""
        d2 = _squares(x, self.entries[part])
        code = d2.argmin(1)  # the first of equals
        far = np.sqrt(d2.astype(np.float64))
        return code, far[np.arange(len(x)), code] * (1 + 1e-12), far * (1 - 1e-12)

    def again(self, x: np.ndarray, part: int, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from the bounds of the round before, and how many distances it took."""
        book, gap = self.entries[part], self.half_gap[part]
        upper = (upper + self.moved[part][code]) * (1 + 1e-12)
        lower = np.maximum(lower - self.moved[part], 0) * (1 - 1e-12)
        rows = np.arange(len(x))

        def open_entries(at: np.ndarray) -> np.ndarray:
            bound = upper[at, None]
            maybe = (lower[at] <= bound) & (gap[code[at]] <= bound)
            maybe[np.arange(len(at)), code[at]] = False
            return maybe

        some = rows[open_entries(rows).any(1)]
        step = x[some] - book[code[some]]
        best = (step * step).sum(1)
        upper[some] = np.sqrt(best.astype(np.float64)) * (1 + 1e-12)
        i, entry = np.nonzero(open_entries(some))
        step = x[some[i]] - book[entry]
        d2 = (step * step).sum(1)
        lower[some[i], entry] = np.sqrt(d2.astype(np.float64)) * (1 - 1e-12)
        lower[some, code[some]] = np.sqrt(best.astype(np.float64)) * (1 - 1e-12)
        # of each row the present entry and those looked at: least distance first, then the lower index
        row, dist, index = np.concatenate((np.arange(len(some)), i)), np.concatenate((best, d2)), np.concatenate((code[some], entry))
        order = np.lexsort((index, dist, row))
        head = order[np.unique(row[order], return_index=True)[1]]
        code = code.copy()
        code[some], upper[some] = index[head], np.sqrt(dist[head].astype(np.float64)) * (1 + 1e-12)
        return code, upper, lower, len(some) + len(i)


def _assign(books: Books, fresh: bool):
    """Codes and bounds of each row: by a full search if ``fresh``, else by the bounds that it has."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                v, n = _matrix(part.column(2)), part.num_rows
                codes, upper, shift = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.uint8)
                lower = np.zeros((n, parts, entries), np.uint8)
                if not fresh:
                    codes, upper, shift = _bytes(part.column(3), np.uint8).copy(), _bytes(part.column(4), np.float32).copy(), _bytes(part.column(6), np.uint8).copy()
                    lower = _bytes(part.column(5), np.uint8).reshape(n, parts, entries).copy()
                for p in range(parts):
                    x = v[:, p * width : (p + 1) * width]
                    if fresh:
                        code, up, low = books.first(x, p)
                    else:
                        code, up, low, _ = books.again(x, p, codes[:, p].astype(np.int64), upper[:, p].astype(np.float64), lower[:, p] * np.exp2(shift[:, p])[:, None])
                    codes[:, p], upper[:, p] = code, _up(up)
                    lower[:, p], shift[:, p] = _packed(low)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), _binary(codes), _binary(upper), _binary(lower.reshape(n, -1)), _binary(shift)], ["vec_id", "label", "v", "codes", "upper", "lower", "shift"])

    return run


def _updated(rows: DataFrame, books: Books) -> np.ndarray:
    """Entries as floor(sum / count) of the parts that have them; unused ones stay. Tasks send a row for each entry that they use."""
    parts, entries, width = books.entries.shape

    def sums(batches) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, codes = _matrix(batch.column(0)), _bytes(batch.column(1), np.uint8)
            for p in range(parts):
                slot = p * entries + codes[:, p].astype(np.int64)
                np.add.at(total, slot, v[:, p * width : (p + 1) * width])
                count += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(count)
        cells = pa.ListArray.from_arrays(pa.array((np.arange(len(used) + 1) * width).astype(np.int32)), pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), cells], ["slot", "n", "total"])

    some = rows.select("v", "codes").mapInArrow(sums, "slot long, n long, total array<long>")
    got = some.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(width)]).collect()
    out = books.entries.copy()
    for r in got:  # parts x entries rows at most
        out[divmod(r.slot, entries)] = [r[f"t{d}"] // r.n for d in range(width)]
    return out


def _errors(books: Books):
    def run(batches) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.entries.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            v, codes = _matrix(batch.column(2)), _bytes(batch.column(3), np.uint8).astype(np.int64)
            near = np.concatenate([books.entries[p][codes[:, p]] for p in range(parts)], axis=1)
            error = ((v - near) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256 of the vectors that are kept.

    ``rows``: vec_id, embedding, label; more columns are ignored. ``integer_vectors`` says which rows
    are kept. Codebooks start as the first ``entries`` rows by vec_id (null last, then by value; at most 256 entries);
    fewer rows make smaller books. Rows that repeat are all coded. label_error is the sum of error over
    equal labels, nulls together. No rows kept: no rows.
    """
    kept = materialize(integer_vectors(rows, parts), "vectors")
    first = kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Books(np.ascontiguousarray(start))
    blank = F.lit(b"").alias
    state = materialize(kept.select("*", blank("codes"), blank("upper"), blank("lower"), blank("shift")).mapInArrow(_assign(books, True), STATE), "codes", "zstd")
    for _ in range(rounds):
        books = Books(_updated(state, books), books.entries)
        following = materialize(state.mapInArrow(_assign(books, False), STATE), "codes", "zstd")
        discard(state)
        state = following
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    coded = materialize(state.mapInArrow(_errors(books), "vec_id long, label string, code string, error long"), "coded")
    labels = materialize(coded.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "label-errors")
    discard(state, kept)
    return attach(coded, labels, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
