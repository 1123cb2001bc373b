"""A class-based n-gram language model: word classes by exchange clustering.

Counts cover every training text and every training word has a class of its own by exchange. Words
are 64-bit hashes. The ``ANCHORS`` most frequent words settle first: each sweep counts, over all
training texts, the classes beside each of them, and moves half of them, each to the class that
raises the likelihood of class pairs most; the next sweep counts anew. Then every other word, however
rare, is put where its own neighbours' classes gain most, and swept too: each sweep counts class pairs
with all words in their classes and moves half of the words. What these words have beside them is
summed by word and dealt by word; a neighbour that is no anchor counts there as one open class. A token's probability is class transition times
word emission, both smoothed; a word that no training text has is one unknown type with a class of
its own.

The sweeps of the anchors do not read the texts again: these are written once as numbers of anchors,
two bytes a token. What tasks count in a sweep moves as blocks of ``BLOCK`` cells, summed by block.

The table of words grows with the corpus and is joined by shuffle. Only its head, at most ``HEAD``
most frequent words, is sent to all tasks, which spares those words the join and changes no figure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import discard, materialize
from tidemark.llm.textkit import string_slices, word_hashes, word_spans

HEAD = 1 << 17
ANCHORS = 1 << 13
CLASSES = 62
OPEN, END_CLASS, ALL = CLASSES, CLASSES + 1, CLASSES + 2
SWEEPS = 3
OPEN_SWEEPS = 2
SLICE = 1 << 15
BLOCK = 512
RUN = 1 << 20
OPEN_WORDS = "h long, class int, n long, cells array<struct<sides:int,n:long>>"
END = np.uint64(0x243F6A8885A308D3)
WORD_ADD, CLASS_ADD, PRIOR = 0.5, 0.1, 10


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of all tokens with END after each text, text of each token)."""
    for row, end, data, offsets in string_slices(column):
        starts, ends, first = word_spans(data, offsets)
        n = end - row
        texts = np.repeat(np.arange(n), np.diff(first))
        hashes = np.full(len(starts) + n, END, np.uint64)
        where = np.full(len(hashes), -1, np.int64)
        at = np.arange(len(starts)) + texts
        hashes[at], where[at] = word_hashes(data, starts, ends), texts
        where[where < 0] = np.arange(n)
        yield row, end, hashes, where


class Places:
    """Where hashes are among sorted words: few have the same leading bits, so few are compared."""

    def __init__(self, words: np.ndarray):
        bits = (4 * len(words)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.words = np.append(words, words[-1:])  # the end of the last run; a hash that is sent there is larger
        self.first = np.zeros((1 << bits) + 1, np.int32)
        if len(words):
            np.cumsum(np.bincount((words >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        run = (hashes >> self.shift).astype(np.int64)
        at = self.first[run]
        out = np.where(self.words[at] == hashes, at, -1)
        left = np.flatnonzero((out < 0) & (self.first[run + 1] > at + 1))
        at = at[left]
        while len(left):
            at += 1
            hit = self.words[at] == hashes[left]
            out[left[hit]] = at[hit]
            more = ~hit & (at + 1 < self.first[run[left] + 1])
            left, at = left[more], at[more]
        return out.astype(np.int64)


class WordClasses:
    """Sorted hashes of some words and their classes; END has its own class and all else is open."""

    def __init__(self, words: np.ndarray, classes: np.ndarray):
        self.words, self.classes, self.places = words, classes, Places(words)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and each word's place or -1."""
        at = self.places.of(hashes)
        classes = np.where(at >= 0, self.classes[at] if len(self.words) else OPEN, OPEN)
        return np.where(hashes == END, END_CLASS, classes), at

    def by_id(self) -> np.ndarray:
        """Classes by number, as ``anchor_ids`` has them: the words, then every other word as one, then END."""
        return np.append(self.classes, [OPEN, END_CLASS]).astype(np.uint8)

    def id_type(self) -> np.dtype:
        return np.min_scalar_type(len(self.words) + 1)


def _binaries(data: np.ndarray, cut: np.ndarray) -> pa.BinaryArray:
    """Rows of ``data`` that begin at ``cut`` (one more than rows), as bytes."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _joined(column: pa.Array, kind: type | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``_binaries``."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data.view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def word_counts(train: DataFrame) -> DataFrame:
    """(h, n) of every distinct token of the training texts, END included."""

    def count(batches):
        for batch in batches:
            hashes = np.concatenate([h for _, _, h, _ in _tokens(batch.column(0))] or [np.zeros(0, np.uint64)])
            words, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["h", "n"])

    return train.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def anchor_ids(train: DataFrame, words: WordClasses) -> DataFrame:
    """(ids) of every row of ``train``: the numbers of its tokens, one after another, in as few bytes as they fit."""

    def number(batches):
        for batch in batches:
            for row, end, hashes, where in _tokens(batch.column(0)):
                ids = words.places.of(hashes)
                ids[ids < 0] = len(words.words)
                ids[hashes == END] = len(words.words) + 1
                yield pa.RecordBatch.from_arrays([_binaries(ids.astype(words.id_type()), np.searchsorted(where, np.arange(end - row + 1)))], ["ids"])

    return train.select("text").mapInArrow(number, "ids binary")


def neighbour_counts(train: DataFrame, words: WordClasses, ids: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class pairs (left, right), and for each of ``words`` the classes to its left and right.

    Both tables have a fixed size; tasks add up their own before anything moves, and blocks of cells
    are summed by block. ``ids``: the ``anchor_ids`` of ``train``, if they are written already.
    """
    of, kind = words.by_id(), words.id_type()
    cells = len(of) * ALL
    blocks = -(-2 * cells // BLOCK)

    def count(batches):
        sides = np.zeros(blocks * BLOCK, np.int64)
        for batch in batches:
            own, _ = _joined(batch.column(0), kind)
            cls = np.concatenate((of[-1:], of[own], of[-1:]))  # texts end by END, so each begins after one
            for k in range(0, len(own), RUN):
                at = own[k : k + RUN].astype(np.int64) * ALL
                sides[:cells] += np.bincount(at + cls[k : k + len(at)], minlength=cells)
                sides[cells : 2 * cells] += np.bincount(at + cls[k + 2 : k + 2 + len(at)], minlength=cells)
        sides = sides.reshape(blocks, BLOCK)
        some = np.flatnonzero(sides.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), _binaries(sides[some].ravel(), np.arange(len(some) + 1) * BLOCK)], ["block", "n"])

    def add(batches):
        sums = {}
        for batch in batches:
            block, (n, _) = batch.column(0).to_numpy(), _joined(batch.column(1), np.int64)
            for b, row in zip(block.tolist(), n.reshape(-1, BLOCK), strict=True):
                if b in sums:
                    sums[b] += row
                else:
                    sums[b] = row.copy()
        n = np.concatenate([*sums.values(), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), _binaries(n, np.arange(len(sums) + 1) * BLOCK)], ["block", "n"])

    ids = anchor_ids(train, words) if ids is None else ids
    rows = ids.mapInArrow(count, "block long, n binary").repartition("block").mapInArrow(add, "block long, n binary").toArrow()
    sides = np.zeros((blocks, BLOCK), np.int64)
    for batch in rows.to_batches():
        sides[batch.column("block").to_numpy()] = _joined(batch.column("n"), np.int64)[0].reshape(-1, BLOCK)
    sides = sides.ravel()[: 2 * cells].reshape(2, len(of), ALL)
    pairs = np.zeros((ALL, ALL), np.int64)
    np.add.at(pairs, of, sides[0])
    return pairs.T.copy(), sides[:, : len(words.words)]


def _sum_pairs(rows: DataFrame, words: WordClasses | None = None) -> np.ndarray:
    """Class pairs of texts, which are a byte of class a token or else the ``anchor_ids`` of ``words``."""
    of, kind = (words.by_id(), words.id_type()) if words else (np.arange(ALL, dtype=np.uint8), np.dtype(np.uint8))

    def count(batches):
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            own, _ = _joined(batch.column(0), kind)
            cls = np.concatenate((of[-1:], of[own]))
            for k in range(0, len(own), RUN):
                right = cls[k + 1 : k + 1 + RUN]
                total += np.bincount(cls[k : k + len(right)] * np.int64(ALL) + right, minlength=ALL * ALL)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    sums = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ALL * ALL, np.int64)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(ALL, ALL)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, sides: np.ndarray, classes: np.ndarray, counts: np.ndarray, moving: np.ndarray, total: np.ndarray | None = None) -> np.ndarray:
    """The classes after each of the ``moving`` words went to its best one, all judged by the same counts.

    A word is taken out of its class before it is judged; ties go to the first class.
    """
    table, total, out = pairs.astype(np.float64), pairs.sum(0).astype(np.float64) if total is None else total, classes.copy()
    for w in np.flatnonzero(moving):
        left, right, n, was = sides[0, w].astype(np.float64), sides[1, w].astype(np.float64), float(counts[w]), classes[w]
        i, j = np.flatnonzero(left), np.flatnonzero(right)
        into, onto, size = table[i, :CLASSES].copy(), table[:CLASSES, j].copy(), total[:CLASSES].copy()
        into[:, was] -= left[i]
        onto[was] -= right[j]
        size[was] -= n
        into, onto, size = np.maximum(into, 0), np.maximum(onto, 0), np.maximum(size, 0)  # a word beside itself is in both
        gain = (_xlogx(into + left[i, None]) - _xlogx(into)).sum(0) + (_xlogx(onto + right[None, j]) - _xlogx(onto)).sum(1)
        out[w] = int(np.argmax(gain - 2 * (_xlogx(size + n) - _xlogx(size))))
    return out


def _best_classes(cut: np.ndarray, left: np.ndarray, right: np.ndarray, n: np.ndarray, table: np.ndarray, total: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(classes, counts) of the words whose cells (left class, right class, times) begin at ``cut``: ``exchange`` of many words at once.

    ``own``: the classes the words have now; each word is taken out of its own before it is judged.
    """
    number = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    counts = np.add.reduceat(n, cut[:-1]).astype(np.float64)
    size = np.repeat(total[None, :CLASSES], len(counts), 0)
    if own is not None:
        size[np.arange(len(own)), own] -= counts
        size = np.maximum(size, 0)
    gain = -2 * (_xlogx(size + counts[:, None]) - _xlogx(size))
    for side, known in ((left, table[:, :CLASSES]), (right, table[:CLASSES].T)):
        cells, where = np.unique(number * ALL + side, return_inverse=True)
        times = np.bincount(where, n)
        was = known[cells % ALL]
        if own is not None:
            was[np.arange(len(cells)), own[cells // ALL]] -= times
            was = np.maximum(was, 0)
        more = _xlogx(was + times[:, None]) - _xlogx(was)
        gain += np.add.reduceat(more, np.searchsorted(cells, np.arange(len(counts)) * ALL), 0)
    return gain.argmax(1), counts.astype(np.int64)


def _cells(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, cut, left, right, times) of runs of rows with about ``SLICE`` cells."""
    offsets = column.offsets.to_numpy()
    sides, times = (column.values.field(k).to_numpy() for k in ("sides", "n"))
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        part = slice(offsets[row], offsets[end])
        yield row, end, offsets[row : end + 1] - offsets[row], sides[part] // ALL, sides[part] % ALL, times[part]
        row = end


def _settle(table: np.ndarray, total: np.ndarray, sweep: int | None = None, last: bool = False):
    """Rows of ``OPEN_WORDS`` with each word, or in a sweep each second one by its hash, in its best class; if ``last``, without cells."""

    def settle(batches):
        for batch in batches:
            h, classes, counts = (batch.column(k).to_numpy().copy() for k in ("h", "class", "n"))
            moving = np.arange(len(h)) if sweep is None else np.flatnonzero((h & 1) == sweep % 2)
            for row, end, *cells in _cells(batch.column("cells").take(pa.array(moving))):
                some = moving[row:end]
                classes[some], counts[some] = _best_classes(*cells, table, total, None if sweep is None else classes[some])
            kept = [] if last else [batch.column("cells")]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(classes), pa.array(counts), *kept], ["h", "class", "n", "cells"][: 3 + len(kept)])

    return settle


def _with_open(pairs: np.ndarray, words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class pairs and class sizes with the open words in their classes; a neighbour that is open itself stays ``OPEN``."""

    def count(batches):
        sums = np.zeros((2, ALL * ALL))
        for batch in batches:
            classes = batch.column("class").to_numpy()
            for row, end, cut, left, right, n in _cells(batch.column("cells")):
                own = np.repeat(classes[row:end], np.diff(cut))
                sums[0] += np.bincount(left * ALL + own, n, ALL * ALL)
                sums[1] += np.bincount(own * ALL + right, n, ALL * ALL)
        for kind in (0, 1):
            some = np.flatnonzero(sums[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(sums[kind][some].astype(np.int64))], ["kind", "cell", "n"])

    rows = words.mapInArrow(count, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    more = np.zeros((2, ALL * ALL))
    more[rows.column("kind").to_numpy(), rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    more = more.reshape(2, ALL, ALL)
    return pairs + more.sum(0), pairs.sum(0) + more[0].sum(0)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``OPEN_WORDS``, without classes yet, from rows (h, sides, n) sorted by h; a word may go on in the next batch."""

    def words(h, sides, n):
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        cells = pa.StructArray.from_arrays([pa.array(sides), pa.array(n)], ["sides", "n"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(h)).astype(np.int32)), cells)
        return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(np.full(len(first), -1, np.int32)), pa.array(np.zeros(len(first), np.int64)), lists], ["h", "class", "n", "cells"])

    kept = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    for batch in batches:
        kept = [np.concatenate((old, batch.column(k).to_numpy())) for old, k in zip(kept, ("h", "sides", "n"), strict=True)]
        last = int(np.searchsorted(kept[0], kept[0][-1:], "left")[0]) if len(kept[0]) else 0
        if last:
            yield words(*(k[:last] for k in kept))
        kept = [k[last:] for k in kept]
    if len(kept[0]):
        yield words(*kept)


def open_words(train: DataFrame, anchors: WordClasses, then=None) -> DataFrame:
    """Rows of ``OPEN_WORDS``, without classes yet: every training word that is no anchor; ``then`` changes them in the same tasks.

    Occurrences are summed by word and classes beside it before a word's cells meet, so that a word
    has at most ALL x ALL of them, however frequent it is.
    """

    def beside(batches):
        for batch in batches:
            for _, _, hashes, _ in _tokens(batch.column(0)):
                cls, _ = anchors.of(hashes)
                some = np.flatnonzero(cls == OPEN)
                sides = np.where(some > 0, cls[some - 1], END_CLASS) * ALL + cls[np.minimum(some + 1, len(cls) - 1)]
                order = np.lexsort((sides, hashes[some]))
                h, sides = hashes[some][order], sides[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (sides[1:] != sides[:-1])
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(sides[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(h))).astype(np.int32))], ["h", "sides", "n"])

    rows = train.select("text").mapInArrow(beside, "h long, sides int, n int")
    sums = rows.groupBy("h", "sides").agg(F.sum("n").alias("n"))
    return sums.repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: then(_gather(batches)) if then else _gather(batches), OPEN_WORDS)


def _bands(vocabulary: DataFrame) -> list:
    """(band, words, tokens) by frequency band, most frequent first: a few hundred rows."""
    return vocabulary.groupBy("band").agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("band")).collect()


def _most_frequent(vocabulary: DataFrame, bands: list) -> pa.Table:
    """The ``ANCHORS`` most frequent words (END is none), ties by unsigned hash; only bands that can hold them are sorted."""
    least, size = None, 0
    for r in bands:
        if size > ANCHORS:
            break
        least, size = r["band"], size + r["v"]
    rows = vocabulary.filter((F.col("band") >= F.lit(least)) & (F.col("h") != F.lit(int(END.view(np.int64)))))
    return rows.orderBy(F.desc("n"), F.col("h") < 0, "h").limit(ANCHORS).select("h", "n").toArrow()


def cluster(train: DataFrame) -> DataFrame:
    """(h, class, n, band) of every distinct token of the training texts, END included."""
    band = F.floor(F.log2("n") * 32).cast("int")
    vocabulary = materialize(word_counts(train).withColumn("band", band), "vocabulary")
    top = _most_frequent(vocabulary, _bands(vocabulary))
    words, counts = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    rank = np.lexsort((words, -counts))
    order = np.argsort(words[rank])  # sorted by hash; the value is the rank by frequency
    model = WordClasses(words[rank][order], order % CLASSES)
    counts = counts[rank][order]
    ids = materialize(anchor_ids(train, model), "ids", "zstd")
    for sweep in range(SWEEPS):
        pairs, sides = neighbour_counts(train, model, ids)
        model = WordClasses(model.words, exchange(pairs, sides, model.classes, counts, order // CLASSES % 2 == sweep % 2))
    pairs = _sum_pairs(ids, model)
    discard(ids)
    table, total = pairs.astype(np.float64), pairs.sum(0).astype(np.float64)
    words = materialize(open_words(train, model, _settle(table, total)), "open")
    for sweep in range(OPEN_SWEEPS):
        table, total = _with_open(pairs, words)
        last = sweep == OPEN_SWEEPS - 1
        moved = materialize(words.mapInArrow(_settle(table, total, sweep, last), OPEN_WORDS[: OPEN_WORDS.index(", cells")] if last else OPEN_WORDS), "open")
        discard(words)
        words = moved
    spark = train.sparkSession
    fixed = pa.table({"h": np.append(model.words, END).view(np.int64), "class": np.append(model.classes, END_CLASS).astype(np.int32)})
    known = vocabulary.join(F.broadcast(spark.createDataFrame(fixed)), "h").select("h", "class", "n")  # at most ANCHORS + 1 rows
    classes = materialize(known.unionByName(words.select("h", "class", "n")).withColumn("band", band), "classes")
    discard(words)
    discard(vocabulary)
    return classes


class Emissions:
    """log10 of a word's probability in its class and in the unigram base, from sums over all training words."""

    def __init__(self, classes: DataFrame):
        sums = classes.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row a class
        self.mass, types = np.zeros(ALL), np.zeros(ALL)
        for r in sums:
            self.mass[r["class"]], types[r["class"]] = r["n"], r["v"]
        self.tokens, self.types = int(self.mass.sum()), int(types.sum())
        self.once = classes.filter("n = 1").count()
        self.scale = self.mass + WORD_ADD * types
        self.floor = self.tokens + WORD_ADD * (self.types + 1)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + WORD_ADD) / self.floor)

    def word(self, n: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Of known words; an unknown one is all there is of its class."""
        return np.where(n > 0, np.log10((n + WORD_ADD) / np.maximum(self.scale[classes], WORD_ADD)), 0.0)

    def transitions(self, pairs: np.ndarray) -> np.ndarray:
        """log10 of the class after each class; rows sum to 1. Unknown words take the share of words seen once."""
        closed = np.arange(ALL) != OPEN
        unknown = min(max((self.once + WORD_ADD) / (self.tokens + 1), 1e-9), 0.5)
        pairs = np.where(closed[None, :], pairs, 0).astype(np.float64)
        share = np.where(closed, pairs.sum(0) + CLASS_ADD, 0)
        share /= share.sum()
        out = (pairs + PRIOR * share[None, :]) / (pairs.sum(1, keepdims=True) + PRIOR) * (1 - unknown)
        out[:, OPEN] = unknown
        return np.log10(out)


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def _resolved(docs: DataFrame, classes: DataFrame, emissions: Emissions) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emission and the class of each token (a byte each) of every row of ``docs``.

    Words of the head are found in each task. The others of a text are joined with their rows of
    ``classes``, a row for each distinct one, and come back to their text.
    """
    least, size = None, 0
    for r in _bands(classes):
        if (size := size + r["v"]) > HEAD:
            break
        least = r["band"]
    in_head = F.col("h") == F.lit(int(END.view(np.int64)))  # every text has an END: it is never joined
    if least is not None:
        in_head |= F.col("band") >= least
    head = classes.filter(in_head).select("h", "class", "n").toArrow()
    order = np.argsort(head.column("h").to_numpy().view(np.uint64))
    words, own, counts = (head.column(k).to_numpy()[order] for k in ("h", "class", "n"))
    words = words.view(np.uint64)
    base_log, word_log = emissions.base(counts), emissions.word(counts, own)

    def begin(batches):
        places_of = Places(words).of
        for batch in batches:
            for row, end, hashes, where in _tokens(batch.column(2)):
                n = end - row
                at = places_of(hashes)
                known = at >= 0
                cls = np.where(known, own[at] if len(words) else OPEN, OPEN).astype(np.uint8)
                begins = np.searchsorted(where, np.arange(n + 1))
                rest = np.flatnonzero(~known)
                rest = rest[np.lexsort((hashes[rest], where[rest]))]  # by text, then word, then place
                new = np.ones(len(rest), bool)
                new[1:] = (hashes[rest[1:]] != hashes[rest[:-1]]) | (where[rest[1:]] != where[rest[:-1]])
                first = np.flatnonzero(new)
                places = _lists((rest - begins[where[rest]]).astype(np.int32), np.append(first, len(rest)))
                cut = np.searchsorted(where[rest[first]], np.arange(n + 1))
                lists = [_lists(hashes[rest[first]].view(np.int64), cut), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), places)]
                sums = [np.bincount(where, minlength=n), np.bincount(where[known], minlength=n), np.bincount(where[known], base_log[at[known]] if len(words) else None, n).astype(np.float64), np.bincount(where[known], word_log[at[known]] if len(words) else None, n).astype(np.float64)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), batch.column(1).slice(row, n), *map(pa.array, sums), _binaries(cls, begins), *lists],
                    ["row", "doc_id", "n_tokens", "n_known", "base_score", "emission", "classes", "words", "places"],
                )

    fields = "row long, doc_id long, n_tokens long, n_known long, base_score double, emission double, classes binary"
    marked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    begun = materialize(marked.mapInArrow(begin, fields + ", words array<long>, places array<array<int>>"), "begun")
    rest = begun.select("row", F.explode(F.arrays_zip("words", "places")).alias("w")).select("row", F.col("w.words").alias("h"), F.col("w.places").alias("at"))
    found = rest.join(classes.filter(~in_head).select("h", "class", "n"), "h").groupBy("row").agg(F.collect_list(F.struct("class", "n", "at")).alias("found"))

    def finish(batches):
        for batch in batches:
            known, base, word = (batch.column(k).to_numpy().copy() for k in ("n_known", "base_score", "emission"))
            tokens, (cls, cut) = batch.column("n_tokens").to_numpy(), _joined(batch.column("classes"), np.uint8)
            of, n, at = pc.list_flatten(batch.column("found")).flatten()
            of, n, k, at = of.to_numpy(), n.to_numpy(), pc.list_value_length(at).to_numpy(), pc.list_flatten(at).to_numpy()
            text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("found")).fill_null(0).to_numpy())
            cls = cls.copy()
            cls[np.repeat(cut[text], k) + at] = np.repeat(of, k)
            known += np.bincount(text, k, batch.num_rows).astype(np.int64)
            base += np.bincount(text, k * emissions.base(n), batch.num_rows)
            word += np.bincount(text, k * emissions.word(n, of), batch.num_rows)
            base += (tokens - known) * emissions.base(np.zeros(1))[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(known), pa.array(base), pa.array(word), _binaries(cls, cut)], ["doc_id", "n_tokens", "n_known", "base_score", "emission", "classes"])

    both = begun.drop("words", "places").join(found, "row", "left")
    done = materialize(both.mapInArrow(finish, fields.removeprefix("row long, ")), "resolved")
    discard(begun)
    return done.withColumn("held_out", _held_out())


def _count_pairs(done: DataFrame) -> np.ndarray:
    """Class pairs of all training texts, every word in its own class."""
    return _sum_pairs(done.filter(~F.col("held_out")).select("classes"))


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Training texts are those whose crc32(doc_id as text) mod 5 is not 1; a null doc_id counts as
    training. Null texts are empty: one token, the end. Repeated rows are rows of their own; other
    columns are ignored; without training texts every count is 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classes = cluster(docs.filter(~_held_out()))
    emissions = Emissions(classes)
    done = _resolved(docs, classes, emissions)
    transition = emissions.transitions(_count_pairs(done))

    def score(batches):
        for batch in batches:
            total, (cls, cut) = batch.column("emission").to_numpy().copy(), _joined(batch.column("classes"), np.uint8)
            if len(total):  # a text has its END at least
                total += np.add.reduceat(transition[np.append(END_CLASS, cls[:-1]), cls], cut[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(total)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = done.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(emissions.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
