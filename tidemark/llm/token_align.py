"""Alignment of two tokenizers' tokens of the same bytes.

Both encodings cut a text's bytes at their token ends. The union of both end arrays gives the
elementary intervals; each has one owner in either encoding (``searchsorted``) and is one overlap of
two tokens. Ends that both have close a group. Links are the pairs whose byte ranges end together
(``ends``), all overlaps (``overlaps``) or every pair of a group (``products``).

No token of either tokenizer goes over the boundary between a word and the white space after it (read
from the tokenizer files; else texts are encoded whole), so a group does not either: each distinct
piece between such boundaries is encoded and aligned once for each task and a text is the run of its
pieces. How often the corpus links two ids is counted over the rows of all texts; a text's figures
join these counts, those of the most frequent pairs by broadcast (a bounded number), all others by
shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import attach, discard, materialize
from tidemark.llm.token_resync import _RARE_SPACE, _S, _R, _cuttable

LINKS = ("ends", "overlaps", "products")
# A pair is one number; the second vocabulary has at most so many ids.
SECOND_IDS = 1 << 31
HEAVY_PAIRS = 1 << 16
# Pieces remembered by a worker before it starts anew, and their bytes.
CACHE_PIECES, CACHE_BYTES = 200_000, 1 << 25
ROWS_AT_ONCE = 256
# New pieces are joined to texts of about so many bytes, which costs less than a call for each.
RUN_BYTES = 2048
SPACE = "▁"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_products long, groups_sha256 string, pairs array<long>, times array<long>"


@cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class _ByteLevel:
    """A byte-level BPE file of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of, special = _byte_of(), {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = [special[i].encode() if i in special else bytes(byte_of[c] for c in n) if n is not None and all(c in byte_of for c in n) else (n or "").encode() for i, n in enumerate(names)]
        self.cuttable = _cuttable(path)
        self.glue: set[str] = set()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class _Pieces:
    """A sentencepiece file that adds a space before a text; texts given here begin with that space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        names = [self.model.id_to_piece(i) for i in ids]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in zip(ids, names, strict=True)]
        plain = [n for i, n in zip(ids, names, strict=True) if len(n) > 1 and not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.space = self.model.piece_to_id(SPACE)
        self.glue = {c for n in plain for c in n if c in " \t\n\r\x0b\x0c"}
        # a space begins a piece or follows another one, the space itself is a piece, and spaces are not removed
        self.cuttable = not any(re.search(f"[^{SPACE}]{SPACE}", n) for n in plain) and not self.model.is_unknown(self.space) and self.model.encode("  a") != self.model.encode("a")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Without its first space where a text has one, as the model adds it again; else the added space is taken off the result."""
        found = self.model.encode([t[1:] if t.startswith(" ") else t for t in texts], num_threads=1)
        return [([self.space] if t == " " else ids) if t.startswith(" ") else ids[1:] for t, ids in zip(texts, found, strict=True)]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places start, start + 1, ... of each row, ``counts`` of them, row after row."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> dict[str, np.ndarray]:
    """Elementary intervals of two rising arrays of ends that close together.

    owner_a, owner_b: the tokens of each interval; shared: the intervals at whose end both end (a group
    each); group_a, group_b: the group of each token.
    """
    union = np.union1d(a_ends, b_ends)
    owner_a, owner_b = np.searchsorted(a_ends, union), np.searchsorted(b_ends, union)
    both = (a_ends[owner_a] == union) & (b_ends[owner_b] == union)
    closes = union[both]
    return {"owner_a": owner_a, "owner_b": owner_b, "shared": np.flatnonzero(both), "group_a": np.searchsorted(closes, a_ends), "group_b": np.searchsorted(closes, b_ends), "ends": union, "closes": closes}


def linked(got: dict[str, np.ndarray], links: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the linked tokens, group after group."""
    if links == "ends":
        return got["owner_a"][got["shared"]], got["owner_b"][got["shared"]]
    if links == "overlaps":
        return got["owner_a"], got["owner_b"]
    n = len(got["shared"])
    many_a, many_b = np.bincount(got["group_a"], minlength=n), np.bincount(got["group_b"], minlength=n)
    first_b = np.cumsum(many_b) - many_b
    a = np.repeat(np.arange(len(got["group_a"])), many_b[got["group_a"]])
    return a, _spread(first_b[got["group_a"]], many_b[got["group_a"]])


class Aligner:
    """Aligned pieces of texts, remembered up to a bound. ``a`` and ``b`` encode texts that begin with a space."""

    def __init__(self, a, b, links: str = "ends"):
        self.a, self.b, self.links = a, b, links
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (a, b))
        self.names = list(map(str, range(max(len(a.bytes), len(b.bytes)))))
        glue = "".join(sorted(a.glue | b.glue)).replace(" ", "")
        held = "".join(map(re.escape, glue))
        self.cut = a.cuttable and b.cuttable and " " not in a.glue
        self.piece = re.compile(f"[{_S}]*+(?:[^{_S}{_R}]++|[{_R}{held}][{_S}{_R}]*+)++|[{_S}]++")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.weight = 0
        self.said: list[str] = []
        self.table = np.zeros((0, 8), np.int64)  # n_a, n_b, n_groups, n_overlaps, n_products, whether its bytes differ, first link, links
        self.pairs = np.zeros(0, np.int64)

    def _one_by_one(self, new: list[str]) -> tuple[list[bool], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """good (both encodings give the piece's bytes back), and of the good ones all ids and their numbers, on both sides."""
        ids_a, ids_b = self.a.encode(new), self.b.encode(new)
        bytes_a, bytes_b = self.a.bytes, self.b.bytes
        good = [b"".join([bytes_a[i] for i in x]) == (raw := p.encode()) == b"".join([bytes_b[i] for i in y]) and bool(raw) for p, x, y in zip(new, ids_a, ids_b, strict=True)]
        out = []
        for ids in (ids_a, ids_b):
            kept = [x for x, ok in zip(ids, good, strict=True) if ok]
            out += [np.fromiter(chain.from_iterable(kept), np.int64), np.array(list(map(len, kept)), np.int64)]
        return good, *out

    def _in_runs(self, new: list[str]) -> tuple[list[bool], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for pieces that may be joined to longer texts, as no token goes over their edges; if that shows otherwise, one by one."""
        raw = [p.encode() for p in new]
        stop = np.cumsum(list(map(len, raw)))
        edges = np.searchsorted(stop, np.arange(RUN_BYTES, stop[-1] + RUN_BYTES, RUN_BYTES)) + 1
        edges = [0, *np.unique(np.minimum(edges, len(new))).tolist()]
        texts, out = ["".join(new[i:j]) for i, j in zip(edges, edges[1:])], []
        for side, size in ((self.a, self.size_a), (self.b, self.size_b)):
            ids = np.fromiter(chain.from_iterable(side.encode(texts)), np.int64)
            ends = np.cumsum(size[ids])
            last = np.searchsorted(ends, stop)
            if not len(ends) or ends[-1] != stop[-1] or (ends[last] != stop).any() or b"".join(map(side.bytes.__getitem__, ids.tolist())) != b"".join(raw):
                return self._one_by_one(new)
            out += [ids, np.diff(last, prepend=-1)]
        return [True] * len(new), *out

    def _learn(self, new: list[str]) -> None:
        joins = [p for p in new if self.cut and p[0] == " " and SPACE not in p and not p.isspace()]
        alone = [p for p in new if not (self.cut and p[0] == " " and SPACE not in p and not p.isspace())]
        for pieces, encoded in ((joins, self._in_runs), (alone, self._one_by_one)):
            if pieces:
                self._keep(pieces, *encoded(pieces))

    def _keep(self, new: list[str], good: list[bool], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        rows = np.zeros((len(new), 8), np.int64)
        rows[:, 5] = ~np.array(good)
        said = [""] * len(new)
        at = [k for k, ok in enumerate(good) if ok]
        pairs = np.zeros(0, np.int64)
        if at:
            ends_a = np.cumsum(self.size_a[a])
            got = align(ends_a, np.cumsum(self.size_b[b]))
            close = got["closes"]
            stop = ends_a[np.cumsum(n_a) - 1]  # each piece's end in bytes
            groups = np.diff(np.searchsorted(close, stop, "right"), prepend=0)
            overlaps = np.diff(np.searchsorted(got["ends"], stop, "right"), prepend=0)
            product = np.bincount(got["group_a"], minlength=len(close)) * np.bincount(got["group_b"], minlength=len(close))
            products = np.add.reduceat(product, np.cumsum(groups) - groups)
            count = {"ends": groups, "overlaps": overlaps, "products": products}[self.links]
            place_a, place_b = linked(got, self.links)
            pairs = a[place_a] * SECOND_IDS + b[place_b]
            first = len(self.pairs) + np.cumsum(count) - count
            rows[at] = np.stack((n_a, n_b, groups, overlaps, products, np.zeros_like(n_a), first, count), 1)
            said_groups, where = self._names(a, b, got["group_a"], got["group_b"], len(close)), 0
            for k, n in zip(at, groups.tolist(), strict=True):
                said[k] = said_groups[where] if n == 1 else ";".join(said_groups[where : where + n])
                where += n
        start = len(self.said)
        self.known.update(zip(new, range(start, start + len(new))))
        self.weight += sum(map(len, new))
        self.said += said
        self.table = np.concatenate((self.table, rows))
        self.pairs = np.concatenate((self.pairs, pairs))

    def _names(self, a, b, group_a, group_b, n: int) -> list[str]:
        sides = []
        for ids, group in ((a, group_a), (b, group_b)):
            names, stop = list(map(self.names.__getitem__, ids.tolist())), np.searchsorted(group, np.arange(n), "right").tolist()
            sides.append([names[i] if j - i == 1 else ",".join(names[i:j]) for i, j in zip([0, *stop], stop)])
        return [f"{x}|{y}" for x, y in zip(*sides, strict=True)]

    def _sums(self, runs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of each text, the rows of all pieces and the sums over each text."""
        lengths = np.array(list(map(len, runs)), np.int64)
        rows = self.table[np.fromiter(chain.from_iterable(runs), np.int64, int(lengths.sum()))]
        sums, some = np.zeros((len(runs), 6), np.int64), np.flatnonzero(lengths)
        if len(some):
            sums[some] = np.add.reduceat(rows[:, :6], (np.cumsum(lengths) - lengths)[some])
        return lengths, rows, sums

    def texts(self, texts: list[str | None]) -> pa.RecordBatch:
        """n_a, n_b, n_groups, n_overlaps, n_products, groups_sha256, pairs and times of each text."""
        if len(self.known) > CACHE_PIECES or self.weight > CACHE_BYTES:
            self.forget()
        runs = [self.piece.findall(" " + t) if t and self.cut else [" " + t] if t else [] for t in texts]
        if new := [p for p in dict.fromkeys(chain.from_iterable(runs)) if p not in self.known]:
            self._learn(new)
        runs = [list(map(self.known.__getitem__, r)) for r in runs]
        lengths, rows, sums = self._sums(runs)
        if differ := np.flatnonzero(sums[:, 5]).tolist():  # a piece's bytes do not come back: nor do the text's, unless whole they do
            for i in differ:
                if (whole := " " + texts[i]) not in self.known:
                    self._learn([whole])
                k = self.known[whole]
                runs[i] = [] if self.table[k, 5] else [k]
            lengths, rows, sums = self._sums(runs)
        links = self.pairs[_spread(rows[:, 6], rows[:, 7])] if len(rows) else self.pairs[:0]
        per_piece = np.concatenate(([0], np.cumsum(rows[:, 7])))
        edges = per_piece[np.concatenate(([0], np.cumsum(lengths)))]
        values, times = zip(*[np.unique(links[i:j], return_counts=True) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]) if texts else ((), ())
        offsets = pa.array(np.concatenate(([0], np.cumsum(list(map(len, values))))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (values, times)]
        sha = [hashlib.sha256(";".join([self.said[k] for k in r]).encode()).hexdigest() if r else "" for r in runs]
        return pa.RecordBatch.from_arrays([*[pa.array(sums[:, k]) for k in range(5)], pa.array(sha, pa.string()), *lists], ["n_a", "n_b", "n_groups", "n_overlaps", "n_products", "groups_sha256", "pairs", "times"])


@cache
def _aligner(a_path: str, b_path: str, links: str) -> Aligner:
    return Aligner(_ByteLevel(a_path), _Pieces(b_path), links)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, links: str = "ends") -> DataFrame:
    """Each text's own figures: token, group and overlap counts, the digest of its groups, its linked id pairs and how often it has each."""

    def run(batches):
        aligner = _aligner(a_path, b_path, links)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                got = aligner.texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *got.columns], ["doc_id", *got.schema.names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ALIGNED)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, links: str = "ends") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps, n_products of every row of ``docs`` (doc_id, text).

    ``a_path``: a byte-level BPE file of the tokenizers library, ``b_path``: a sentencepiece model that
    adds a space; all workers see both. Null and empty texts, and those whose tokens' bytes are not
    the text's with a space before it, have no tokens: zeros and an empty digest. A pair's count is how
    many links of all rows hold it; n_best counts a text's links whose count is the highest of their b
    id, ties included, count_sum adds the counts up. Null ids and rows that repeat are all returned and
    counted; other columns are ignored; no rows give no rows.
    """
    if links not in LINKS:
        raise ValueError(f"links must be one of {', '.join(LINKS)}")
    own = materialize(aligned_texts(docs, a_path, b_path, links).withColumn("row", F.monotonically_increasing_id()), "aligned", "zstd")
    each = own.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    counts = materialize(each.groupBy("pair").agg(F.count("*").alias("n"), F.sum("times").alias("count")), "pair-counts")
    second = counts.withColumn("b", F.pmod("pair", F.lit(SECOND_IDS)))
    most = second.groupBy("b").agg(F.max("count").alias("most"))  # a row an id of the vocabulary
    marks = materialize(second.join(F.broadcast(most), "b").select("pair", "n", "count", (F.col("count") == F.col("most")).alias("best")), "pair-marks")
    figures = attach(each, marks, "pair", HEAVY_PAIRS).groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    figures = materialize(figures, "pair-figures")
    discard(counts, marks)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.drop("pairs", "times").join(figures, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *map(zero, ("n_links", "n_best", "count_sum")), "groups_sha256", "n_overlaps", "n_products")
