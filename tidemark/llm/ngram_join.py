"""N-gram Jaccard self-join: near-duplicate classes of whole texts, exactly.

Texts become sets of 64-bit shingle hashes. Equal sets collapse to one node. A node's first shingles,
in an order that puts common ones last, are its tile keys: ``n // 5`` and, for the number of shared
keys that a link must show (``_shared``, 1 to 4 by size), as many more; large sets take more keys and
then let the most common ones go, by exact count. Tiles are split by size bands, since sizes of linked sets differ by a quarter at most. Each node has a hashed bitmap in which
every shingle flips one bit, as wide as its size band asks for: the bits in which two bitmaps differ
bound the sets' difference from below, and so their overlap from above. Pairs that survive are
decided by exact intersection of sorted arrays.

Groups of copies: each node first meets only the leader of its tile and band (links in proportion to
the rows). Nodes so joined form components, and afterwards only pairs of different components are
looked at, so a group of any size never lists its pairs. A tile walks each node's larger partners up
to the size bound and checks the pair's bitmaps, folded to 512 bits, before it says the pair; pairs
that share enough tiles go on. Tiles of more than ``LIGHT_ROWS`` rows are taken by bands and, beyond
``TILE_ROWS`` rows, by cells: one for each pair of the unit's blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.scratch import BROADCAST_ROWS, bounded_broadcast, discard, materialize
from tidemark.llm.textkit import mix, shingle_hashes, string_slices, word_hashes, word_spans

SHINGLE_WORDS = 5
BUCKETS = 1 << 16
MINI_WORDS = 8
WIDEST_BITS = 1 << 14
BAND_RATIO = 1.25
LIGHT_ROWS = 32
TILE_ROWS = 2048
HOT_TIMES = 16
SEEN_PAIRS = 250_000
LARGE = 512


def _shingles(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for row, end, data, offsets in string_slices(batch.column(column)):
        starts, ends, first = word_spans(data, offsets)
        hashes, begin = shingle_hashes(word_hashes(data, starts, ends), first, size)
        yield row, end, hashes, begin


def bucket_counts(docs: DataFrame, size: int = SHINGLE_WORDS) -> np.ndarray:
    """How many shingles of all texts fall in each of 65,536 hash buckets (a table of fixed size)."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, hashes, _ in _shingles(batch, 0, size):
                total += np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def _ordered_set(hashes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The distinct shingles as 63-bit ids whose order puts those of common buckets last."""
    ids = (rank[(hashes >> np.uint64(48)).astype(np.int64)] << np.uint64(47)) | (hashes & np.uint64((1 << 47) - 1))
    ids.sort()
    return ids[np.concatenate(([True], ids[1:] != ids[:-1]))] if len(ids) else ids


def _shared(n: np.ndarray | int):
    """How many tile keys a set of ``n`` shingles and a linked set of no fewer must share."""
    return 1 + np.minimum(3, n // 24)


def _first_keys(n: int) -> int:
    """First shingles that are keys: at most n // 5 find no partner in a linked set; large sets have a tenth of n more to choose from."""
    return n // 5 + int(_shared(n)) + (n // 10 if n >= LARGE else 0)


def _spare_keys(n: Column) -> Column:
    """Keys that a large set may let go: a tenth of the smallest set linked with it, which is large enough to have them too."""
    least = n - F.floor(n / 5)
    return F.when(least >= LARGE, F.floor(least / 10)).otherwise(0)


def _bitmap(mixed: np.ndarray) -> np.ndarray:
    """Bit k is the parity of the shingles that hash to k: at least 512 bits, else about one a shingle."""
    width = min(max(64 * MINI_WORDS, 1 << max(len(mixed) - 1, 0).bit_length()), WIDEST_BITS)
    flags = np.bincount((mixed & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, rank: np.ndarray, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, set size, set digest, bitmap and tile keys of every text."""

    def sign(batches):
        for batch in batches:
            for row, end, hashes, begin in _shingles(batch, 1, size):
                n, one, two = (np.zeros(end - row, np.int64) for _ in range(3))
                bits: list[np.ndarray] = []
                keys: list[np.ndarray] = []
                for i in range(end - row):
                    ids = _ordered_set(hashes[begin[i] : begin[i + 1]], rank)
                    n[i] = len(ids)
                    mixed = mix(ids)
                    one[i] = mixed.sum(dtype=np.uint64).astype(np.int64)
                    two[i] = mix(mixed ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)
                    bits.append(_bitmap(mixed))
                    keys.append(ids[: _first_keys(len(ids))].view(np.int64))
                lists = []
                for parts in (bits, keys):
                    ends = np.concatenate(([0], np.cumsum([len(k) for k in parts])))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(parts))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(n), pa.array(one), pa.array(two), *lists], ["doc_id", "n", "h1", "h2", "bits", "keys"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, bits array<long>, keys array<long>")


def _linkable(n1, n2, most):
    """Jaccard >= 0.8 as integers: 9 * overlap >= 4 * (n1 + n2)."""
    return 9 * most >= 4 * (n1 + n2)


def _may_link(n1: int, n2: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the bitmaps, the wider one folded to the other's width, allow a link."""
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return _linkable(n1, n2, (n1 + n2 - int(np.bitwise_count(x ^ y).sum())) // 2)


def _bounded(batches) -> Iterator[pa.RecordBatch]:
    """Of (a, b, na, nb, xa, xb) the pairs (a, b) whose bitmaps allow a link."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        (at_a, bits_a), (at_b, bits_b) = ((c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(4), batch.column(5)))
        keep = [_may_link(int(na[i]), int(nb[i]), bits_a[at_a[i] : at_a[i + 1]], bits_b[at_b[i] : at_b[i + 1]]) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, rank: np.ndarray, size: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs (a, b) of nodes that link: bitmap bound first, then exact sorted intersection."""
    pairs = materialize(pairs, "pairs")
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    near = one.join(bounded_broadcast(pairs), "a").join(two, "b").select("a", "b", "na", "nb", "xa", "xb")
    open_pairs = materialize(near.mapInArrow(_bounded, "a long, b long"), "open-pairs")
    hint = F.broadcast if open_pairs.count() <= BROADCAST_ROWS else (lambda x: x)

    def sets(batches):
        for batch in batches:
            for row, end, hashes, begin in _shingles(batch, 2, size):
                ids = [_ordered_set(hashes[begin[i] : begin[i + 1]], rank) for i in range(end - row)]
                ends = np.concatenate(([0], np.cumsum([len(k) for k in ids])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids).view(np.int64)))],
                    ["a", "b", "ids"],
                )

    def meet(batches):
        for batch in batches:
            flat, at = [], []
            for k in (2, 3):
                column = batch.column(k)
                at.append(column.offsets.to_numpy())
                flat.append(column.values.to_numpy().view(np.uint64))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (flat[k][at[k][i] : at[k][i + 1]] for k in (0, 1))
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    found = np.searchsorted(y, x)
                    found[found == len(y)] = 0
                    keep[i] = _linkable(len(x), len(y), int((y[found] == x).sum()))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    text = docs.select(F.col("doc_id").alias("b"), "text")
    right = text.join(hint(open_pairs), "b").select("a", "b", "text").mapInArrow(sets, "a long, b long, ids array<long>")
    heads = materialize(open_pairs.select("a").distinct(), "heads")
    left = text.withColumnRenamed("b", "a").join(hint(heads), "a").select("a", F.col("a").alias("b"), "text")
    left = left.mapInArrow(sets, "a long, b long, ids array<long>").select("a", F.col("ids").alias("ids_a"))
    met = right.join(left, "a").select("a", "b", "ids", "ids_a")
    links = materialize(met.mapInArrow(meet, "a long, b long").distinct(), "links")
    discard(pairs, open_pairs, heads)
    return links


def _carried(batches, *keys: str) -> Iterator[pa.Table]:
    """Tables that end where a group of ``keys`` does: rows come sorted by them, a group that goes over a batch's end is carried on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        other = np.zeros(batch.num_rows, bool)
        for c in cols:
            other |= c != c[-1]
        last = int(np.flatnonzero(other).max(initial=-1)) + 1
        if last or (held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True))):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _walk(tile: np.ndarray, n: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y), x before y, of one tile with n[y] <= 1.25 n[x] and ``allowed(x, y)``; rows come sorted by tile, then n."""
    at, d, xs, ys = np.arange(len(n)), 0, [], []
    while len(at):
        d += 1
        at = at[at + d < len(n)]
        at = at[(tile[at] == tile[at + d]) & (4 * n[at + d] <= 5 * n[at])]  # beyond the size bound all later ones are
        ok = allowed(at, at + d)
        xs.append(at[ok])
        ys.append(at[ok] + d)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (at, at)


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """The running number of each run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _pair_batch(node: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (smaller id first), how often each occurs and how many shared tiles it needs."""
    pairs = np.stack((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), _shared(n[x])), 1)
    got, times = np.unique(pairs, axis=0, return_counts=True)
    return got[:, :2], times, got[:, 2]


def _apart(t: pa.Table):
    """Node, size and the test of a pair: different components and bitmaps that allow a link."""
    node, n, comp = (t.column(k).to_numpy() for k in ("node", "n", "comp"))
    bits = t.column("mini").combine_chunks().flatten().to_numpy().reshape(-1, MINI_WORDS).view(np.uint64)

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = comp[i] != comp[j]
        at = np.flatnonzero(ok)
        i, j = i[at], j[at]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
        ok[at] = _linkable(n[i], n[j], (n[i] + n[j] - differ) // 2)
        return ok

    return node, n, allowed


class _Said:
    """What a task has said of each pair, with a bounded memory: once it said as many tiles as a link needs, more change nothing."""

    def __init__(self):
        self.times: dict[tuple[int, int], int] = {}

    def rows(self, pairs: np.ndarray, times: np.ndarray, need: np.ndarray) -> pa.RecordBatch:
        known = np.array([self.times.get(p, 0) for p in map(tuple, pairs.tolist())], np.int64)
        new = known < need
        pairs, times, need, known = pairs[new], times[new], need[new], known[new]
        if len(self.times) > SEEN_PAIRS:
            self.times.clear()
        self.times.update(zip(map(tuple, pairs.tolist()), (known + times).tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(times), pa.array(need)], ["a", "b", "times", "need"])


def _light_pairs(batches) -> Iterator[pa.RecordBatch]:
    """(a, b, times, need) of pairs of different components in small tiles."""
    said = _Said()
    for t in _carried(batches, "s"):
        node, n, allowed = _apart(t)
        x, y = _walk(_numbered(t.column("s").to_numpy()), n, allowed)
        yield said.rows(*_pair_batch(node, n, x, y))


def _cell_pairs(batches) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each cell of a large tile. ``times`` says all that is needed: such a pair goes on by itself."""
    said = _Said()
    for t in _carried(batches, "s", "unit", "cell"):
        node, n, allowed = _apart(t)
        s, unit, cell, split, band, block = (t.column(k).to_numpy() for k in ("s", "unit", "cell", "split", "band", "block"))
        alone = cell // split == cell % split

        def own(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = ((band[i] == unit[i]) | (band[j] == unit[j])) & (alone[i] | (block[i] != block[j]))
            at = np.flatnonzero(ok)
            ok[at] = allowed(i[at], j[at])
            return ok

        x, y = _walk(_numbered(s, unit, cell), n, own)
        got, _, need = _pair_batch(node, n, x, y)
        yield said.rows(got, need, need)


def _band(n: str) -> Column:
    return F.floor(F.log(F.col(n)) / F.log(F.lit(BAND_RATIO))).cast("int")


def _tiles(nodes: DataFrame, hot_from: int) -> DataFrame:
    """(s, node, n, band) of every key that two nodes have.

    Keys are counted over all nodes, and a large node lets its most common ones go (``_spare_keys``):
    long texts share common phrases with all others. Keys of hot buckets, those from ``hot_from`` on, are
    summed up before they move; all others are sent to the task of their key at once.
    """
    rows = nodes.select("node", F.col("n").cast("int").alias("n"), F.size("keys").alias("all"), F.explode("keys").alias("s"))
    hot = F.shiftright("s", 47) >= hot_from
    cold = rows.filter(~hot).withColumn("tile", F.count("*").over(Window.partitionBy("s"))).filter("tile > 1")
    warm = rows.filter(hot)
    both = cold.unionByName(warm.join(warm.groupBy("s").agg(F.count("*").alias("tile")).filter("tile > 1"), "s"))
    kept, large = ("s", "node", "n"), _spare_keys(F.col("n")) > 0
    own = Window.partitionBy("node")
    ranked = both.filter(large).withColumn("place", F.row_number().over(own.orderBy("tile", "s"))).withColumn("others", F.count("*").over(own))
    rare = ranked.filter(F.col("place") - F.col("others") <= -_spare_keys(F.col("n"))).select(*kept)
    return both.filter(~large).select(*kept).unionByName(rare).withColumn("band", _band("n"))


def _headed(tiles: DataFrame) -> DataFrame:
    """``tiles`` of two rows or more with tile (rows) and head, head_n: the smallest node of the row's tile and band."""
    by_band = tiles.groupBy("s", "band").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("head"))
    sums = by_band.groupBy("s").agg(F.sum("c").alias("tile"), F.collect_list(F.struct("band", "head")).alias("heads")).filter("tile > 1")
    sums = sums.select("s", "tile", F.explode("heads").alias("h")).select("s", "tile", "h.band", F.col("h.head.node").alias("head"), F.col("h.head.n").alias("head_n"))
    return tiles.join(sums, ["s", "band"])


def _candidates(tiles: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share as many tiles as a link asks for."""
    rows = tiles.select("s", "node", "n", "band", "tile").join(bounded_broadcast(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    minis = nodes.select("node", "mini")
    light = rows.filter(F.col("tile") <= LIGHT_ROWS).join(minis, "node").select("s", "node", "n", "comp", "mini")
    light = light.repartition("s").sortWithinPartitions("s", "n", "node").mapInArrow(_light_pairs, "a long, b long, times long, need long")

    units = rows.filter(F.col("tile") > LIGHT_ROWS).withColumn("unit", F.explode(F.array("band", F.col("band") - 1)))
    sums = units.groupBy("s", "unit").agg(F.count("*").alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("band").alias("least"))
    sums = materialize(sums.filter("lo <> hi and least = unit").select("s", "unit", F.ceil(F.col("rows") / TILE_ROWS).alias("split")), "units")
    cells = units.join(bounded_broadcast(sums), ["s", "unit"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("split")))
    dealt = F.transform(F.sequence(F.lit(0).cast("long"), F.col("split") - 1), lambda j: F.least(j, F.col("block")) * F.col("split") + F.greatest(j, F.col("block")))
    cells = cells.withColumn("cell", F.explode(dealt)).join(minis, "node")
    cells = cells.select("s", "unit", "cell", "split", "node", "n", "comp", "band", "block", "mini")
    heavy = cells.repartition("s", "unit", "cell").sortWithinPartitions("s", "unit", "cell", "n", "node").mapInArrow(_cell_pairs, "a long, b long, times long, need long")
    return light.unionByName(heavy).groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need")).filter("times >= need").select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; more columns are ignored).

    component_id is the smallest doc_id reachable by links (Jaccard of shingle sets >= 0.8),
    the row's own included. Null, empty or blank text: 0 shingles, linked with nothing. Rows that
    repeat are all returned. doc_id identifies a text; a null doc_id takes no part in links and has
    a null component. No rows: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = bucket_counts(docs, size)
    rank = np.empty(BUCKETS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    hot = int((counts > max(HOT_TIMES * counts.mean(), TILE_ROWS)).sum())
    sig = materialize(signatures(docs, rank, size), "signatures")
    ids = materialize(sig.select("doc_id", "n", "h1", "h2"), "ids")

    some = ids.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = materialize(some.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node")), "nodes")
    own = sig.join(bounded_broadcast(reps.select(F.col("node").alias("doc_id"), "n", "h1", "h2")), ["doc_id", "n", "h1", "h2"]).withColumnRenamed("doc_id", "node")
    fold = F.array(*[F.aggregate(F.sequence(F.lit(k), F.size("bits") - 1, F.lit(MINI_WORDS)), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(F.get("bits", i))) for k in range(MINI_WORDS)])
    nodes = materialize(own.select("node", "n", "bits", fold.alias("mini")).dropDuplicates(["node"]), "bitmaps")
    rare = materialize(_tiles(own.select("node", "n", "keys"), BUCKETS - hot), "keys")
    tiles = materialize(_headed(rare), "tiles")
    discard(sig, rare)

    enough = 1 + F.least(F.lit(3), F.floor(F.least("n", "head_n") / 24))
    star = tiles.filter(F.col("node") != F.col("head")).groupBy(F.col("head").alias("a"), F.col("node").alias("b"), enough.alias("need")).agg(F.count("*").alias("times"))
    links = verify(star.filter("times >= need").select("a", "b"), docs, nodes, rank, size)
    comps = connected_components(links)
    more = verify(_candidates(tiles, comps, nodes), docs, nodes, rank, size)
    discard(tiles, nodes)

    comps = connected_components(links.unionByName(more))
    marked = reps.join(comps, "node", "left").select("n", "h1", "h2", F.coalesce("comp", "node").alias("component_id"))
    out = ids.join(marked, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
