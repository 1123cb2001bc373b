import collections
import math
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import class_lm
from tidemark.llm.textkit import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def hashed(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])


def tokens(text):
    return [*map(hashed, WORD.findall((text or "").translate(LOWER))), int(class_lm.END.view(np.int64))]


def brute(docs, classes, held):
    """log10 of each text's probability from the classes of the words, pair by pair."""
    of, n = {r.h: r["class"] for r in classes}, {r.h: r.n for r in classes}
    mass, types, pairs = collections.Counter(), collections.Counter(), collections.Counter()
    for h, c in of.items():
        mass[c] += n[h]
        types[c] += 1
    total = sum(mass.values())
    known = lambda t: [of.get(h, class_lm.OPEN) for h in t]
    for i, text in docs.items():
        if not held[i]:
            cls = [class_lm.END_CLASS, *known(tokens(text))]
            pairs.update(zip(cls, cls[1:]))
    closed = [c for c in range(class_lm.ALL) if c != class_lm.OPEN]
    column = {c: 0.1 + sum(pairs[a, c] for a in range(class_lm.ALL)) for c in closed}
    row = {a: sum(pairs[a, c] for c in closed) for a in range(class_lm.ALL)}
    unknown = min(max((sum(k == 1 for k in n.values()) + 0.5) / (total + 1), 1e-9), 0.5)

    def step(a, c):
        if c == class_lm.OPEN:
            return unknown
        return (1 - unknown) * (pairs[a, c] + 10 * column[c] / sum(column.values())) / (row[a] + 10)

    for a in range(class_lm.ALL):
        assert sum(step(a, c) for c in range(class_lm.ALL)) == pytest.approx(1)
    for c in types:
        assert sum((n[h] + 0.5) / (mass[c] + 0.5 * types[c]) for h in of if of[h] == c) == pytest.approx(1)
    out = {}
    for i, text in docs.items():
        t = tokens(text)
        cls = [class_lm.END_CLASS, *known(t)]
        out[i] = sum(math.log10(step(a, c)) for a, c in zip(cls, cls[1:])) + sum(math.log10((n[h] + 0.5) / (mass[of[h]] + 0.5 * types[of[h]])) for h in t if h in of)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return spark.createDataFrame([*((r.doc_id, r.text) for r in rows), (-1, None), (-2, ""), (None, "no id")], "doc_id long, text string")


@pytest.mark.parametrize("head, anchors", [(1 << 17, 1 << 13), (40, 300), (0, 0)])
def test_scores_by_brute_force(spark, docs, monkeypatch, head, anchors):
    monkeypatch.setattr(class_lm, "HEAD", head)
    monkeypatch.setattr(class_lm, "ANCHORS", anchors)
    train = docs.filter(~class_lm._held_out())
    classes = class_lm.cluster(train).collect()
    words = {h for r in train.collect() for h in tokens(r.text)}
    assert {r.h for r in classes} == words and len(classes) == len(words)  # each word, however rare
    assert all(r["class"] < class_lm.CLASSES or r.h == int(class_lm.END.view(np.int64)) for r in classes)
    got = {r.doc_id: r for r in class_lm.score_texts(docs).collect()}
    want = brute({r.doc_id: r.text for r in docs.collect()}, classes, {k: r.held_out for k, r in got.items()})
    for k, r in got.items():
        assert r.score == pytest.approx(want[k], rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = class_lm.score_texts(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_words_of_one_kind_share_a_class(spark):
    rng = np.random.default_rng(1)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abc"]
    rows = [(i, " ".join(kinds[j % 3][rng.integers(12)] for j in range(60))) for i in range(80)]
    got = class_lm.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {r.h: r["class"] for r in got}
    sets = [{of[hashed(w)] for w in kind} for kind in kinds]
    assert all(not sets[i] & sets[j] for i in range(3) for j in range(i))


def test_exchange_takes_a_word_out_of_its_class_first():
    pairs = np.zeros((class_lm.ALL, class_lm.ALL), np.int64)
    sides = np.zeros((2, 1, class_lm.ALL), np.int64)
    pairs[class_lm.END_CLASS, 0], pairs[0, class_lm.END_CLASS] = 4, 4
    pairs[class_lm.END_CLASS, 1], pairs[1, class_lm.END_CLASS] = 1, 1
    sides[:, 0, class_lm.END_CLASS] = 1
    moved = class_lm.exchange(pairs, sides, np.array([1]), np.array([1]), np.array([True]))
    kept = class_lm.exchange(pairs, sides, np.array([1]), np.array([1]), np.array([False]))
    assert kept.tolist() == [1] and moved[0] in (0, 1, 2) and (pairs >= 0).all()


def test_many_words_at_once_go_where_exchange_puts_each():
    rng = np.random.default_rng(5)
    words, size = 40, class_lm.ALL
    n = [rng.integers(1, 9, rng.integers(1, 30)) for _ in range(words)]
    left, right = ([rng.integers(0, size, len(k)) for k in n] for _ in range(2))
    own = rng.integers(0, class_lm.CLASSES, words)
    table = rng.integers(0, 50, (size, size)).astype(np.float64)
    sides = np.zeros((2, words, size), np.int64)
    for w in range(words):
        np.add.at(sides[0, w], left[w], n[w])
        np.add.at(sides[1, w], right[w], n[w])
    counts = np.array([k.sum() for k in n])
    want = class_lm.exchange(table, sides, own, counts, np.ones(words, bool))
    cut = np.cumsum([0, *map(len, n)])
    got, times = class_lm._best_classes(cut, *map(np.concatenate, (left, right, n)), table, table.sum(0), own)
    assert got.tolist() == want.tolist() and times.tolist() == counts.tolist()


def test_every_other_word_is_summed_once_and_counted_in_its_class(spark, docs, monkeypatch):
    monkeypatch.setattr(class_lm, "SLICE", 50)
    train = docs.filter(~class_lm._held_out())
    texts = [tokens(r.text) for r in train.collect()]
    counts = collections.Counter(h for t in texts for h in t)
    end = int(class_lm.END.view(np.int64))
    top = sorted((h for h in counts if h != end), key=lambda h: -counts[h])[:100]
    words = np.sort(np.array(top, np.int64).view(np.uint64))
    model = class_lm.WordClasses(words, np.arange(100) % class_lm.CLASSES)
    pairs, _ = class_lm.neighbour_counts(train, model)
    raw = class_lm.open_words(train, model)
    rows = raw.mapInArrow(class_lm._settle(pairs.astype(float), pairs.sum(0).astype(float)), class_lm.OPEN_WORDS).collect()
    assert {r.h: r.n for r in rows} == {h: n for h, n in counts.items() if h != end and h not in set(top)}
    assert all(0 <= r["class"] < class_lm.CLASSES and len({c.sides for c in r.cells}) == len(r.cells) and sum(c.n for c in r.cells) == r.n for r in rows)
    table, total = class_lm._with_open(pairs, spark.createDataFrame(rows, class_lm.OPEN_WORDS))
    want, sizes = pairs.astype(float), pairs.sum(0).astype(float)
    of = {r.h: r["class"] for r in rows}
    fixed = {h: class_lm.END_CLASS if h == end else int(model.of(np.array([h], np.int64).view(np.uint64))[0][0]) for h in counts}
    for t in texts:
        cls = [class_lm.END_CLASS, *(fixed[h] for h in t)]
        for i, h in enumerate(t):
            if h in of:
                want[cls[i], of[h]] += 1
                want[of[h], cls[i + 2]] += 1
                sizes[of[h]] += 1
    assert (table == want).all() and (total == sizes).all()
    for sweep in range(2):  # two sweeps move every word once
        moved = {r.h: r["class"] for r in spark.createDataFrame(rows, class_lm.OPEN_WORDS).mapInArrow(class_lm._settle(table, total, sweep), class_lm.OPEN_WORDS).collect()}
        assert all(moved[r.h] == r["class"] for r in rows if (r.h & 1) != sweep)
        for r in [r for r in rows if (r.h & 1) == sweep][:50]:
            sides = np.zeros((2, 1, class_lm.ALL), np.int64)
            for c in r.cells:
                sides[0, 0, c.sides // class_lm.ALL] += c.n
                sides[1, 0, c.sides % class_lm.ALL] += c.n
            best = class_lm.exchange(table, sides, np.array([r["class"]]), np.array([r.n]), np.ones(1, bool), total)
            assert moved[r.h] == best[0]


def test_sweeps_do_not_read_the_texts_again(docs):
    train, reads = docs.filter(~class_lm._held_out()), []

    class Train:
        sparkSession = train.sparkSession

        def select(self, *columns):
            reads.append(columns)
            return train.select(*columns)

    assert class_lm.cluster(Train()).count() > 0
    assert len(reads) == 3  # the counts of words, the numbers of anchors, the other words


@pytest.mark.parametrize("anchors", [0, 100, 300])
def test_written_numbers_give_the_neighbours_of_the_texts(docs, monkeypatch, anchors):
    monkeypatch.setattr(class_lm, "RUN", 37)
    train = docs.filter(~class_lm._held_out())
    texts = [tokens(r.text) for r in train.collect()]
    counts = collections.Counter(h for t in texts for h in t)
    end = int(class_lm.END.view(np.int64))
    words = np.sort(np.array(sorted(set(counts) - {end}, key=lambda h: -counts[h])[:anchors], np.int64).view(np.uint64))
    model = class_lm.WordClasses(words, np.arange(anchors) % class_lm.CLASSES)
    place = {int(h): k for k, h in enumerate(words.view(np.int64))}
    want_pairs, want = np.zeros((class_lm.ALL, class_lm.ALL), int), np.zeros((2, anchors, class_lm.ALL), int)
    for t in texts:
        cls = [class_lm.END_CLASS, *(class_lm.END_CLASS if h == end else place[h] % class_lm.CLASSES if h in place else class_lm.OPEN for h in t)]
        for i, h in enumerate(t):
            want_pairs[cls[i], cls[i + 1]] += 1
            if h in place:
                want[0, place[h], cls[i]] += 1
                want[1, place[h], cls[i + 2]] += 1
    ids = class_lm.anchor_ids(train, model)
    assert ids.count() == len(texts)
    pairs, sides = class_lm.neighbour_counts(train, model, ids)
    assert (pairs == want_pairs).all() and (sides == want).all() and (class_lm._sum_pairs(ids, model) == want_pairs).all()


def test_places_of_words_with_the_same_leading_bits():
    rng = np.random.default_rng(3)
    low, top = np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1)
    for words in (low[:0], low[:1], np.concatenate((low[::2], np.sort(rng.integers(2**40, 2**63, 500, dtype=np.uint64)), top - low[::-2]))):
        asked = np.concatenate((words, low, top - low, rng.integers(0, 2**63, 100, dtype=np.uint64)))
        of = {w: k for k, w in enumerate(words.tolist())}
        assert class_lm.Places(words).of(asked).tolist() == [of.get(h, -1) for h in asked.tolist()]


def test_a_word_over_several_batches_is_one_row():
    h, sides = np.repeat([-5, 2, 9], [3, 40, 1]), np.arange(44, dtype=np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array(sides), pa.array(np.arange(44))], ["h", "sides", "n"])
    rows = [r for b in class_lm._gather(batch.slice(k, 7) for k in range(0, 44, 7)) for r in b.to_pylist()]
    assert [(r["h"], [c["sides"] for c in r["cells"]]) for r in rows] == [(-5, [0, 1, 2]), (2, list(range(3, 43))), (9, [43])]
