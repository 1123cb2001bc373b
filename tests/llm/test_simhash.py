"""SimHash classes against brute force: every pair of fingerprints, worked out bit by bit."""

import random
import re
import string

import numpy as np
import xxhash

from tidemark.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, fp string, n int, component_id string, variant long"


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, radius=2):
    prints = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    distinct = sorted(set(prints))
    near = {p: {q for q in distinct if (p ^ q).bit_count() <= radius} for p in distinct}
    at = {p: prints.index(p) for p in distinct}
    for i, p in enumerate(prints):
        for q in near[p]:
            comp[find(i)] = find(at[q])
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((-1 if d is None else d, f"{p:016x}", least.get(find(i)), len(near[p]) - 1) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcDé") for _ in range(rng.randint(1, 5))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [None, "", " \n", "one", "ONE", "two words", "two\twords ", "a b c", "x" * 4000, say(20_000)]
    for _ in range(3):  # groups of near copies, and chains where one word more changes a few bits
        base = say(400).split(" ")
        for k in range(40):
            near = list(base)
            for at in rng.sample(range(400), k % 4):
                near[at] = f"w{k}"
            out.append(" ".join(near))
    return out + [say(rng.randint(1, 60)) for _ in range(60)]


def test_classes_by_brute_force(spark):
    rows = [(1000 - i, t) for i, t in enumerate(texts())]
    rows += rows[3:6] + [(None, "one"), (None, "none has an id here"), (None, "none has an id here")]
    docs = spark.createDataFrame([(d, t, "x", 0, "y", 1) for d, t in rows], SCHEMA)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id, r.n_links) for r in simhash.simhash_classes(docs).collect())
    want = brute_classes(rows)
    assert got == want
    assert len({c for _, _, c, _ in want}) < len(rows) - 80  # there are classes
    assert any(n > 1 for *_, n in want)


def test_empty(spark):
    got = simhash.simhash_classes(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "fingerprint", "component_id", "n_links"] and got.collect() == []


def test_pairs_of_the_ball_are_all_pairs(spark):
    rng = random.Random(1)
    made = {0, (1 << 63), (1 << 64) - 1}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            made.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in made]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius in (0, 2, 4):
        want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        got = [tuple(r) for r in simhash.near_fingerprints(table, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_groups_over_batches(spark):
    """A group that goes over the end of an Arrow batch keeps its pairs."""
    import pyarrow as pa

    v, f = np.repeat(np.arange(5), 7), np.arange(35) % 7
    f = np.where(f == 0, 0, 1 << f)
    batches = [pa.RecordBatch.from_arrays([pa.array(v[i : i + 3]), pa.array(f[i : i + 3])], ["variant", "fp"]) for i in range(0, 35, 3)]
    got = [p for b in simhash._colliding(2)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(got) == 5 * 21


def test_fingerprint_over_blocks(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(1000))
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) & (1 << 64) - 1 == brute_fingerprint(text)
