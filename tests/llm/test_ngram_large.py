"""The n-gram join on large sets, which let common keys go, against brute force over all pairs."""

import random

from tidemark.llm import ngram_join


def edited(rng, words, share):
    """``words`` with a stretch of a share replaced: no shingle of it stays."""
    n, out = round(len(words) * share), list(words)
    at = rng.randrange(len(words) - n + 1)
    out[at : at + n] = [f"e{rng.random()}" for _ in range(n)]
    return out


def test_large_sets_by_brute_force(spark):
    rng = random.Random(11)
    common = [f"c{k}" for k in range(120)]  # a passage that all texts share
    texts = []
    for family in range(6):
        base = [f"f{family}x{rng.randrange(400)}" for _ in range(rng.randint(640, 820))]
        base[200:320] = common
        texts += [" ".join(edited(rng, base, share)) for share in (0, 0, 0.05, 0.09, 0.1, 0.105, 0.11, 0.12, 0.2, 0.3)]
        texts.append(" ".join(base[: len(base) * 81 // 100]))  # near the size bound
    texts += [" ".join(common), " ".join(rng.sample(common, 100))]
    sets = []
    for text in texts:
        w = text.split(" ")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    comp, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links += 1
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert links > 60 and sum(len(s) >= ngram_join.LARGE * 5 // 4 for s in sets) > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (len(s), comp[i]) for i, s in enumerate(sets)}
