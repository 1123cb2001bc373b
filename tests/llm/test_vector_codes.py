"""Vector codes against plain Lloyd rounds over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int, error double"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e], lab) for i, e, lab in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x, book: min(range(len(book)), key=lambda k: (dist(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(cut(v)[p], books[p]), []).append(cut(v)[p])
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else books[p][k] for k in range(len(books[p]))]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, lab in kept:
        ks = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(dist(x, books[p][k]) for p, (x, k) in enumerate(zip(cut(v), ks)))
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for k in ks), error, lab))
    return sorted((-1 if i is None else i, c, e, by_label[lab], sha) for i, c, e, lab in out)


def coded(spark, rows):
    table = spark.createDataFrame([(i, e, lab, "x", 1, 0.5) for i, e, lab in rows], SCHEMA)
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(table).collect())


@pytest.mark.parametrize("kind", ["spread", "ties"])
def test_codes_by_brute_force(spark, kind):
    rng = random.Random(kind)
    if kind == "spread":
        value = lambda: rng.gauss(0, 0.3)
    else:
        value = lambda: rng.choice([-1, 0, 1]) / 256  # noqa: E731  many equal distances and equal parts
    rows = [(1000 - i, [value() for _ in range(64)], rng.choice([1, 2, None])) for i in range(400)]
    rows += rows[:20] + [(None, rows[5][1], 2), (7000, rows[6][1], 1)]
    rows += [(1, None, 1), (2, [float("nan")] + [0.0] * 63, 1), (3, [float("-inf")] + [0.0] * 63, 1), (4, [None] + [0.0] * 63, 1), (5, [], 1)]
    assert coded(spark, rows) == brute(rows)


def test_few_none_and_odd_widths(spark):
    few = [(i, [i / 8 + d for d in range(64)], 1) for i in range(5)]
    assert coded(spark, few) == brute(few)
    assert coded(spark, [(1, None, 1)]) == [] and coded(spark, []) == []
    odd = coded(spark, [(1, [0.5] * 20, 1), (2, [0.25] * 20, 1), (3, [0.25] * 64, 1)])  # widths other than the first row's go, 20 is filled up to 32
    assert [r[0] for r in odd] == [1, 2] and all(r[2] == 0 for r in odd)
    with pytest.raises(Exception, match="too large"):
        coded(spark, [(1, [3e6] * 64, 1)])


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (3000, 4))
    x[:500] = x[500:1000]  # equal parts, so equal distances
    before = x[rng.integers(0, 3000, 64)][None]
    one = vector_codes.Books(before)
    code, upper, lower = one.first(x, 0)
    entries = np.stack([x[code == k].sum(0) // max(1, (code == k).sum()) for k in range(64)])[None]
    two = vector_codes.Books(entries, before)
    got, upper, lower, looked = two.again(x, 0, code, upper, lower)
    squares = vector_codes._squares(x, entries[0])
    assert (got == squares.argmin(1)).all() and looked < squares.size / 3
    true = np.sqrt(squares)
    assert (lower <= true).all() and (upper >= true[np.arange(3000), got]).all()
    packed, shift = vector_codes._packed(lower * 100)
    assert (packed * np.exp2(shift)[:, None] <= lower * 100).all() and (packed.max(1) >= 100).all()
