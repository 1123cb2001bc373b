"""Token alignment against a reading of the rules text by text, byte by byte."""

import collections
import hashlib
import random

import pytest

from tidemark.llm import token_align

P = pytest.importorskip("public_tokenizers")
A, B = str(P.path("byte_bpe_50k.json")), str(P.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, row long, pair long, n int, b string"


def texts():
    rng = random.Random(4)
    words = ["the", "gröber", "naïve", "x1", "don't", "日本語", "é", "🙂🙃", "ＡＢ", "<s>", "<|endoftext|>", "</s>", "<0x41>", "a\rb", ";\r\n", "}", " ", " ", "　"]
    words += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    spaces = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \r", "\r", "\x0b", "\x0c ", "   \n "]
    say = lambda n: "".join(rng.choice(words) + rng.choice(spaces) for _ in range(n))
    fixed = [None, "", " ", "  ", "\n", "a", " a", "a ", "\r", "a\r", "▁", "a▁b c", "\x00", "� x", "x" * 3000, "日" * 700]
    return fixed + [say(rng.randint(1, 50)) for _ in range(60)] + [say(700)]


def whole_tokens(text):
    """Ids and bytes of both encodings of the whole text, or none."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    a = whole_tokens.__dict__.setdefault("a", Tokenizer.from_file(A))
    b = whole_tokens.__dict__.setdefault("b", sentencepiece.SentencePieceProcessor(model_file=B))
    a.encode_special_tokens = True
    byte_of = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    byte_of |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in byte_of or x in (127,) or x < 33 or 127 <= x < 161 or x == 173)}
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    raw_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return None
    return list(zip(ids_a, raw_a)), list(zip(ids_b, raw_b))


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, kind="ends"):
    counts, per = collections.Counter(), []
    for _, text in rows:
        got = whole_tokens(text)
        if got is None:
            per.append(None)
            continue
        a, b = spans(got[0]), spans(got[1])
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, lo = [], 0
        for hi in both:
            groups.append(([x for x in a if lo < x[2] <= hi], [y for y in b if lo < y[2] <= hi]))
            lo = hi
        if kind == "ends":
            b_at = {e: i for i, _, e in b}
            links = [(i, b_at[e]) for i, _, e in a if e in b_at]
        elif kind == "products":
            links = [(x[0], y[0]) for g, h in groups for x in g for y in h]
        else:
            links = [(x[0], y[0]) for g, h in groups for x in g for y in h if max(x[1], y[1]) < min(x[2], y[2])]
        counts.update(links)
        said = ";".join(",".join(str(x[0]) for x in g) + "|" + ",".join(str(y[0]) for y in h) for g, h in groups)
        per.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (doc, _), p in zip(rows, per):
        if p is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, *p[:3], len(p[3]), sum(counts[k] == best[k[1]] for k in p[3]), sum(counts[k] for k in p[3]), p[4]))
    return out


def aligned(docs, links="ends"):
    return [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in token_align.align_tokenizers(docs, A, B, links).collect()]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.fixture(scope="module")
def rows():
    rows = [(i, t) for i, t in enumerate(texts())]
    return rows + rows[20:24] + [(None, "the the x1"), (None, None)]


@pytest.mark.parametrize("kind", token_align.LINKS)
def test_by_brute_force(spark, rows, kind):
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "b") for d, t in rows], SCHEMA)
    want = brute(rows, kind)
    assert sum(r[1] == 0 for r in want) < 20 < sum(r[1] > 0 for r in want)
    assert key(aligned(docs, kind)) == key(want)


def test_light_pairs_and_small_memory(spark, rows, monkeypatch):
    """Every pair by shuffle, and a cache that is emptied all the time, change nothing."""
    monkeypatch.setattr(token_align, "HEAVY_PAIRS", 0)
    docs = spark.createDataFrame([(d, t, 1, 2, 3, "b") for d, t in rows], SCHEMA)
    assert key(aligned(docs)) == key(brute(rows))
    monkeypatch.setattr(token_align, "CACHE_PIECES", 3)
    monkeypatch.setattr(token_align, "ROWS_AT_ONCE", 2)
    aligner = token_align.Aligner(token_align._ByteLevel(A), token_align._Pieces(B))
    want = {r[0]: r[1:4] + r[7:] for r in brute(rows)}
    for i in range(0, len(texts()), 2):
        got = aligner.texts([t for _, t in rows[i : i + 2]])
        for k, (doc, _) in enumerate(rows[i : i + 2]):
            assert tuple(got.column(c)[k].as_py() for c in ("n_a", "n_b", "n_groups", "groups_sha256")) == want[doc]


def test_whole_texts_where_no_cut_is_proven(rows):
    """Without the proof of the tokenizer files texts are encoded whole, with the same result."""
    cut, whole = (token_align.Aligner(token_align._ByteLevel(A), token_align._Pieces(B)) for _ in range(2))
    assert cut.cut
    whole.cut = False
    some = [t for _, t in rows]
    assert cut.texts(some).drop_columns(["pairs", "times"]).equals(whole.texts(some).drop_columns(["pairs", "times"]))


def test_empty(spark):
    assert aligned(spark.createDataFrame([], SCHEMA)) == []
    with pytest.raises(ValueError):
        token_align.align_tokenizers(spark.createDataFrame([], SCHEMA), A, B, "all")
