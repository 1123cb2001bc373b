"""The training-data operators against brute force on a small fixture with the awkward cases."""

import base64
import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import class_lm, decontam, host_rules, lang_filter, mixture, ngram_join, pii, quality_knn, token_resync, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, s long, comp string"


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéfgß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120).split(" ")
    out = [None, "", " \n\t ", "one", "one", "ONE", "two words here", say(40), "x" * 5000, say(9000)]
    for k in range(40):
        near = list(base)
        for at in rng.sample(range(120), k % 9):
            near[at] = f"w{k}x{at}"
        out.append(" ".join(near))
    out += [say(rng.randint(1, 80)) for _ in range(40)] + ["mail a.b@c-d.org +1 (555) 123-4567 10.0.0.256 10.0.0.25 4111 1111 1111 1111.\n" * 3, "token = \"12ab34cd56\" no"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], 0, i, i, "c") for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, empty, rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs.unionByName(docs.filter("doc_id = 3"))).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngram_join.near_duplicates(empty).collect() == []


def test_tile_cells_lose_no_pair(docs, rows, monkeypatch):
    want = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    for sizes in ({"TILE_ROWS": 3, "LIGHT_ROWS": 1}, {"TILE_ROWS": 3, "LIGHT_ROWS": 6, "HOT_TIMES": 0}):
        for name, value in sizes.items():
            monkeypatch.setattr(ngram_join, name, value)
        assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == want


def test_bitmaps_of_any_width_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 23, 24, 120, 255, 257, 511, 513, 4000, 40_000):
        for _ in range(8):
            one = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            keep = rng.integers(0, n + 1)
            two = np.concatenate((one[:keep], rng.integers(0, 1 << 62, rng.integers(0, n // 4 + 1), dtype=np.uint64)))
            both = len(np.intersect1d(one, two))
            link = 9 * both >= 4 * (len(one) + len(two))
            assert ngram_join._may_link(len(one), len(two), *(ngram_join._bitmap(ngram_join.mix(x)).view(np.uint64) for x in (one, two))) or not link


def test_tiles_walk_up_to_the_size_bound_only():
    tile, n = np.array([0, 0, 0, 0, 1, 1]), np.array([8, 10, 11, 13, 13, 13])
    x, y = ngram_join._walk(tile, n, lambda i, j: np.ones(len(i), bool))
    assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 1), (1, 2), (2, 3), (4, 5)]


def brute_spans(t):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(f"card:{m.start()}:{m.end()}")
    return ",".join(out + [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15])


def test_pii(docs, empty, rows):
    got = {r.doc_id: r for r in pii.scan_pii(docs, with_text=True).collect()}
    for i, t, *_ in rows:
        assert got[i].base_sha256 == hashlib.sha256(brute_spans(t or "").encode()).hexdigest()
    assert got[max(got)].redacted == 'token = "[ACCOUNT]" no'
    assert pii.scan_pii(empty).collect() == []
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@-+ 9()%2:/é") for _ in range(rng.randint(0, 40)))
        assert pii._say(pii.find_spans(t), pii.BASE_KINDS) == brute_spans(t)
    kept = pii.redact_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)


def warc_pages():
    fake = "x\r\n\r\nWARC/1.1\r\nWARC-Type: {}\r\nWARC-Record-ID: {}\r\n{}\r\nContent-Length: {}\r\n\r\n\r\n\r\nWARC/1.1\r\n"
    traps = [
        fake.format("response", "<urn:page:7>", "A: b", "0"),
        fake.format("response", "<urn:page:7>", "A: b", "²"),
        fake.format("revisit", "<urn:page:7>", "X-Payload-Length: abc", "0"),
        fake.format("response", "<urn:page:99999999999999999999>", "A: b", "0"),
        fake.format("response", "<urn:page:7>", "A: b", "9" * 40),
        "WARC/1.1\r\nWWARC/1.1\r\nWARC/1.1",
    ]
    pages = [(1, "u\r\nv", traps[0]), (2, None, None), (3, "u", ""), (4, "u", "é"), (9, "u", "é"), (5, "u", traps[0]), (None, "u", "z")]
    return pages + [(20 + k, "u", t) for k, t in enumerate(traps[1:])] + [(40 + k, "u", f"<p>{k}</p>" * k) for k in range(30)]


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_warc_round_trip(spark, split):
    pages = warc_pages()
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int").coalesce(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.round_trip(df).collect()
        none = warc.round_trip(df.filter("page_id = 0")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r.page_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(pages) == len(got) and none == []
    keep = {1: 5, 2: 40, 3: 40, 4: 9}  # page 40 is empty too
    for i, _, h in pages:
        b = (h or "").encode()
        kind = ("revisit", keep[i]) if i in keep else ("response", None)
        assert got[i] == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), *kind)


def test_payloads_with_only_null_ids_and_repeated_ids_are_responses(spark):
    df = spark.createDataFrame([(None, "u", "a"), (None, "u", "a"), (3, "u", "b"), (3, "u", "b"), (None, "u", "b")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()) == [(0, "response", None), (0, "response", None), (0, "revisit", 3), (3, "response", None), (3, "response", None)]


def test_archives_that_break_off_are_errors(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/ok")
    (file,) = (tmp_path / "ok").glob("part-*")
    whole = file.read_bytes()
    said = lambda payload: b"Content-Length: %d" % (len(warc._HTTP) + payload)
    for name, data in {"late": b"?" + whole, "short": whole[:-9], "none": b"no record at all", "gap": whole.replace(said(1), said(2), 1)}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.txt").write_bytes(data)
        with pytest.raises(ValueError, match="record chain"):
            warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
    assert warc.read_warc(spark, f"file://{tmp_path}/ok").count() == 2


def test_pointer_jumping_keeps_the_chain_only():
    start, following = np.array([0, 10, 15, 30, 31]), np.array([10, 30, 31, 40, 40])
    assert warc.reachable(start, following, start == 0).tolist() == [True, True, False, True, False]
    assert warc.reachable(start, following, start == 15).tolist() == [False, False, True, False, True]


def test_contamination(spark, docs, empty, rows):
    gaps = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = {r[0]: gaps.findall((r[1] or "").translate(LOWER)) for r in rows}
    bench = {1: " ".join(words[9][100:130]), 20: " ".join(words[12][5:25]), 3: "two words here", 4: "", 5: None, 6: "one"}
    df = spark.createDataFrame([(k, v, "x") for k, v in bench.items()], "item_id long, text string, doc_id string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.contamination(docs, df).collect()}
    for i, w in words.items():
        hit, items = set(), set()
        for k, t in bench.items():
            b = gaps.findall((t or "").translate(LOWER))
            n = min(13, len(b))
            own = {tuple(b[p : p + n]) for p in range(len(b) - n + 1)} if b else set()
            for p in range(len(w) - n + 1 if b else 0):
                if tuple(w[p : p + n]) in own:
                    hit |= set(range(p, p + n))
                    items.add(str(k))
        sha = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert got[i] == (len(w), len(hit), len(items), sha, bool(hit) and 20 * len(hit) >= len(w)), i
    assert not any(r.contaminated for r in decontam.contamination(docs, df.filter("item_id < 0")).collect())
    assert decontam.contamination(empty, df).collect() == []


def test_class_lm(docs, empty, rows):
    tokens = {r[0]: [*WORD.findall((r[1] or "").translate(LOWER)), None] for r in rows}
    count = collections.Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    total, distinct = sum(count.values()), len(count)
    got = class_lm.score_texts(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t))
        assert math.isfinite(r.score) and r.score < 0
    assert class_lm.score_texts(empty).collect() == []


def test_class_lm_tail_join_gives_the_same_base(docs, monkeypatch):
    want = {r.doc_id: (r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in class_lm.score_texts(docs).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 40)
    got = class_lm.score_texts(docs).collect()
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in got} == {k: v[:2] for k, v in want.items()}


def test_quality_host_and_mixture_edges(spark, docs, empty, rows):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_knn.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in quality_knn.score_quality(docs, labels.filter("doc_id < 0")).collect()} == {0.5}
    assert quality_knn.score_quality(empty, labels).collect() == []
    assert host_rules.quality_rules(empty).collect() == [] and mixture.mix_sources(empty).collect() == []
    by = {r.doc_id: r for r in host_rules.quality_rules(docs).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {q for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for q in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (by[i].n_words, by[i].word_chars, by[i].n_repeat_words, by[i].n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))


def test_mixture(docs, rows):
    got = mixture.mix_sources(docs).collect()
    again = {tuple(r) for r in mixture.mix_sources(docs).collect()}
    assert {tuple(r) for r in got} == again
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in ("a", "b", None)}
    open_, want, left = {"a": 5, "b": 2, None: 1}, {}, 1.5 * sum(size.values())
    while full := [s for s in open_ if left * open_[s] / sum(open_.values()) >= 2 * size[s]]:
        for s in full:
            want[s] = 2.0 * size[s]
        left -= sum(2 * size[s] for s in full)
        for s in full:
            del open_[s]
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    source = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]]) and 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_language(spark, empty):
    rng = random.Random(1)
    say = {"en": ["the", "and", "house", "with"], "de": ["der", "und", "haus", "mit"]}
    rows = [(i, " ".join(rng.choice(say[k]) for _ in range(30)), k) for i in range(60) for k in [("en", "de")[i % 2]]]
    rows += [(100, None, "en"), (101, "12 ...", "en"), (102, "", None), (103, "the house and", None)]
    got = {r.doc_id: r for r in lang_filter.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:60])
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert lang_filter.identify(empty).collect() == []


def test_token_counts(docs, empty, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    got = {r.doc_id: tuple(r)[1:] for r in token_resync.count_tokens(docs, path).collect()}
    for i, t, *_ in rows:
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)
    assert token_resync.count_tokens(empty, path).collect() == []
    for s in ("a" * 3000 + " b", "x y\n\n  z" * 900, "é" * 300 + "  \n" * 800 + "it's <|endoftext|> ok" * 90):
        for chunk, overlap in ((1000, 16), (300, 2)):
            assert token_resync.count_huge(plain, s, chunk, overlap) == len(plain.encode(s).ids)


def test_added_spans_by_brute_force():
    url = re.compile(r"[A-Za-z0-9]+://[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*")
    rng = random.Random(8)
    for _ in range(20_000):
        t = "".join(rng.choice(["a", "b1", ":", "/", "://", "@", ".", " ", "é", "#"]) for _ in range(rng.randint(0, 14)))
        assert pii.find_spans(t)["url"] == [m.span() for m in url.finditer(t)], t


def test_accounts_are_checked_by_what_the_cue_says():
    said = {
        "IBAN: DE89 3704 0044 0532 0130 00 and more": "DE89 3704 0044 0532 0130 00",
        "iban GB82WEST12345698765432.": "GB82WEST12345698765432",
        "IBAN DE88370400440532013000": None,
        "SSN: 123-45-6789": "123-45-6789",
        "ssn 000-45-6789": None,
        "Passport no. X1234567": "X1234567",
        "passport 12345678901": None,
        "API_Key = 12ab34cd": "12ab34cd",
        "Account number: 00123456": "00123456",
        "account of the year": None,
        "mytoken: 12345678": None,
        "İİ Token: 12345678": "12345678",
    }
    for text, want in said.items():
        assert [text[a:b] for a, b in pii.find_spans(text)["account"]] == ([want] if want else []), text


def test_parsers_take_time_in_proportion(capsys):
    import time

    for unit in ("a:", "x://a:", "iban DE89 3704 0044 ", "a.a@", "+1(", "1-", "1.", "token:a"):
        times = []
        for n in (20_000, 80_000):
            text = "x://" + unit * n
            began = time.perf_counter()
            pii.find_spans(text)
            times.append(time.perf_counter() - began)
        assert times[1] < 10 * times[0] + 0.5, unit


def test_tokens_of_texts_with_rare_spaces(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    plain, rng = Tokenizer.from_file(path), random.Random(9)
    parts = ["a", "it's", " ", "  ", "\u00a0", "\u200b", "\ufeff", "\n", "é", "12", ",", "<|endoftext|>", "\u3000"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(rng.choice(parts) for _ in range(90_000))]
    assert token_resync._cuttable(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_resync.count_tokens(df, path).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize("chunk, overlap", [(40, 1), (300, 16), (16_384, 256)])
def test_texts_over_one_chunk_are_spliced_with_null_and_repeated_ids(spark, docs, chunk, overlap):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(path)
    texts = [r.text for r in docs.limit(60).collect()] + [None, "", " ", "x" * 500, " \n" * 400, "one two " * 3000, "a" * 41]
    ids = [None if i % 7 == 0 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(k, t, "z") for k, t in zip(ids, texts)], "doc_id long, text string, n_tokens string")
    got = token_resync.count_tokens(df, path, chunk=chunk, overlap=overlap).collect()
    want = []
    for k, t in zip(ids, texts):
        n = len(plain.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 512))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_other_tokenizers_get_whole_texts(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    assert not token_resync._cuttable(path)
    df = spark.createDataFrame([(1, "Hello  World it's"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_resync.count_tokens(df, path).collect()}
    assert got == {1: len(Tokenizer.from_file(path).encode("Hello  World it's", add_special_tokens=False).ids), 2: 0}


def test_votes_by_brute_force():
    rng = np.random.default_rng(3)
    rows = rng.random((60, quality_knn.WIDTH)).astype(np.float32)
    rows[30:40] = rows[20:30]  # ties
    labels = rng.integers(0, 2, 60)
    model = quality_knn.NeighbourModel(rows.copy(), labels)
    queries = np.concatenate((rows[:25], rng.random((7, quality_knn.WIDTH)).astype(np.float32), np.zeros((1, quality_knn.WIDTH), np.float32)))
    got = model.scores(queries)
    cosine = model.project(queries) @ model.vectors.T
    for q in range(len(queries) - 1):
        near = sorted(range(60), key=lambda i: (-cosine[q, i], i))[: quality_knn.NEIGHBOURS]
        weight = [max(cosine[q, i], 1e-3) ** quality_knn.SHARPNESS for i in near]
        assert got[q] == pytest.approx(sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight), rel=1e-4)
    assert got[-1] == model.prior
    assert np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-4)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = quality_knn.score_quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.97


def test_filters_by_exact_sets():
    rng = random.Random(2)
    codes = {k: {rng.randrange(1 << 32) for _ in range(n)} for k, n in ((0, 3000), (1, 9000), (2, 50))}
    flat = np.array([c for k in codes for c in codes[k]], np.int64)
    langs = np.array([k for k in codes for _ in codes[k]], np.int64)
    model = lang_filter.LanguageFilter(["a", "b", "c"], flat, langs)
    one, two = lang_filter._slots(flat.astype(np.uint64))
    both = model.tables[0][one] & model.tables[0][two]
    assert all(int(both[i]) >> int(k) & 1 for i, k in enumerate(langs))  # no gram is lost
    rng2 = np.random.default_rng(5)
    other = rng2.integers(1 << 33, 1 << 34, 400_000).astype(np.uint64)
    a, b = lang_filter._slots(other)
    for k in range(3):
        rate = float((((model.tables[0][a] & model.tables[0][b]) >> np.uint64(k)) & np.uint64(1)).mean())
        assert rate == pytest.approx(model.false[k], rel=0.15, abs=2e-4)  # the rate that counts are corrected by
    text = b"the house and the garden"
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    code, whole = lang_filter.grams(data, offsets)
    own = lang_filter.LanguageFilter(["x", "y"], code[whole].astype(np.int64), np.zeros(int(whole.sum()), np.int64))
    counts = own.counts(data, offsets)[0]
    assert counts[0] == pytest.approx(whole.sum(), rel=1e-6) and counts[1] == 0


def test_a_failing_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "x y z", "bad") for i in range(60)] + [(100, good, "bad")] + [(200 + i, good, "fine") for i in range(30)] + [(300, "x y", "fine"), (400, good, None)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in host_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == (True, False) and got[100] == (False, False) and got[200] == (False, True) and got[300] == (True, False) and got[400] == (False, True)


def test_null_and_repeated_ids_come_back_row_by_row(spark, docs):
    odd = docs.filter("doc_id in (7, 8, 9, 12)")
    odd = odd.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(8, 1, 0), (9, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "two words here")], "item_id long, text string")
    for rows in (decontam.contamination(odd, bench), quality_knn.score_quality(odd, labels), host_rules.quality_rules(odd), lang_filter.identify(odd), mixture.mix_sources(odd), class_lm.score_texts(odd), pii.scan_pii(odd), ngram_join.near_duplicates(odd)):
        ids = collections.Counter(r.doc_id for r in rows.select("doc_id").collect())
        assert ids == {7: 2, 8: 2, 9: 2, 12: 2, None: 4}
    mixed = mixture.mix_sources(odd.withColumn("doc_id", F.lit(None).cast("long")))
    total, target = mixed.agg(F.sum("taken")).first()[0], sum(r.target for r in mixed.select("source_size", "target").distinct().collect())
    assert abs(total - target) <= 3
