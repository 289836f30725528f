"""Filter audit, byte-level BPE and hard negatives against brute force, and their defined results for odd rows."""

import base64
import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from frameloom.llm import byte_pairs, filter_audit, hard_negatives

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = byte_pairs.defaults(None, None)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILES[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=FILES[1], mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_pairs.Coder(*FILES)


# ---- 11 ----------------------------------------------------------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aabbeht n'sé🙂字\n\t 019# 　\x1c"), max_size=60) | st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_are_the_librarys(text):
    coder = byte_pairs.coder(*FILES)
    ids = np.frombuffer(coder.encode([text])[0], np.uint32).tolist()
    assert ids == test_ids_are_the_librarys.library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@pytest.fixture(scope="module", autouse=True)
def _library(library):
    test_ids_are_the_librarys.library = library


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 4000, "".join(random.Random(3).choices("abcdefgh", k=20_000)), "é" * 999, "the" * 700])
def test_long_pieces(own, library, piece):
    assert byte_pairs.merged(piece.encode(), own.ranks) == library.encode_ordinary(piece)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=64) | st.text("abert nou", min_size=1, max_size=64).map(str.encode), min_size=1, max_size=30))
def test_trees_side_by_side(pieces):
    coder = byte_pairs.coder(*FILES)
    ids, counts = byte_pairs.merged_together(pieces, coder.singles, coder.pair_ranks)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [byte_pairs.merged(p, coder.ranks) for p in pieces]


def test_merges_leftmost_of_equal_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301, b"ba": 299}
    ids, counts = byte_pairs.merged_together([b"aaaaa", b"aab", b"baa", b"z"], np.arange(256), byte_pairs.PairRanks(ranks))
    assert ids.tolist() == [300, 301, 300, 98, 299, 97, 122] and counts.tolist() == [2, 2, 2, 1]
    assert byte_pairs.merged(b"aaaaa", ranks) == [300, 301]
    assert byte_pairs.merged(b"aab", ranks) == [300, 98]
    assert byte_pairs.merged(b"baa", ranks) == [299, 97]
    assert byte_pairs.merged(b"aaa", ranks | {b"aaa": 301}) == [301]
    assert byte_pairs.merged(b"", ranks) == [] and byte_pairs.merged(b"z", ranks) == [122]


def test_memory_is_bounded_and_results_are_not_changed(own, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 10)
    monkeypatch.setattr(byte_pairs, "SLICE", 16)
    texts = [" ".join(f"word{i % 37} {'y' * (i % 90)}" for i in range(k)) for k in (500, 3, 1, 40)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert all(len(x) <= byte_pairs.LONGEST for x in own.known)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one one"), (4, "one one"), (None, "no id"), (5, "naïve 🙂 <|endoftext|>"), (6, "long words " * 30_000), (7, "x" * 50_000)]


def test_texts_encode_and_decode(spark, library):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("bytes", F.lit("x"))
    encoded = byte_pairs.encode_texts(docs)
    key = lambda r: (r[0] or 0, r[1:])
    want = sorted(((i, library.encode_ordinary(t or "")) for i, t in ODD), key=key)
    assert sorted(map(tuple, encoded.collect()), key=key) == want
    assert sorted(((r[0], bytes(r[1])) for r in byte_pairs.decode_ids(encoded).collect()), key=key) == sorted(((i, (t or "").encode()) for i, t in ODD), key=key)
    rows = [(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for i, ids in want]
    assert sorted((tuple(r[:3]) for r in byte_pairs.digests(encoded).collect()), key=key) == rows
    assert byte_pairs.digests(byte_pairs.encode_texts(docs.limit(0))).collect() == []
    assert byte_pairs.decode_ids(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, b""), (2, b"")]


def test_query_is_the_librarys(spark, library):
    from frameloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# ---- 12 ----------------------------------------------------------------------------------------------------------------------
def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); every order run over every document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        again = first.get(t) is not None and sum((x[1] or "") == t for x in rows) > 1 if i is None else first[t] < i
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": again}
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                redundant, unique = sum(d[1][f] for d in gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in docs if d[0] == part)
                gone += now
                out[part, order, step] = (len(left), len(now), redundant, unique, sum(d[2] for d in now), sum(d[3] for d in now))
                shapley[part, f] = shapley.get((part, f), 0) + len(now)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit(spark):
    rng = random.Random(5)
    words = lambda n, pool: " ".join(rng.choices([f"w{i}" for i in range(pool)], k=n))
    texts = [words(rng.choice([5, 99, 100, 150]), rng.choice([20, 10_000])) + rng.choice(["", " #", " $&", ""]) for _ in range(40)]
    texts += [t.upper() for t in texts[:15]] + texts[:10] + ["", None, " é\x1c x", "A" * 10 + "é" * 90, "A" * 11 + "é" * 89, "long word " * 20_000]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)] + [(3, texts[3], "en"), (3, "other", "fr"), (None, texts[4], "en"), (None, "alone", "de"), (900, texts[4], "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("z") for c in ("mask", "digest", "part", "first", "good", "n")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("known", F.lit(1))
    got = filter_audit.audit(filter_audit.failure_cells(docs, said)).drop("filter")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    assert filter_audit.audit(filter_audit.failure_cells(docs.limit(0), said)).collect() == []
    no_labels = filter_audit.audit(filter_audit.failure_cells(docs, said.limit(0))).drop("filter")
    assert sorted(map(tuple, no_labels.collect())) == brute_audit(rows, [])


def test_filter_audit_joins_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "broadcast_if_few", lambda df: df)
    rows = [(i, f"t{i % 7}", "en") for i in range(60)]
    got = filter_audit.audit(filter_audit.failure_cells(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))).drop("filter")
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, [(1, 1, 0)])


# ---- 13 ----------------------------------------------------------------------------------------------------------------------
def brute_negatives(rows, positives=5, negatives=3):
    """rows: (vec_id, label, integer vector), distinct ids; anchors are divisible by 5."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for v, l, q in rows:
        if v % 5:
            continue
        near = sorted(((-dot(q, q2), v2) for v2, l2, q2 in rows if l2 == l and v2 != v))[:positives]
        for s, p in near:
            far = sorted((-dot(q, q2), v2) for v2, l2, q2 in rows if l2 != l)
            fits = [(-x, v2) for x, v2 in far if 50 * -s <= 100 * -x <= 95 * -s][:negatives]
            out += [(v, p, k, v2, -s, x) for k, (x, v2) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 8192])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "FIRST", 5)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)) if i % 3 else 0, rng.normal(size=6).tolist()) for i in range(90)]
    rows += [(200 + i, i % 2, [0.5] * 6) for i in range(20)] + [(300, 7, [1.0] * 6), (305, 1, []), (310, 0, [2.0, -3.0])]
    odd = [(400, None, [1.0]), (405, 1, None), (410, 1, [None, 1.0]), (415, 1, [float("nan")]), (420, 1, [float("inf")]), (None, 1, [1.0] * 6), (425, 2, [9.0] * 6), (425, 1, [9.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit(1) for c in ("q", "x", "grp", "i", "j", "asks")})
    quantised = [(v, l, np.floor(256 * np.array(e, np.float32).astype(float)).astype(int).tolist()) for v, l, e in [*rows, (425, 1, [9.0] * 6)]]
    made = hard_negatives.quantised(df)
    assert sorted(map(tuple, made.collect())) == sorted(quantised)
    got = hard_negatives.mine(made, F.col("vec_id") % 5 == 0, block=block)
    assert sorted(map(tuple, got.collect())) == brute_negatives(quantised)


def test_no_vectors(spark):
    df = spark.createDataFrame([(5, None, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.quantised(df), F.col("vec_id") % 5 == 0).collect() == []
    one = spark.createDataFrame([(5, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(hard_negatives.quantised(one), F.col("vec_id") % 5 == 0).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 9, 30]), st.sampled_from([0.0, 1 / 16, 1.0]))
def test_sliced_scores(seed, bits, few):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-(1 << bits), 1 << bits, (n, 4)) for n in (6, 17))
    allowed, exact = rng.random((6, 17)) < 0.8, a @ b.T
    low, high = np.sort(np.quantile(exact, rng.random((2, 6))).astype(np.int64), axis=0)
    i, j, score = hard_negatives.sliced_scores(a, b, allowed, low, high, bits, few)
    want = np.argwhere(allowed & (exact >= low[:, None]) & (exact <= high[:, None]))
    assert sorted(zip(i.tolist(), j.tolist(), score.tolist())) == sorted((x, y, exact[x, y]) for x, y in want.tolist())


def test_products_that_do_not_fit_are_refused(spark):
    df = spark.createDataFrame([(5, 1, [1e9]), (6, 1, [1e9])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        hard_negatives.mine(hard_negatives.quantised(df), F.col("vec_id") % 5 == 0)
