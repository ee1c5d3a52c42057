"""Encoding, decoding and scoring against plain versions."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.llm import bpe, ppm
from freshet.llm.common import opened


def test_encode_decode(spark, edge):
    out = bpe.decode(bpe.encode(edge.withColumns({"block": F.lit(1), "ids": F.lit("x"), "words": F.lit(None)}))).collect()
    t = bpe._tokenizer(bpe.vocabulary())
    want = Counter()
    for r in edge.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[(r.doc_id, tuple(ids), t.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == want


@given(st.text(max_size=80))
@settings(max_examples=400, deadline=None)
def test_words_alone_give_the_same_ids(text):
    path = bpe.vocabulary()
    t = bpe._tokenizer(path)
    words = bpe.split(text, path)
    assert "".join(words) == text
    assert [i for w in words for i in t.encode(w, add_special_tokens=False).ids] == t.encode(text, add_special_tokens=False).ids


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([([50256, 255],), ([],), (None,), ([447],)], "ids array<int>")
    got = [r.decoded for r in bpe.decode(df).collect()]
    t = bpe._tokenizer(bpe.vocabulary())
    assert got == [t.decode([50256, 255], skip_special_tokens=False), "", None, t.decode([447], skip_special_tokens=False)]


def test_scores(spark, edge):
    out = ppm.score(edge.withColumns({"block": F.lit(1), "words": F.lit("x")}))
    rows, docs = out.collect(), edge.collect()
    c = Counter(w for r in docs if not ppm.held_out(r.doc_id) for w in ppm.tokens((r.text or "").encode()))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in docs:
        t = ppm.tokens((r.text or "").encode())
        want[(r.doc_id, ppm.held_out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 3))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in rows) == want
    for r in rows:
        assert r.score <= 0 and math.isfinite(r.score)
        assert r.score == pytest.approx(np.logaddexp(r.pretrained * math.log(10), r.adaptive * math.log(10)) / math.log(10) + math.log10(0.5))


def test_nothing_to_learn(spark, edge):
    held = [i for i in range(1000) if ppm.held_out(i)]
    out = ppm.score(spark.createDataFrame([(held[0], "ab")], "doc_id long, text string")).first()
    assert (out.train_tokens, out.n_known, out.base_score) == (0, 0, 0)
    assert out.pretrained == pytest.approx(-4 * math.log10(256))  # a, b, space, end


def _trie(words, counts, least=0):
    k, s = ppm.entries(words, counts)
    node, at = np.unique(k >> 8, return_inverse=True)
    return ppm.Trie(k[s >= least], s[s >= least], node, np.bincount(at, s))


@pytest.mark.parametrize("least", [0, 3, 6])
def test_symbols_sum_to_one(least):
    trie = _trie([b"abab", b"abba", b"cab", ppm.END], np.array([5, 3, 2, 4.0]), least)
    for prefix in (b"", b"a", b"ab", b"abb", b"zz", b"cab"):
        total = 0
        for b in range(256):
            symbol, context, known, _ = ppm.positions([prefix + bytes([b])])
            n = len(prefix) + 1
            total += 10 ** trie.symbols(symbol[:n], context[:n], known[:n])[-1]
        assert total == pytest.approx(1)


def test_escape_and_exclusion():
    """Contexts of one byte by hand: after a: b 3 of 4, c 1 of 4."""
    trie = _trie([b"ab", b"ac"], np.array([3, 1.0]))
    symbol, context, known, _ = ppm.positions([b"ab", b"ad"])
    p = trie.symbols(symbol, context, known)
    assert p[1] == pytest.approx(math.log10(2.5 / 4))
    # d after a: escape 1/4 (context " a", total 4), no new symbol after "a"; below it a 4 and space 4 of 8 are left, each half a count
    left = 256 - 4
    assert p[4] == pytest.approx(math.log10(1 / 4) + math.log10(1 / 8) - math.log10(left))


def test_adaptive_is_a_distribution():
    """Over an alphabet of three words with all probability, the next word's probabilities sum to one."""
    p = np.log10(np.array([0.5, 0.3, 0.2]))
    for past in ([], [0], [0, 0, 1], [2, 1]):
        before = ppm.adaptive(np.array(past, int), p[past]) if past else 0.0
        total = sum(10 ** (ppm.adaptive(np.array([*past, w]), p[[*past, w]]) - before) for w in range(3))
        assert total == pytest.approx(1)


def test_rare_contexts_are_kept(spark):
    """A name met twice in 1.5 MB of other text: each of its contexts, with a few counts, is in the trie."""
    rng = np.random.default_rng(0)
    train = [i for i in range(1000) if not ppm.held_out(i)][:60]
    held = next(i for i in range(1000) if ppm.held_out(i))
    fill = ["".join(chr(97 + c) for c in rng.integers(0, 10, 6)) for _ in range(500)]
    docs = [(i, " ".join(fill[k] for k in rng.integers(0, 500, 3600))) for i in train] + [(train[0], "zyqxwvk"), (train[1], "zyqxwvk"), (held, "zyqxwvk")]
    out = ppm.score(spark.createDataFrame(docs, "doc_id long, text string")).where(f"doc_id = {held}").first()
    assert out.pretrained > -12  # the first letter and the end are rare; all that follows the name's first letters is known


def _plain(texts, text):
    """log10 probability of a text by partial matching with exclusion over whole running texts, from dictionaries."""
    def run(t):
        return b" " + b" ".join(ppm.tokens(t.encode()))

    seen = {}
    for t in map(run, texts):
        for i in range(1, len(t)):
            for k in range(min(ppm.ORDER, i) + 1):
                c = seen.setdefault(t[i - k : i], Counter())
                c[t[i]] += 1
    t, out = run(text), 0.0
    for i in range(1, len(t)):
        gone, p = set(), 1.0
        for k in range(min(ppm.ORDER, i), -1, -1):
            c = {s: n for s, n in seen.get(t[i - k : i], {}).items() if s not in gone}
            whole = sum(c.values())
            if t[i] in c:
                p *= (c[t[i]] - 0.5) / whole
                break
            if c:
                p *= len(c) / 2 / whole
            gone |= set(c)
        else:
            p /= 256 - len(gone)
        out += math.log10(p)
    return out


def test_contexts_run_across_words(spark):
    train = [i for i in range(100) if not ppm.held_out(i)]
    held = [i for i in range(200) if ppm.held_out(i)]
    prose = ["the cat sat on the mat", "The cat  ran to the old house\non the hill", "a house on the hill is old", "", "on the mat sat a cat"] * 3
    asked = ["the cat sat on the old mat", "mat the on sat old cat the", "zebra caf\u00e9", ""]
    rows = [*zip(train, prose), *zip(held, asked)]
    got = {r.doc_id: r.pretrained for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in zip(held, asked)] == pytest.approx([_plain(prose, t) for t in asked])
    assert got[held[0]] > got[held[1]] + 3


def test_adaptive_is_a_distribution_in_any_place():
    """The trie's probabilities of the next word differ from those that the words before had in their places."""
    before = np.log10(np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8], [0.2, 0.7, 0.1]]))
    here = np.log10(np.array([0.05, 0.05, 0.9]))
    for past in ([], [0], [0, 0, 1], [2, 1]):
        p = [before[i, w] for i, w in enumerate(past)]
        old = ppm.adaptive(np.array(past, int), np.array(p)) if past else 0.0
        assert sum(10 ** (ppm.adaptive(np.array([*past, w]), np.array([*p, here[w]])) - old) for w in range(3)) == pytest.approx(1)


def test_a_block_asks_once_whatever_the_splits(spark, tmp_path, monkeypatch):
    """A file read by several tasks: no block asks for its grams from two of them, and scores are those of one task."""
    rng = np.random.default_rng(1)
    some = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(3000)]
    rows = [(i, " ".join(some[k] for k in rng.integers(0, 3000, 300))) for i in range(800)] + [(800, None), (801, ""), (None, "a text without an id")]
    pq.write_table(spark.createDataFrame(rows, "doc_id long, text string").toArrow(), tmp_path / "docs.parquet", row_group_size=100)
    kept, saved = [], ppm.saved
    monkeypatch.setattr(ppm, "saved", lambda df: kept.append(saved(df)) or kept[-1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
        docs = spark.read.parquet(str(tmp_path / "docs.parquet"))
        assert docs.rdd.getNumPartitions() > 2
        split = {r.doc_id: r for r in ppm.score(docs).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    asked = [t for t in kept if "keys" in t.columns]
    assert len(asked) == 1
    assert asked[0].where("keys is not null").groupBy("block", "bucket").count().agg(F.max("count")).first()[0] == 1
    whole = {r.doc_id: r for r in ppm.score(docs.coalesce(1)).collect()}
    assert len(split) == len(rows) and split.keys() == whole.keys()
    for i, r in whole.items():
        assert tuple(split[i][1:]) == pytest.approx(tuple(r[1:]), rel=1e-12)


def test_many_documents_at_once_score_as_each_alone():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 7, 1, 40, 3])
    words, p = rng.integers(0, 6, sizes.sum()), np.log10(rng.random(sizes.sum()))
    cuts = np.cumsum(sizes)[:-1]
    assert ppm.adaptives(words, p, sizes) == pytest.approx([ppm.adaptive(*x) for x in zip(np.split(words, cuts), np.split(p, cuts), strict=True)])


@given(st.lists(st.text(max_size=30), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_and_grams_of_running_texts(texts):
    runs = [ppm.running(t) for t in texts]
    words, starts, sizes = ppm.words_of(runs)
    want = [ppm.tokens(t.encode()) for t in texts]
    assert sizes.tolist() == [len(t) for t in want]
    assert [w.rstrip(b" ") for w in words.to_pylist()] == [w for t in want for w in t]
    gram, _ = ppm.grams(runs)
    assert bytes((gram & 255).astype(np.uint8)) == b"".join(runs) and ppm.turned(ppm.turned(gram)).tolist() == gram.tolist()
    assert ppm.unpressed(ppm.pressed(gram)).tolist() == gram.tolist()


def test_a_block_counts_the_same_at_once_and_in_parts(monkeypatch):
    texts = ["the cat sat on the mat", "The cat  ran", "", None, "on the hill"] * 20
    found = []
    for at_once in (10**9, 50):
        monkeypatch.setattr(ppm, "AT_ONCE", at_once)
        block = ppm.Block()
        for i in range(0, 100, 5):
            block.add(pa.array(range(i, i + 5)), texts[i : i + 5])
        rows = [r for b in block.rows(7, 3) for r in b.to_pylist()]
        assert {r["block"] for r in rows} == {7} and sum(r["pack"] is not None for r in rows) == 20
        keys = {k: n for r in rows if r["keys"] for k, n in zip(ppm.unpressed(r["keys"]).tolist(), ppm.unpressed(r["counts"]).tolist(), strict=True)}
        words = {w: n for r in rows if r["words"] for w, n in zip(opened(r["words"]), ppm.unpressed(r["counts"]).tolist(), strict=True)}
        found.append((keys, words))
    train = [t or "" for i, t in enumerate(texts) if not ppm.held_out(i)]
    assert found[0] == found[1]
    assert {w.rstrip(b" "): n for w, n in found[0][1].items()} == Counter(w for t in train for w in ppm.tokens(t.encode()))
    assert sum(found[0][0].values()) == sum(len(ppm.running(t)) for t in train)
