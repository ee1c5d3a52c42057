"""Token alignment against a plain version that walks each text."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from freshet.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text, both):
    """[(ids of A, ids of B)] of each group; none where bytes differ."""
    hf, sp = both
    if not text:
        return []
    shown = {chr(b): b for b in align.SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in align.SHOWN)}
    a, b = hf.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    a_bytes = [bytes(shown[c] for c in hf.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a[i:k], b[j:m]))
        i, j = k, m
    return out


def expected(rows, both):
    groups = [plain(t, both) for _, t in rows]
    count = Counter(p for g in groups for p in {(x, y) for a, b in g for x in a for y in b})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (i, _), g in zip(rows, groups, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return Counter(out)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1000])
def test_common_ends(piece):
    rng = np.random.default_rng(piece)
    for n, m in ((0, 0), (0, 3), (4, 0), (1, 1), (40, 30), (300, 5), (200, 250)):
        a, b = (np.sort(rng.choice(400, k, replace=False)) for k in (n, m))
        i, j = align.common_ends(a, b, piece)
        want = np.intersect1d(a, b)
        assert a[i].tolist() == b[j].tolist() == want.tolist()


TEXTS = ["Hello world", "  two  spaces ", "tabs\tand\nlines\n\n", "naïve café 漢字 \U0001f600\U0001f469‍\U0001f469", "<|endoftext|> and </s> <s> <unk> <0x41>", "▁under▁", "x" * 500,
         " " * 60, "1234567890 " * 20, "don't we'll THEY'RE", "\x00\x01", "a b　c", "", None, "a", " ", "﻿bom", "é é", "ﬁ ligature ½", "\r\n\r\n mixed \v\f"]


def test_against_plain(spark, both, monkeypatch):
    rng = random.Random(6)
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice(["the ", "water", " ", "\n", "é", "漢", "12", ".", "Flow", "-", "\U0001f30a"]) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(7, "Hello world"), (None, "Hello there"), (7, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = expected(rows, both)
    assert Counter(map(tuple, align.measured(df).collect())) == want
    monkeypatch.setattr(align, "BLOCK_BYTES", 300)
    got = align.measured(df.withColumnsRenamed({"doc_id": "block", "text": "links"}), "block", "links")
    assert got.columns[0] == "block" and Counter(map(tuple, got.collect())) == want


def test_real_texts(spark, both):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, align.measured(docs).collect())) == expected(rows, both)


def test_groups_of_tokens(spark, both, edge, none):
    got = {r.doc_id: r for r in align.aligned(edge.where("doc_id > 2 or doc_id < 0")).collect()}
    for r in edge.where("(doc_id > 2 or doc_id < 0) and doc_id not in (5, 6)").collect():
        g, x = plain(r.text, both), got[r.doc_id]
        assert [len(a) for a, _ in g] == x.a_counts and [len(b) for _, b in g] == x.b_counts
        assert sum((a for a, _ in g), []) == x.a_ids and sum((b for _, b in g), []) == x.b_ids
    assert sum(got[5].a_counts) == len(got[5].a_ids) and sum(got[5].b_counts) == len(got[5].b_ids) > 40_000
    assert align.aligned(none).count() == 0 and align.measured(none).count() == 0 and align.measured(edge).count() == edge.count()


def test_large_groups_by_distinct_ids(both):
    x = align.Aligned(["ab" * 40, "Hello", None, "x" * 999], A, B)
    whole = align.Aligned.pairs(x)
    want = [Counter((p << 16 | q) for a, b in plain(t, both) for p in a for q in b) for t in ("ab" * 40, "Hello", None, "x" * 999)]
    at = 0
    for w, n in zip(want, whole[2], strict=True):
        assert dict(zip(whole[0][at : at + n].tolist(), whole[1][at : at + n].tolist(), strict=True)) == w
        at += n
    assert x.n_links.tolist() == [sum(w.values()) for w in want]
