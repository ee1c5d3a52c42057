"""The similarity join, mixing, quality rules and fingerprints against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import jaccard, lines, merkle, mixing, urls


def plain_links(rows, similar=0.8):
    """By position: number of links and number of the class, by comparing all pairs of texts."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    top, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                top[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(len(rows))]


def corpus(seed, families=6, size=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((4, 40, 90, 200)))]
        for _ in range(size if f else 5 * size):
            t = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
        out.append(" ".join([rng.choice(vocabulary) for _ in range(50)] + passage))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("limit", [8, 1024])
def test_join(spark, limit):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("x"), "bucket": F.lit(1), "norm": F.lit("y")})
    documents, classes = jaccard.joined(df, limit=limit)
    got = {r.id: r for r in documents.join(classes, "key").select("id", "n_links", "comp").collect()}
    links, classes_ = plain_links(rows)
    assert sum(links) > 500
    # target recall of 0.999; all links of these texts are met
    assert [got[i].n_links for i, _ in rows] == links
    by = defaultdict(set)
    for i, _ in rows:
        by[got[i].comp].add(classes_[i])
    assert all(len(c) == 1 for c in by.values()) and len(by) == len(set(classes_))


def test_join_edges(spark, edge, none):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    links, _ = plain_links(rows)
    got = jaccard.linked(edge).collect()
    assert sorted((r.n_links, -1 if r.doc_id is None else r.doc_id) for r in got) == sorted((n, -1 if r[0] is None else r[0]) for n, r in zip(links, rows, strict=True))
    assert jaccard.linked(none).count() == 0
    kept = jaccard.first_of_each(edge)
    assert kept.columns == edge.columns
    assert kept.where("trim(coalesce(text, '')) = ''").count() == 3
    assert kept.where("doc_id = 1").count() == 2 and kept.where("text = 'one'").count() == 1
    assert kept.where("doc_id in (5, 6)").count() == 2  # two of three different shingles in common
    assert jaccard.first_of_each(none).count() == 0


def test_first_of_each(spark):
    rows = corpus(5)
    _, classes = plain_links(rows)
    kept = {r.doc_id for r in jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(classes)


def test_runs_and_samples():
    assert 1 <= jaccard.runs_needed(0.9) < jaccard.runs_needed(0.999)
    h, begin = jaccard.shingles([b"a b c d e f", b"x", b"b c d e f g"])
    assert list(begin) == [0, 2, 3] and len(h) == 5
    assert h[1] == h[3] and len({int(x) for x in h}) == 4


def test_components(spark):
    n = 40
    keys = [i.to_bytes(16, "big") for i in range(n)]
    edges = [(keys[i], keys[i + 1], 1) for i in range(0, 19)] + [(keys[30], keys[25], 1), (keys[35], keys[35], 1)]
    got = {bytes(r.key): bytes(r.comp) for r in jaccard.components(spark.createDataFrame(edges, "key binary, root binary, links long")).collect()}
    assert all(got[keys[i]] == keys[0] for i in range(20)) and got[keys[30]] == got[keys[25]] == keys[25]


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    w = {k: weights[i % 3] for i, k in enumerate(sorted(sizes, key=lambda k: (k is None, k or "")))}
    out, free, left = {}, set(w), share * sum(sizes.values())
    while free:
        over = [k for k in free if left * w[k] / sum(w[x] for x in free) > cap * sizes[k]]
        if not over:
            for k in free:
                out[k] = left * w[k] / sum(w[x] for x in free)
            break
        taken = sum(cap * sizes[k] for k in over)
        for k in over:
            out[k] = cap * sizes[k]
        left, free = left - taken, free - set(over)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "é", "z"] + [f"s{i}" for i in range(rng.choice((1, 9)))]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(names[: rng.randrange(2, len(names) + 1)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"size": F.lit("x"), **{c: F.lit(1) for c in ("_of", "words", "whole", "_limit", "_cell", "_draw", "_source", "_row", "_copy", "more", "source")[:-1]}})
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = water(sizes), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2 and abs(r.copies - (r.target / r.source_size if r.source_size else 0)) < 1 + 1e-9
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 120 for s in sizes)
    assert sorted((r.doc_id, r.copies) for r in mixing.mix(df).collect()) == sorted((r.doc_id, r.copies) for r in out)
    assert mixing.repeated(mixing.mix(df), ["doc_id"]).count() == sum(r.copies for r in out)


def test_hot_source(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    for r in mixing.mix(df).groupBy("source").agg(F.max("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect():
        assert r.n == pytest.approx(r.t, abs=4)


def test_repeated_words(spark):
    def plain(w):
        seen = defaultdict(list)
        for i in range(len(w) - 4):
            seen[tuple(w[i : i + 5])].append(i)
        return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)})

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    for r in lines.base_rules(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_tokens", F.lit(1))).collect():
        assert r.n_repeat_words == plain(r.text.split()), r.text


def test_frequent_lines(spark):
    rows = [(i, f"own words {' '.join('abcdefghijklmnop'[int(d)] * 3 for d in f'{i:02}' * 6)}\nShared  LINE {'abcdefghij'[i % 10]} here", "h") for i in range(120)]
    rows += [(1000 + i, "shared line f HERE\nshared line g here\nshared line h here a b c d e", "h") for i in range(3)] + [(2000, "Shared line b here", "other")]
    rows += [rows[0]] * 5 + [rows[120]] * 4  # repeated rows are one document
    got = defaultdict(list)
    for r in lines.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows) and all(len(set(x)) == 1 for x in got.values())
    one = {k: x[0] for k, x in got.items()}
    assert all(one[i].removed_words == 4 and one[i].removed_lines == 1 and one[i].kept == (not one[i].base_failed) for i in range(120))
    assert one[1000].removed_words == 8 and one[1000].n_words - 8 < lines.MIN_WORDS and not one[1000].kept
    assert one[2000].removed_words == 0
    # a line of one document repeated is not frequent
    same = spark.createDataFrame([(1, "a b c d e f g h i j k", "h")] * 40, "doc_id long, text string, source string")
    assert {(r.removed_words, r.kept) for r in lines.quality(same).collect()} == {(0, True)}


def test_edits_are_located(spark):
    text = "First line, of some words.\nSecond line; more words here.\nThird one."
    df = spark.createDataFrame([(text, text.replace("more", "other")), (text, text), ("", text), ("", "")], "a string, b string")
    out = df.select(*[merkle.fingerprint(merkle.leaves(F.col(c))).alias(c) for c in "ab"])
    out = out.select((F.col("a") == F.col("b")).alias("same"), merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.edits(F.col("a"), F.col("b")).alias("at")).collect()
    assert [(r.same, r.at) for r in out] == [(False, [1]), (True, []), (False, []), (True, [])]
    assert 0.5 < out[0].near < 1 and (out[1].near, out[2].near, out[3].near) == (1, 0, 1)


def test_successors(spark, edge, none):
    rows = [(i * i % 97, f"text {i} " * (i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows + [(None, "n"), (None, "m")], "doc_id long, text string").withColumn("block", F.lit("x"))
    for size in (50, 10**9):
        got = merkle.with_next(df, block_chars=size).collect()
        assert len(got) == len(rows) + 2
        ids = [r.id for r in sorted(got, key=lambda r: -(r.id if r.id is not None else -1))]
        texts = defaultdict(set)
        for r in got:
            texts[r.id].add(r.text)
        for r in got:
            lower = [i for i in ids if i is not None and (r.id is not None and i < r.id)]
            allowed = texts[r.id] | (texts[max(lower)] if lower else texts[None] if r.id is not None else texts[max(i for i in ids if i is not None)])
            assert r.next_text in allowed
        assert sorted(r.next_text for r in got) == sorted(r.text for r in got)
    assert merkle.compared(none).count() == 0 and merkle.compared(edge).count() == edge.count()
    assert merkle.compared(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first().near_next == 1


def test_bloom_has_no_misses(spark):
    listed = spark.range(500).select(F.concat(F.lit("h.example/"), "id").alias("canonical"))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("x://h.example/"), "id").alias("url"), F.lit(1).alias("block"), F.lit(2).alias("id"))
    got = urls.listed_urls(pages, listed).collect()
    assert sum(r.on_list for r in got) == 500 == sum(r.on_list and r.maybe for r in got)
    assert 500 <= sum(r.maybe for r in got) < 560
    assert not any(r.maybe for r in urls.listed_urls(pages, listed.limit(0)).collect())


def test_canonical_urls(spark):
    same = ["x://h.e/a", "y://www.H.e/a/?", "x://h.e/a?utm_source=feed", "x://h.e/a?ref=1&utm_x=2#top", "x://h.e/a//#t", "x://h.e/a?&"]
    other = ["x://h.e/a?b=1", "x://h.e/a?b=1&utm_x=2", "x://h.e/A", "x://h.e/", "x://h.e", None, "none"]
    got = [r.c for r in spark.createDataFrame([(u,) for u in same + other], "url string").select(urls.canonical(F.col("url")).alias("c")).collect()]
    assert set(got[:6]) == {"h.e/a"} and got[6] == got[7] == "h.e/a?b=1" and got[8] == "h.e/A" and got[9] == got[10] == "h.e" and got[11] in (None, "") and got[12] == ""


def test_list_comes_from_content(spark):
    rows = [(1, "x://a.e/1", "You <b>Idiot</b>"), (2, "y://www.a.e/1?utm_x=1", "fine"), (3, "x://a.e/2", "idiotic"), (4, None, "scum"), (5, "x://b.e/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.id: r.on_list for r in urls.listed_urls(pages, urls.abusive(pages)).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
