"""Shards against plain best-fit-decreasing."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import shards


def plain(sizes, capacity):
    """Bytes of each shard, one group at a time."""
    room = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(room, s)
        insort(room, (room.pop(i) if i < len(room) else max(s, capacity)) - s)
    return room


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((rng.randrange(1, 30), rng.randrange(1, 400), 7)) for _ in range(2000)] + [1500]
    for capacity in (400, 1000):
        pieces, n = shards.best_fit(list(Counter(sizes).items()), capacity)
        used, got = Counter(), Counter()
        for size, shard, k in pieces:
            used[shard] += size * k
            got[size] += k
        assert got == Counter(sizes) and n == len(used)
        want = plain(sizes, capacity)
        assert n == len(want) and sorted(max(capacity, u) - u for u in used.values()) == sorted(want)
    assert shards.best_fit([(5, 10)], 10, limit=4) is None


def test_even_fit():
    rng = random.Random(1)
    classes = list(Counter(rng.randrange(16, 3000) for _ in range(5000)).items())
    used = Counter()
    for size, shard, k in shards.even_fit(classes, 40):
        used[shard] += size * k
    assert sorted(used) == list(range(40)) and max(used.values()) < 1.01 * min(used.values())
    used = Counter()
    for size, shard, k in shards.even_fit([*classes, (4_000_000, 1), (900_000, 2)], 40):
        used[shard] += size * k
    assert sorted(used) == list(range(40)) and used[0] == 4_000_000 and used[1] == used[2] == 900_000
    assert max(v for k, v in used.items() if k > 2) < 1.01 * min(v for k, v in used.items() if k > 2)
    assert shards.even_fit([], 40) == []


def test_tree_keeps_order():
    rng, tree, plain_ = random.Random(3), shards.Room(), []
    for i in range(3000):
        tree.add(x := rng.randrange(500), i)
        insort(plain_, (x, i))
        if i % 3:
            want = rng.randrange(520)
            at = bisect_left(plain_, (want, -1))
            assert tree.take(want) == (plain_.pop(at) if at < len(plain_) else None)


def check(rows, out, n_shards=None):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, of = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        of[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of.values())
    assert n_shards is None or all(0 <= s < n_shards for s in slots)


def test_rows(spark, edge, none, monkeypatch):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcdefgh") * rng.randrange(200)) for i in range(3000)] + [(None, None), (1, ""), (None, "x")] + [(9, "hot" * 20)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("h", "size", "shard", "bytes", "_cell", "n", "slot")})
    sizes = Counter()
    for _, t in rows:
        sizes[t or ""] += len((t or "").encode()) + 16
    whole = shards.sharded(df, n_shards=7).collect()
    check(rows, whole, 7)
    used = Counter()
    for r in whole:
        used[r.shard] += r.size
    big = max(sizes.values())
    assert sorted(used) == list(range(7)) and max(used.values()) <= max(big, 1.02 * sum(used.values()) / 7)
    monkeypatch.setattr(shards, "CELL", 100)
    out = shards.sharded(df, capacity=4000).collect()
    check(rows, out)
    used = Counter()
    for r in out:
        used[r.shard] += r.size
    want = plain(sizes.values(), 4000)
    assert len(used) == len(want) and sorted(max(4000, u) - u for u in used.values()) == sorted(want)
    check([(r.doc_id, r.text) for r in edge.collect()], shards.sharded(edge, n_shards=40).collect(), 40)
    assert shards.sharded(none, n_shards=3).count() == 0 and shards.sharded(none, capacity=5).count() == 0
    with pytest.raises(ValueError):
        shards.sharded(none)


def test_rounded(spark):
    got = spark.createDataFrame([(x,) for x in (1, 4095, 4096, 4097, 8191, 8192, 10**9 + 1, 2**40 - 1, 2**52)], "x long").select("x", shards.rounded(F.col("x")).alias("r")).collect()
    for r in got:
        assert r.x <= r.r <= r.x * (1 + 2**-11) and (r.x > 4096 or r.r == r.x)


def test_written(spark, tmp_path):
    rows = [(i, "t" * (i % 40) if i % 11 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards.write_shards(docs, str(tmp_path / "out"), files=2, n_shards=5)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t or "") for i, t in rows)
    for part in (tmp_path / "out").glob("shard=*"):
        slots = [spark.read.parquet(str(f)).select("slot").toPandas().slot.tolist() for f in part.glob("*.parquet")]
        assert len(slots) <= 2 and all(s == sorted(s) for s in slots) and sorted(sum(slots, [])) == list(range(sum(map(len, slots))))
