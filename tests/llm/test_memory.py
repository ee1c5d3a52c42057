"""What Python workers hold after a task, and packed words."""

import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import bpe, jaccard
from freshet.llm.common import each_of, joint, opened, squeezed


@pytest.mark.parametrize("work", [lambda d: jaccard.joined(d)[0], lambda d: bpe.encode(d, back=True)], ids=["jaccard", "bpe"])
def test_workers_give_memory_back(spark, work):
    """After a task over 35 MB of text a worker holds about what it held after one over a few rows."""
    def held(batches):
        """MB of this worker's own memory."""
        for _ in batches:
            pass
        yield pa.record_batch({"mb": [int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024]})

    def most():
        return spark.range(0, 64, 1, 64).mapInArrow(held, "mb double").agg(F.max("mb")).first()[0]

    word = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.substring(F.md5(F.concat(F.col("id") % 900, k)), 1, 6)))
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), word.alias("text")).coalesce(1)
    work(docs.limit(8)).count()
    before = most()
    work(docs).write.format("noop").mode("overwrite").save()
    assert most() < before + 60


def test_packed_words():
    for items in ([], [b""], [b"a", b"", "漢".encode()], [b"%d" % i for i in range(25_003)]):
        lengths, raw = joint(squeezed(items))
        assert lengths.tolist() == [len(x) for x in items] and raw == b"".join(items)
        assert list(each_of(squeezed(items))) == opened(squeezed(items)) == items
