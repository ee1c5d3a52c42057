"""The pipeline, stage by stage, against its operators' plain versions."""

from collections import Counter

from test_sets import plain_links

import corpus_pipeline as p
from freshet.llm import bpe, mixing, pii, toxicity
from freshet.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark, edge_dir):
    for at in (SF, edge_dir):
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns, steps = docs.columns, [docs]
        for name, stage in p.STAGES:
            steps.append(saved(stage(spark, steps[-1], at)))
            assert steps[-1].columns == columns or name == p.STAGES[-1][0]
        docs, calm, single, masked, mixed, tokens = steps
        graded = toxicity.graded(docs, toxicity.learned(docs, spark.read.parquet(f"{at}/labels.parquet")))
        assert sorted(map(str, calm.collect())) == sorted(map(str, graded.where("not rejected").select(*columns).collect()))
        rows = [(r.doc_id, r.text) for r in calm.orderBy("doc_id").collect()]
        _, classes = plain_links(rows)
        assert Counter(str(r.doc_id) for r in single.collect()) == Counter(str(rows[i][0]) for i in set(classes))
        before = {r.doc_id: r for r in single.collect()}
        field = pii.trained(single)
        for r in masked.collect():
            (base, added), = field.spans([before[r.doc_id].text])
            assert r.text == (before[r.doc_id].text and pii.masked(before[r.doc_id].text, [*base, *added]))
            assert r.n_chars == (None if r.text is None else len(r.text))
        copies = Counter({r.doc_id: r.copies for r in mixing.mix(masked).collect() if r.copies})
        assert Counter(r.doc_id for r in mixed.collect()) == copies
        t = bpe._tokenizer(bpe.vocabulary())
        assert Counter((r.doc_id, tuple(r.ids)) for r in tokens.collect()) == Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids)) for r in mixed.collect())
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, p.run(spark, SF).collect()))


def test_empty(spark, none_dir):
    assert p.run(spark, none_dir).count() == 0
