"""Texts without frequent lines."""

from collections import Counter

from freshet.llm import lines


def test_texts_without_lines(spark):
    docs = [(i, f"word{chr(97 + i)} own\n  Page {i % 10}  of 9\n\nlast {chr(97 + i)}\nPAGE 7 of 9", "a") for i in range(12)]
    docs += [(20, "Page 1 of 9\nother", "b"), (21, None, "a"), (None, "page 3 of 9", "a"), (22, "", None), (0, docs[0][1], "a")]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string")
    want = Counter((i, t if i in (20, 21, 22) else "" if i is None else f"word{chr(97 + i)} own\n\nlast {chr(97 + i)}", h) for i, t, h in docs)
    out = lines.without_lines(df)
    assert Counter(map(tuple, out.collect())) == want
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_left_words_match_the_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    left = {r.doc_id: len((r.text or "").split()) for r in lines.without_lines(docs).collect()}
    rows = lines.quality(docs).collect()
    assert {r.doc_id: r.n_words - r.removed_words for r in rows} == left
