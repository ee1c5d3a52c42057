"""Language, toxicity and personal data."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.llm import language, pii, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    out = language.op2_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_language_edges(spark, edge, none):
    model = language.learned(edge)
    rows = language.identified(edge.withColumns({"score": F.lit("x"), "_found": F.lit(1)}), model).collect()
    assert len(rows) == edge.count()
    for r in rows:
        if not re.search(r"\w", (r.text or "").replace("_", "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"} and 0 <= r.score <= 1
    assert language.learned(none) is None
    assert {r.lang_pred for r in language.identified(edge, None).collect()} == {"und"}


def test_kernels_by_hand():
    texts = [b"Abc", b"abd", b"12", b""]
    x = language.presence(texts)
    grams = [{t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in (b"abc", b"abd", b"  ", b"")]
    assert [int(r.sum()) for r in x] == [len(g) for g in grams]
    m = language.Model(x[:1], np.ones((1, 1)), ["a"])
    assert m.kernels(x)[:, 0] == pytest.approx([len(g & grams[0]) / max(1, len(g) * len(grams[0])) ** 0.5 for g in grams], abs=1e-6)


def test_toxicity(spark):
    out = toxicity.op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert out[out.toxic == 0].rejected.mean() < 0.01
    assert out[out.toxic == 1].rejected.mean() > 0.9
    assert out.severity.between(0, toxicity.GRADES).all()


def test_ordinal_grades():
    m = toxicity.Ordinal({1: 2.0}, np.array([0.0, 1.0, 2.0]))
    p = m.grades(np.array([-3.0, 0.0, 3.0]))
    assert p.sum(axis=1) == pytest.approx([1, 1, 1])
    assert np.cumsum(p, axis=1)[1, 0] == pytest.approx(0.5)
    assert (np.diff(p @ np.arange(4)) > 0).all()


def test_toxicity_edges(spark, edge, none):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learned(edge, empty)
    rows = toxicity.graded(edge.withColumn("grade", F.lit("x")), model).collect()
    assert len(rows) == edge.count() and not any(r.rejected or r.grade for r in rows)
    one = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    assert toxicity.graded(edge, toxicity.learned(edge, one)).count() == edge.count()
    assert toxicity.graded(none, model).count() == 0


def plain(text):
    """The base spans as the patterns say."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@given(st.one_of(st.text("aZ09@.+-% ()\n", max_size=60), st.text("0189. -", max_size=60), st.lists(st.sampled_from(["4207051279108084", "1.2.3.4", "a@b.c", "+1 (375) 555-4393", ".", " ", "@", "-", "9"]), max_size=9).map("".join)))
@settings(max_examples=1500, deadline=None)
def test_patterns(text):
    assert pii.patterns(text) == plain(text)


def test_long_runs_are_quick():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "1.1.1" * 50_000, "a@" * 100_000, "0" * 5000 + "1.2.3.4"):
        pii.patterns(text)


def test_field_is_consistent():
    """A repeated token without a look of its own takes the label of its other occurrence, and only there."""
    unary = np.zeros((pii.N_SHAPES, pii.LABELS))
    unary[0, 0] = 1.0
    field = pii.Field(unary, np.zeros((pii.LABELS, pii.LABELS)), np.eye(pii.LABELS) * 6.0)
    text = "call +1 (375) 555-4393 now, or 555-4393 from here, not 777-1234; see 555-4393."
    (base, added), = field.spans([text])
    assert [text[a:b] for _, a, b in base] == ["+1 (375) 555-4393"]
    assert [(k, text[a:b]) for k, a, b in added] == [("phone", "555-4393"), ("phone", "555-4393")]
    assert pii.masked(text, [*base, *added]) == "call [PHONE] now, or [PHONE] from here, not 777-1234; see [PHONE]."


def test_far_repeats_are_consistent():
    """Sixty repeats, each as sure as the first, and the same in whatever batch."""
    unary = np.zeros((pii.N_SHAPES, pii.LABELS))
    unary[0, 0] = 1.0
    field = pii.Field(unary, np.eye(pii.LABELS) * 0.5, np.eye(pii.LABELS) * 6.0)
    text = "call +1 (375) 555-4393" + " or else 555-4393" * 60
    alone = field.spans([text, "see 555-4393"])
    assert [len(added) for _, added in alone] == [60, 0]
    assert field.spans(["12 34 56 78 " * 40, None, text])[2] == alone[0]


def test_messages_are_exact_on_chains():
    """Without loops, message passing gives the marginals of the enumerated distribution."""
    import itertools

    rng = np.random.default_rng(1)
    field = pii.Field(rng.normal(size=(pii.N_SHAPES, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)))
    g = pii.Graph(["12 a1 7b"])
    u = g.shapes() @ field.unary
    want = np.zeros((3, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=3):
        p = np.exp(sum(u[i, y[i]] for i in range(3)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]])
        for i in range(3):
            want[i, y[i]] += p
    assert field.marginals(g, 100) == pytest.approx(want / want.sum(axis=1, keepdims=True), abs=1e-3)


def test_pii_edges(spark, edge, none):
    field = pii.trained(edge)
    rows = pii.detected(edge.withColumns({"spans": F.lit(1), "_may": F.lit(2)}), field, mask=True).collect()
    assert len(rows) == edge.count()
    assert all((r.masked is None) == (r.text is None) for r in rows)
    assert pii.detected(none, pii.trained(none)).count() == 0
    assert not pii.trained(none).spans(["see 1234567 and 555"])[0][1]


def test_pii_query(spark):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, SF).collect():
        base = [":".join(map(str, s)) for s in plain(docs[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(filter(None, r.spans.split(",")))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in pii.KINDS)
