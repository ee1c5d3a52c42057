import pytest

#: doc_id, text, lang, source, n_chars: nulls in any column, empty, blank and very long texts, repeated rows and ids, copies.
LONG = "word " * 40_000 + "x" * 100_000
EDGE = [
    (1, "Hello world, this is a first small text of some words.\nAnd a second line.", "en", "a", 70),
    (1, "Hello world, this is a first small text of some words.\nAnd a second line.", "en", "a", 70),
    (1, "another text under the same id", "en", "a", 30),
    (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \t\n ", "de", None, 4), (None, "a text without an id", None, None, 20),
    (None, None, None, None, None), (5, LONG, "en", "a", len(LONG)), (6, LONG + " end", "en", "a", len(LONG) + 4),
    (7, "ünïcödé ñandú 漢字 \U0001f600 don't  stop\u00a0here 123 4567", "es", "b", 40), (8, "one", "fr", "b", 3), (9, "one", "fr", "c", 3),
    (10, "a b c d e f g a b c d e f g", "en", "c", 27), (-3, "<|endoftext|> x<|endoftext|>\r\n\r\n  y", "en", "c", 20),
]
VECTORS = "vec_id long, embedding array<float>, label int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory, edge):
    """A folder of tables: documents (ids once each, for orders by id), labels, pages."""
    import pyarrow.parquet as pq

    top = tmp_path_factory.mktemp("edge")
    pq.write_table(edge.dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow(), top / "documents.parquet")
    pages = [(1, None, ""), (None, "http://www.cheap-pills.example.com/en/a/?utm_x=1&b=2#c", None), (3, "no scheme", "scum"), (4, "HTTPS://A.Example.NET/en/x", ""),
             (5, "x://net", ""), (6, "x://example.com/de/", ""), (7, "x://a.org/fr/?://b", ""), (8, "https://cheap-pills.example.com/en/a?b=2", "what a LOSER"), (9, "", ""),
             (10, "a://notexample.net/en/", ""), (10, "a://notexample.net/en/", "")]
    pq.write_table(spark.createDataFrame(pages, "page_id long, url string, html string").toArrow(), top / "pages.parquet")
    pq.write_table(spark.createDataFrame([], "doc_id long, quality int, toxic int").toArrow(), top / "labels.parquet")
    vectors = [(i, [i % 3 / 2, 1.0, i % 5 / 4], i % 2) for i in range(0, 110, 2)] + [(100, None, 1), (150, [1.0, None, 1.0], 0), (None, [1.0, 1.0], 1), (200, [1.0], None)]
    pq.write_table(spark.createDataFrame(vectors, VECTORS).toArrow(), top / "embeddings.parquet")
    return str(top)


@pytest.fixture(scope="session")
def none_dir(spark, tmp_path_factory, none):
    import pyarrow.parquet as pq

    top = tmp_path_factory.mktemp("none")
    pq.write_table(none.toArrow(), top / "documents.parquet")
    pq.write_table(spark.createDataFrame([], "page_id long, url string, html string").toArrow(), top / "pages.parquet")
    pq.write_table(spark.createDataFrame([], "doc_id long, quality int, toxic int").toArrow(), top / "labels.parquet")
    pq.write_table(spark.createDataFrame([], VECTORS).toArrow(), top / "embeddings.parquet")
    return str(top)
