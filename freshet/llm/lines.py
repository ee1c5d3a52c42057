"""Quality rules: counts within a text, and the frequency of lines across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import table, unused, words

WINDOW = 5
#: A line goes if more than MIN_DOCS distinct documents of its host have it, however many the host has.
MIN_DOCS = 10
#: A document is depleted if less than MIN_LEFT of its words, or fewer than MIN_WORDS words, are left.
MIN_LEFT, MIN_WORDS = 0.3, 10


def repeated_words(tokens: str) -> Column:
    """Number of words inside windows of five words that a text has twice or more, the first included.

    Windows are compared by 64-bit hashes. A text without equal windows, the usual case, is settled by one hash set; else windows
    are sorted by hash, and the lengths that the repeated ones cover are summed in text order.
    """
    hashes = (f"transform(sequence(1, size({tokens}) - {WINDOW - 1}), i -> xxhash64(" + ", ".join(f"{tokens}[i{k - 1:+d}]" for k in range(WINDOW)) + "))")
    return F.expr(f"""
        CASE WHEN size({tokens}) < {WINDOW + 1} THEN 0L ELSE
        element_at(transform(array({hashes}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
          element_at(transform(array(array_sort(transform(h, (x, i) -> struct(x, i)))), s ->
            element_at(transform(array(array_sort(transform(filter(transform(s, (y, j) -> CASE WHEN (j > 0 AND s[greatest(j - 1, 0)].x = y.x)
                OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].x = y.x) THEN y.i ELSE -1 END), p -> p >= 0), p -> p))), at ->
              aggregate(transform(at, (p, k) -> CASE WHEN k = size(at) - 1 THEN {WINDOW} ELSE least({WINDOW}, at[least(k + 1, size(at) - 1)] - p) END),
                0L, (a, b) -> a + b)), 1)), 1) END), 1) END""")


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = [c for c in docs.columns if c not in ("_tokens", "_lines")]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(*own, words(F.col(text)).alias("_tokens"), lines.alias("_lines"))
    counts = {
        "n_words": F.size("_tokens").cast("long"),
        "word_chars": F.length(F.array_join("_tokens", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words("_tokens"),
    }
    out = out.withColumns(counts).drop("_tokens", "_lines")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, one space for each gap, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(line), "123456789", "000000000"), r"[\x20\x09-\x0D]+", " "))


def document(text: str, host: str) -> Column:
    """What tells documents with one id apart."""
    return F.xxhash64(F.col(host), F.col(text))


def line_hits(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """Each distinct document (id, doc: hash of host and text) with each of its lines above the limit: line, words, times.

    Lines with a word are normalised and hashed with their host to 64 bits; each distinct line of a document counts once for its host, so
    documents are rows with different id, host or text, and repeated rows are one document. The counts are aggregated before they move.
    Only lines above the limit are joined back; a very frequent line is a skewed key of that join, which adaptive execution
    splits. The sums of repeated rows are divided by how often the row is there.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = F.transform(lines, lambda x: F.struct(F.xxhash64(F.col(host), normal_line(x)).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    own = docs.select(F.col(id).alias("id"), document(text, host).alias("doc"),
                      F.explode(lines).alias("l"))
    own = own.groupBy("id", "doc", "l.line").agg(F.sum("l.words").alias("words"), F.count("*").alias("times"))
    # every line has a word; asking for both sums lets this and the join share one shuffle of the lines
    often = own.groupBy("line").agg(F.count("*").alias("n_docs"), F.sum("words").alias("w"), F.sum("times").alias("t"))
    often = often.where((F.col("n_docs") > min_docs) & (F.col("w") > 0) & (F.col("t") > 0)).select("line")
    again = docs.groupBy(F.col(id).alias("again_id"), document(text, host).alias("again_doc")).agg(F.count("*").alias("rows")).where("rows > 1")
    hits = own.join(often, "line").join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("doc") == F.col("again_doc")), "left")
    return hits.select("id", "doc", "line", *[(F.col(c) / F.coalesce("rows", F.lit(1))).cast("long").alias(c) for c in ("words", "times")])


def frequent_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, doc, removed_words, removed_lines) of each distinct document that has a line above the limit."""
    hit = line_hits(docs, id, text, host, min_docs)
    return hit.groupBy("id", "doc").agg(F.sum("words").alias("removed_words"), F.sum("times").alias("removed_lines"))


def without_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of docs, the text without its lines above the limit. Lines without a word stay; null texts stay null."""
    key, at, lost = unused(docs, "id", "doc", "gone")
    gone = line_hits(docs, id, text, host, min_docs).groupBy("id", "doc").agg(F.collect_list("line").alias(lost))
    gone = gone.select(F.col("id").alias(key), F.col("doc").alias(at), lost)
    out = docs.join(gone, F.col(id).eqNullSafe(F.col(key)) & (document(text, host) == F.col(at)), "left")
    left = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains(lost, F.xxhash64(F.col(host), normal_line(x))))
    return out.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).select(*docs.columns)


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT,
            min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each row of docs: id, the base counts, removed_words, removed_lines, base_failed, kept.

    kept: the base rules hold and the document isn't depleted by the removal of frequent lines. Null and empty texts have no
    words and fail the base rules. Null hosts are one host. Repeated rows are one document and each gets its result.
    """
    base = base_rules(docs.select(F.col(id).alias("id"), document(text, host).alias("doc"), F.col(text).alias("text"))).drop("text")
    gone = frequent_lines(docs, id, text, host, min_docs).select(F.col("id").alias("gid"), F.col("doc").alias("gd"), "removed_words", "removed_lines")
    out = base.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("doc") == F.col("gd")), "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("removed_words", "removed_lines")})
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & ((F.col("removed_words") == 0) | ((left >= min_words) & (left >= min_left * F.col("n_words"))))
    return out.withColumn("kept", kept).drop("gid", "gd", "doc").withColumnRenamed("id", id)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; the host is the source."""
    return quality(table(sf_dir, "documents", spark).select("doc_id", "text", "source"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT *, len(w) AS n_words, row_number() OVER () AS k FROM d),
win AS (SELECT k, i, w[i:i+4] AS g FROM (SELECT k, w, unnest(range(1, n_words::INT - 3)) AS i FROM k WHERE n_words >= 5)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY k),
ln AS (SELECT k, doc_id, text, source, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT k, doc_id, text, source, unnest(string_split(text, chr(10))) AS l FROM k)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM ln GROUP BY k),
norm AS (SELECT k, doc_id, text, source, trim(regexp_replace(translate(lower(l), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS l, n FROM ln),
often AS (SELECT source, l FROM norm GROUP BY source, l HAVING count(DISTINCT {{'id': doc_id, 'text': text}}) > {MIN_DOCS}),
gone AS (SELECT k, sum(n) AS removed_words, count(*) AS removed_lines FROM norm n JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.l = o.l GROUP BY k),
o AS (SELECT doc_id, n_words::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words, coalesce(removed_lines, 0)::BIGINT AS removed_lines
      FROM k LEFT JOIN rep USING (k) LEFT JOIN dup USING (k) LEFT JOIN gone USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM o)
SELECT *, NOT base_failed AND (removed_words = 0 OR (n_words - removed_words >= {MIN_WORDS} AND n_words - removed_words >= {MIN_LEFT} * n_words)) AS kept FROM b"""
