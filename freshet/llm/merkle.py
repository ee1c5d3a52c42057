"""Document fingerprints: Merkle trees over paragraphs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from freshet.llm.common import table

#: Sections are lines. Paragraphs of a section end after a gap that follows punctuation, a symbol, or one of a few letters:
#: places that depend on the text beside them only, so that an edit moves no other border.
SECTION = r"(?s)[^\n]*\n|[^\n]+"
PARAGRAPH = r"(?s).+?(?:[.,;:!?|*$%&#dglst][ \n]+|\z)"
#: Characters of a block in which documents meet their successors; blocks of the successor search at most.
BLOCK_CHARS, MAX_BLOCKS = 16_000_000, 4096


def leaves(text: Column) -> Column:
    """array<array<string>>: for each section the hashes of its paragraphs. All pieces joined are the text again."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)),
        lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.substring(F.md5(p), 1, 16)))


def sections(tree: Column) -> Column:
    """Hash of each section, over its paragraphs' hashes."""
    return F.transform(tree, lambda s: F.substring(F.md5(F.array_join(s, "")), 1, 16))


def fingerprint(tree: Column) -> Column:
    """Root, then the hashes of each section's paragraphs: root/leaf.leaf/leaf. The root is over the sections' hashes."""
    root = F.sha2(F.array_join(sections(tree), ""), 256)
    return F.concat_ws("/", root, F.array_join(F.transform(tree, lambda s: F.array_join(s, ".")), "/"))


def parts(print_: Column) -> Column:
    """Distinct paragraph hashes of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.substring(print_, 66, 2**31 - 1), "[./]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of two fingerprints' paragraphs that both have, 1 for equal roots: 2 * both / (one + other)."""
    same = F.substring(a, 1, 64) == F.substring(b, 1, 64)
    x, y = parts(a), parts(b)
    return F.when(same, 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def edits(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of a's tree whose hash b's tree hasn't: the branches below which the texts differ."""
    own, other = F.split(F.substring(a, 66, 2**31 - 1), "/"), F.split(F.substring(b, 66, 2**31 - 1), "/")
    at = F.transform(own, lambda s, i: F.when(F.array_contains(other, s) | (s == ""), -1).otherwise(i))
    return F.filter(at, lambda i: i >= 0)


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, text, next_text): the text of the next document by descending id; the first one's after the last.

    Equal ids are ordered by text hash, then text; null ids come last. Quantiles of the ids deal documents to ranges, in
    which a window looks one row ahead; each range also gets the rows of the first id of the range that follows. So a text moves
    once. The driver learns at most MAX_BLOCKS range borders and first ids.
    """
    d = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = d.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = min(MAX_BLOCKS, max(1, -(-total // block_chars)))
    at = [k / n for k in range(1, n)]
    borders = sorted(set((d.agg(F.percentile_approx("id", at, 10 * MAX_BLOCKS).alias("q")).first()["q"] if at else None) or []))
    # two steps over a border list of a few thousand: which stretch of 64 borders, then which of those
    stretches = [borders[i : i + 64] for i in range(0, len(borders), 64)] or [[]]

    def above(values: list[int]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v < F.col("id"))) if values else F.lit(0)

    block = above(stretches[0])
    for i, s in enumerate(stretches[1:], 1):
        block = F.when(F.col("id") > stretches[i - 1][-1], 64 * i + above(s)).otherwise(block)
    d = d.withColumn("block", F.coalesce(block, F.lit(-1)).cast("int"))
    first = {r["block"]: r["top"] for r in d.groupBy("block").agg(F.max("id").alias("top")).collect()}
    order = sorted(first, reverse=True)
    # each range is followed by the first id of the next one; the last range by that of the first
    follows = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    extra = None
    for b, f in follows.items():
        extra = (extra or []) + [(b, first[f])]
    rows = d.withColumn("after", F.lit(0))
    if extra:
        tops = d.sparkSession.createDataFrame(extra, "to int, top long")
        ids = [t for _, t in extra if t is not None]
        firsts = d.where(F.col("id").isin(ids) | (F.col("id").isNull() & F.lit(len(ids) < len(extra))))
        firsts = firsts.join(F.broadcast(tops), F.col("id").eqNullSafe(F.col("top"))).select("id", "text", F.col("to").alias("block"), F.lit(1).alias("after"))
        rows = rows.select("id", "text", "block", "after").unionByName(firsts)
    w = W.partitionBy("block").orderBy("after", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")
    return rows.withColumn("next_text", F.lead("text").over(w)).where("after = 0").select("id", "text", "next_text")


def compared(docs: DataFrame, id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Fingerprints of each text, of the text with its second half replaced by its successor's beginning, and likenesses.

    Null texts are empty. The empty text has a root and no paragraphs; likeness to an equal text is 1, else 0. Repeated
    rows are each other's successors. Other columns are left out.
    """
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    d = with_next(docs, id, text, block_chars).withColumn("n_chars", n.cast("long"))
    d = d.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half)))
    prints = {"text": "fingerprint", "edited": "edited_fingerprint", "next_text": "next_fingerprint"}
    d = d.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[leaves(F.col(c)).alias(k) for c, k in prints.items()])
    d = d.withColumns({k: fingerprint(F.col(k)) for k in prints.values()})
    return d.select(F.col("id").alias(id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), F.array_join(edits(F.col("fingerprint"), F.col("edited_fingerprint")), ",").alias("edited_sections"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(table(sf_dir, "documents", spark).select("doc_id", "text"))


def _tree(text: str) -> str:
    return (rf"list_transform(regexp_extract_all({text}, '{SECTION}'), lambda s: list_transform(list_filter(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: p <> ''), lambda p: substr(md5(p), 1, 16)))")


def _print(tree: str) -> str:
    return (f"sha256(list_aggregate(list_transform({tree}, lambda s: substr(md5(list_aggregate(s, 'string_agg', '')), 1, 16)), 'string_agg', ''))"
            f" || '/' || list_aggregate(list_transform({tree}, lambda s: list_aggregate(s, 'string_agg', '.')), 'string_agg', '/')")


def _likeness(a: str, b: str) -> str:
    x, y = (f"list_distinct(list_filter(string_split(replace(substr({p}, 66), '/', '.'), '.'), lambda x: x <> ''))" for p in (a, b))
    return f"CASE WHEN substr({a}, 1, 64) = substr({b}, 1, 64) THEN 1.0 ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END::DOUBLE"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC)) AS nx FROM d),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(nx, 1, n // 2) AS edited FROM x),
t AS (SELECT doc_id, n, edited, {_tree('text')} AS a, {_tree('edited')} AS b, {_tree('nx')} AS c FROM e),
f AS (SELECT doc_id, n, edited, coalesce({_print('a')}, sha256('') || '/') AS fa, coalesce({_print('b')}, sha256('') || '/') AS fb, coalesce({_print('c')}, sha256('') || '/') AS fc FROM t)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
  {_likeness('fa', 'fb')} AS near_edited, {_likeness('fa', 'fc')} AS near_next,
  coalesce(list_aggregate(list_filter(list_transform(string_split(substr(fa, 66), '/'), lambda s, i: CASE WHEN list_contains(string_split(substr(fb, 66), '/'), s) OR s = '' THEN -1 ELSE i - 1 END), lambda i: i >= 0), 'string_agg', ','), '') AS edited_sections
FROM f"""
