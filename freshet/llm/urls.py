"""URL filters: suffix rules on hosts, then a blocked Bloom filter with an exact join behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import table

#: Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words of abuse. A page that holds one of them in its content is listed by the query.
TERMS = ["idiot", "moron", "scum", "stupid", "worthless", "disgusting", "pathetic", "loser", "trash", "clown"]
LANES = 8


def _lower(c: Column) -> Column:
    """A-Z only, unlike lower(), which follows Unicode."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end; empty without one or for null."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www., path without end slashes, query without campaign and empty fields; neither scheme nor fragment.

    The ? stands only before a field that is left, so a URL without a query, with an empty one and with campaign fields alone are equal.
    """
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    fields = F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(r"^(utm_[a-z]+|ref)="))
    kept = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""), kept)


def ruled(df: DataFrame, url: str, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add host, path, rule and rule_verdict of the longest rule (host and path together) that fits; null where none does."""
    best_rule, best_verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    at, below = host(F.col(url)), path(F.col(url))
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = F.concat(F.lit("."), at).endswith("." + h) & below.startswith(p)
        best_rule, best_verdict = F.when(fits, h + p).otherwise(best_rule), F.when(fits, verdict).otherwise(best_verdict)
    return df.withColumns({"host": at, "path": below, "rule": best_rule, "rule_verdict": best_verdict})


def _masks(key: Column) -> list[Column]:
    """One bit of 64 in each lane, from six bits of the key's hash each."""
    h = F.xxhash64(key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(LANES)]


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n)).cast("long")


def bloom(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """Blocked Bloom filter: (block, lane0 .. lane7), 512 bits a block; a key sets one bit in each lane of its block."""
    marked = listed.select(_block(F.col(key), n_blocks).alias("block"), *[m.alias(f"lane{i}") for i, m in enumerate(_masks(F.col(key)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def listed_urls(pages: DataFrame, listed: DataFrame, url: str = "url", id: str = "page_id", keys_a_block: int = 32) -> DataFrame:
    """(id, url, maybe, on_list) of every row of pages; listed: a column `canonical`, repeats allowed.

    maybe: the filter holds the page's canonical URL; on_list: the exact join confirms it. No listed URL is missed, and a
    false hit of the filter ends in the exact join. The number of blocks follows the list's length, so the filter stays
    sparse at any size; filter and list are joined on their keys and never collected. Only possible hits meet the list: the
    others carry a key of their own, so that they spread over all tasks. Null URLs and URLs without :// have an empty
    canonical form and are never on the list. Rows are neither merged nor dropped.
    """
    listed = listed.where("canonical != ''").select("canonical").distinct()
    n_blocks = max(1, -(-listed.count() // keys_a_block))
    page = pages.select(F.col(id).alias("id"), F.col(url).alias("url")).withColumn("canonical", F.coalesce(canonical(F.col("url")), F.lit("")))
    page = page.withColumn("block", _block(F.col("canonical"), n_blocks)).join(bloom(listed, "canonical", n_blocks), "block", "left")
    held = F.lit(True)
    for i, m in enumerate(_masks(F.col("canonical"))):
        held &= F.coalesce(F.col(f"lane{i}").bitwiseAND(m) != 0, F.lit(False))
    page = page.withColumn("maybe", held & (F.col("canonical") != ""))
    page = page.withColumn("exact", F.when(F.col("maybe"), F.col("canonical")).otherwise(F.concat(F.lit(" "), F.xxhash64("id", "url").cast("string"))))
    page = page.join(listed.select(F.col("canonical").alias("exact"), F.lit(True).alias("found")), "exact", "left")
    return page.select("id", "url", "maybe", F.coalesce("found", F.lit(False)).alias("on_list"))


def abusive(pages: DataFrame, url: str = "url", html: str = "html", terms: list[str] = TERMS) -> DataFrame:
    """A list of `canonical` URLs: those of all pages that hold a term as a word, in any case. The URL itself has no say.

    Null pages hold none. Every address of a listed page is on the list, whatever its scheme, fragment or campaign fields.
    """
    return pages.where(F.col(html).rlike(r"(?i)\b(" + "|".join(terms) + r")\b")).select(canonical(F.col(url)).alias("canonical"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page: the rule's verdict, else block if the URL is on the list of abusive pages."""
    pages = table(sf_dir, "pages", spark)
    out = ruled(listed_urls(pages, abusive(pages)), "url")
    verdict = F.coalesce("rule_verdict", F.when(F.col("on_list"), "block").otherwise("allow"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", verdict.alias("verdict"), "on_list")


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_FIELDS = r"list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'), lambda f: f <> '' AND NOT regexp_matches(f, '^(utm_[a-z]+|ref)='))"
SQL = rf"""
WITH p AS (SELECT page_id, url, html, {_HOST} AS host, {_PATH} AS path, {_FIELDS} AS fields FROM pages),
c AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
          || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches(html, '(?i)\b({"|".join(TERMS)})\b') AND canonical <> ''),
r AS (SELECT c.*, l.canonical IS NOT NULL AS on_list,
        CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
             WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
             WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
             WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
      FROM c LEFT JOIN l USING (canonical))
SELECT page_id, host, path, rule, on_list,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN on_list THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
