r"""URL filter by host-suffix and path-prefix rules.

Every URL is expanded into the expressions under which a rule could name it: the last labels of
its host joined with the first characters of its path, for the label counts and path lengths that
rules have. Expressions meet rules in an equi-join on the first 4 bytes of their SHA-256; full
digests confirm a meeting and the longest rule decides.

The expansion runs over distinct (host, path) pairs, so a page that is linked a million times is
matched once, and the verdict returns to the pages in one equi-join that AQE can split. Nothing is
broadcast by hint; only the distinct label counts and path lengths of the rules reach the driver
(at most as many as the longest rule has characters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.registry import query
from veriscope.llm.shared import LOWER, UPPER, lower_ascii, same, table

PREFIX_HEX = 8
#: Stands between host and path in an expression; neither holds it, so no other pair gives the same text.
BETWEEN = "?"
OUT = ("host", "path", "rule", "verdict")


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def _expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    labels = F.split(host, r"\.")
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs])
    suffixes = F.transform(
        F.filter(numbers(label_counts), lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(numbers(path_lengths), lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n)
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(BETWEEN), p))))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict of every row.

    `rules` has host, path and verdict (`allow`, `block`). A rule fits its host and all subdomains
    if the path of the URL starts with its path, character by character. The longest rule (host and
    path together) wins, then the one with the longer host, then block. Without a rule the verdict
    is `default`.

    Null URLs and URLs without `://` have empty host and path and fit no rule. Rules with a null or
    empty host, a null path or a null verdict are left out. Repeated rows are judged row by row;
    columns of `pages` that are named like an output are replaced by it.
    """
    named = rules.select(
        lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).filter((F.length("r_host") > 0) & F.col("r_path").isNotNull() & F.col("r_verdict").isNotNull())
    shape = named.agg(
        F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths"),
    ).first()
    judged = pages.withColumns({"__host": url_host(F.col(url)), "__path": url_path(F.col(url))})
    keep = [c for c in pages.columns if c not in OUT]
    if not shape.labels:
        return judged.select(
            *keep, F.col("__host").alias("host"), F.col("__path").alias("path"),
            F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        )
    expressions = (
        judged.select(F.col("__host").alias("__u_host"), F.col("__path").alias("__u_path"))
        .distinct()
        .select(
            "__u_host", "__u_path",
            F.explode(_expressions(F.col("__u_host"), F.col("__u_path"), shape.labels, shape.lengths)).alias("expression"),
        )
        .select("__u_host", "__u_path", F.sha2("expression", 256).alias("u_digest"))
        .withColumn("prefix", F.substring("u_digest", 1, PREFIX_HEX))
    )
    hashed = named.withColumn("r_digest", F.sha2(F.concat("r_host", F.lit(BETWEEN), "r_path"), 256)).withColumn(
        "prefix", F.substring("r_digest", 1, PREFIX_HEX)
    )
    best = (
        expressions.join(hashed, "prefix")
        .filter(F.col("u_digest") == F.col("r_digest"))
        .groupBy("__u_host", "__u_path")
        .agg(
            F.max_by(
                F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"),
                F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block")),
            ).alias("__best")
        )
    )
    return judged.join(best, (F.col("__host") == F.col("__u_host")) & (F.col("__path") == F.col("__u_path")), "left").select(
        *keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"),
        F.coalesce("__best.r_verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_VALUES = ", ".join(str(r) for r in RULES)
_FITS = "(p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)"


@query("op2_url_filter", rf"""
WITH rules(host, path, verdict) AS (VALUES {_VALUES}),
cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
  (SELECT r.host || r.path FROM rules r WHERE {_FITS} ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.verdict FROM rules r WHERE {_FITS} ORDER BY length(r.host || r.path) DESC LIMIT 1), 'allow') AS verdict
FROM p""")
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules).select("page_id", *OUT)
