"""URL filters: expanded expressions, an equi-join on short hash prefixes, confirmed by full digests.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose path starts
with the rule's. Every URL becomes host-suffix and path-prefix expressions, only of the shapes that rules have. The
expressions meet the rules on the first 32 bits of a SHA-256, the full digest confirms, and the longest rule wins.

Nulls: a null URL, or one without ``://``, has an empty host and path; rules with a null or empty host, a null path
or a null verdict are ignored. Ties between rules of one length go to the longer host, then to ``block``. Repeated
rows are judged once and returned as often as they came. Every other column of the input is kept; an input column
called like a result column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import lower_ascii

#: Hex digits of the join key.
PREFIX_DIGITS = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return lower_ascii(host), path


def rule_table(rules: DataFrame) -> DataFrame:
    """One row per expression: digest, its prefix, the rule's text and what decides between rules."""
    text = F.concat("rule_host", "path")
    return (
        rules.select(lower_ascii(F.col("host")).alias("rule_host"), "path", "verdict")
        .where("rule_host != '' and path is not null and verdict is not null")
        .groupBy("rule_host", "path")
        .agg(F.max("verdict").alias("rule_verdict"))  # 'block' sorts after 'allow'
        .select(
            F.sha2(text, 256).alias("rule_digest"),
            F.sha2(text, 256).substr(1, PREFIX_DIGITS).alias("prefix"),
            text.alias("rule"),
            "rule_verdict",
            F.length(text).alias("rule_length"),
            F.length("rule_host").alias("rule_host_length"),
            F.size(F.split("rule_host", r"\.")).alias("rule_labels"),
            F.length("path").alias("rule_path_length"),
        )
    )


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """Host suffixes of ``labels`` labels times path prefixes of ``lengths`` characters."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")),
        lambda n: F.substr(F.col("path"), F.lit(1), n),
    )
    return (
        urls.where("host != ''")
        .select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(prefixes).alias("start"))
        .select("host", "path", F.sha2(F.concat("suffix", "start"), 256).alias("digest"))
        .withColumn("prefix", F.col("digest").substr(1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    The shapes fetched to the driver are the distinct label counts and path lengths of the rules, so their number is
    bounded by the longest rule and not by the number of rules.
    """
    prepared = rule_table(rules)
    shapes = prepared.agg(F.collect_set("rule_labels"), F.collect_set("rule_path_length")).first()
    host, path = split_url(F.col(url))
    taken = {"host", "path", "rule", "verdict"}
    rows = pages.select(
        F.struct(*[c for c in pages.columns if c.lower() not in taken]).alias("row"), host.alias("host"), path.alias("path")
    )
    if not shapes[0]:
        return rows.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    distinct = rows.select("host", "path").distinct()
    found = (
        expressions(distinct, sorted(shapes[0]), sorted(shapes[1]))
        .join(prepared, "prefix")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(
            F.max_by(
                F.struct("rule", "rule_verdict"), F.struct("rule_length", "rule_host_length", "rule_verdict", "rule")
            ).alias("best")
        )
    )
    return rows.join(found, ["host", "path"], "left").select(
        "row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
