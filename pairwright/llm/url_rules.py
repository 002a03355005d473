"""Allow and block rules for urls, found by a sort-merge range join.

A key is a host with its labels reversed, then a divider, then a path; all keys that begin with a rule's key
lie in one interval, and two such intervals are nested or apart. As a rule also holds for subdomains, a url
gets one key for every host depth that some rule has: its last labels, and its path. Keys and rules are dealt
to the same ranges, a rule to all that its interval meets. In each sorted range a sweep keeps the rules
whose intervals are open on a stack; what is on the stack when a url's key comes by fits it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.tables import hashed_sample, task_count
from pairwright.staging import stage

#: Verdict where no rule fits.
DEFAULT = "allow"
#: Between reversed labels and before the path. Neither occurs in a host as `host_of` cuts it.
_LABEL, _PATH = ".", "/"
#: Follows every character in byte order of UTF-8 strings' code points.
_LAST = "\U0010ffff"
#: Ranges per task, and sampled keys per range that find their borders. Only the evenness of ranges hangs on them.
_RANGES, _SAMPLED = 4, 20
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """What follows the first `://`, up to `/`, `?` or `#`, with A-Z in lower case; empty without `://` or url."""
    cut = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(cut, F.lit("")), _CAPITALS, _SMALL)


def path_of(url: str) -> Column:
    """What follows the host, up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a DataFrame."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _borders(keys: DataFrame, ranges: int) -> list[str]:
    """Keys at which ranges end: quantiles of a sample of about `_SAMPLED * ranges` key heads, chosen by hash."""
    sample = hashed_sample(keys, _SAMPLED * ranges, "host", "path", "key").select(F.left("key", F.lit(256)).alias("key")).collect()
    heads = sorted(row["key"] for row in sample)
    return [heads[len(heads) * i // ranges] for i in range(1, ranges)] if heads else []


def _range_of(borders: list[str]):
    """A column function (key, spread, is_rule) for the ranges a row goes to.

    A key that fills several ranges is spread over them by the number `spread`; a rule goes to all ranges
    that keys beginning with its own can be in.
    """

    @F.pandas_udf("array<int>")
    def ranges(key: pd.Series, spread: pd.Series, is_rule: pd.Series) -> pd.Series:
        out = []
        for k, s, rule in zip(key, spread, is_rule):
            low = bisect_left(borders, k)
            if rule:
                out.append(list(range(low, bisect_right(borders, k + _LAST) + 1)))
            else:
                out.append([low + s % (bisect_right(borders, k) - low + 1)])
        return pd.Series(out)

    return ranges


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), _LABEL)


def _sweep(batch: pd.DataFrame) -> pd.DataFrame:
    """Matches within one range: rules (`rule` not null) and keys of urls, swept in key order."""
    batch = batch.sort_values(["key", "is_url"], kind="stable")
    open_rules: list[tuple[str, int, int, str, str]] = []
    out: list[tuple] = []
    for key, is_url, host, path, hosts, rule, verdict in batch[
        ["key", "is_url", "host", "path", "host_length", "rule", "verdict"]
    ].itertuples(index=False, name=None):
        while open_rules and not key.startswith(open_rules[-1][0]):
            open_rules.pop()
        if not is_url:
            open_rules.append((key, len(rule), int(hosts), rule, verdict))
        elif open_rules:
            # Of nested rules on one host depth the innermost is the longest; equal ones sort by verdict.
            _, length, hosts, rule, verdict = open_rules[-1]
            out.append((host, path, length, hosts, rule, verdict))
    return pd.DataFrame(out, columns=["host", "path", "length", "host_length", "rule", "verdict"])


def judge_urls(urls: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of `urls`: `page_id`, `host`, `path`, `rule` and `verdict`.

    A rule fits if its host is the url's or a parent domain of it, and the url's path starts with the rule's.
    The rule with the longest host and path wins; of equally long ones the longer host, then `block` before
    `allow`. Rows without a url, or with one that has no `://`, have an empty host and path and fit no rule; a
    rule with a null or empty host fits nothing. Equal rules count once; rows that repeat stay repeated.
    Without rules every verdict is the default and every `rule` null.
    """
    pages = urls.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    asked = (
        rules.select(
            F.translate(F.col("host"), _CAPITALS, _SMALL).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.col("verdict"),
        )
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block before allow
        .withColumn("labels", F.split("host", r"\.", -1))
        .withColumn("depth", F.size("labels"))
    )
    depths = sorted(row["depth"] for row in asked.select("depth").distinct().collect())  # host depths: at most 127 in valid names
    rule_keys = asked.select(
        F.concat(_reversed(F.col("labels")), F.lit(_LABEL + _PATH), "path").alias("key"),
        F.lit(False).alias("is_url"),
        "host",
        "path",
        F.length("host").cast("long").alias("host_length"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    # Judged once per host and path, so that a url on a third of all rows is one key.
    distinct = stage(pages.where("host <> ''").select("host", "path").distinct(), "urls")
    at_depths = (
        distinct.withColumn("labels", F.split("host", r"\.", -1))
        .withColumn("depth", F.explode(F.lit(depths).cast("array<int>")))
        .where(F.size("labels") >= F.col("depth"))
        .withColumn("labels", F.slice("labels", F.size("labels") - F.col("depth") + 1, F.col("depth")))
    )
    url_keys = at_depths.select(
        F.concat(_reversed(F.col("labels")), F.lit(_LABEL + _PATH), "path").alias("key"),
        F.lit(True).alias("is_url"),
        "host",
        "path",
        F.lit(None).cast("long").alias("host_length"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    range_of = _range_of(_borders(url_keys, _RANGES * task_count(urls)))
    spread = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30))
    dealt = url_keys.unionByName(rule_keys).withColumn("range", F.explode(range_of("key", spread, ~F.col("is_url"))))
    matches = dealt.groupBy("range").applyInPandas(
        _sweep, "host string, path string, length long, host_length long, rule string, verdict string"
    )
    best = matches.groupBy("host", "path").agg(
        F.max(F.struct("length", "host_length", "verdict", "rule")).alias("best")
    )
    return pages.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
