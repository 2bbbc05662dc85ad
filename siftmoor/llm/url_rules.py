"""URL filters by a sort-merge range join of pages and nested host rules.

A host is written backwards (`com.example.www.`), so a rule for a host and all its subdomains is a prefix, that is an interval
of the sorted keys.  Intervals nest or lie apart.  Pages and rules are cut into ranges of keys; a rule goes to every range its
interval touches.  In each range one sweep over the sorted keys keeps a stack of the rules that hold there.  Page keys go on
with the path and a hash, so a host with very many pages is spread over many ranges.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_PER_RANGE = 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = "\U0010ffff"


def url_host(url: str) -> Column:
    """The text after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: str) -> Column:
    """The text after the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: str) -> Column:
    """`www.example.com` as `com.example.www.`: the key of a host is a prefix of those of its subdomains."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict of the most specific rule for each page: (id, host, path, rule, verdict).

    rules: (host, path, verdict).  A rule fits its host and all subdomains if the page's path starts with the rule's.  Of those
    that fit, the longest host wins, then the longest path; of rules alike, `block`.  Rules with a null are left out.
    A page that no rule fits gets the `default` verdict and a null rule; so do null urls and urls without `://`, whose host and
    path are empty.  Every row of pages gives one row, also repeated ones and those with a null id; other columns are ignored.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hosts = pages.select(F.col(id_col).cast("string").alias("id"), url_host(url_col).alias("host"), url_path(url_col).alias("path"), F.xxhash64(id_col, url_col).alias("salt"))
    keyed = hosts.select("id", "host", "path", F.concat_ws("\0", reversed_host("host"), "path", F.hex("salt")).alias("key"))
    sample = sorted(r.key for r in keyed.orderBy(F.xxhash64("key")).limit(SAMPLE_PER_RANGE * parts).select("key").collect())
    bounds = sorted(set(sample[SAMPLE_PER_RANGE::SAMPLE_PER_RANGE]))
    id_type = pages.schema[id_col].dataType.simpleString()
    schema = "part int, key string, kind int, id string, host string, path string, verdict string"

    def place_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(part=[bisect_right(bounds, key) for key in batch["key"]], kind=1, verdict=None)

    def place_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [range(bisect_right(bounds, key), bisect_right(bounds, key + _END) + 1) for key in batch["key"]]
            yield batch.assign(part=spans, kind=0, id=None).explode("part")

    intervals = rules.where("host is not null and path is not null and verdict is not null").select(
        "host", "path", "verdict", reversed_host("host").alias("key"))
    events = keyed.mapInPandas(place_pages, schema).union(intervals.mapInPandas(place_rules, schema))
    ordered = events.repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path", "verdict")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, part = [], None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.part != part:
                    stack, part = [], row.part
                while stack and not row.key.startswith(stack[-1][0]):
                    stack.pop()
                if row.kind == 1:
                    out.append((row.host, row.path, *_longest(stack, row.path, default)))
                elif stack and stack[-1][0] == row.key:
                    stack[-1][1][row.path] = (row.host + row.path, row.verdict)
                    stack[-1][2].add(len(row.path))
                else:
                    stack.append((row.key, {row.path: (row.host + row.path, row.verdict)}, {len(row.path)}))
            found = pd.DataFrame(out, columns=["host", "path", "rule", "verdict"])
            found.insert(0, "id", batch.loc[batch["kind"] == 1, "id"].to_numpy())
            yield found

    judged = ordered.mapInPandas(sweep, "id string, host string, path string, rule string, verdict string")
    return judged.select(F.col("id").cast(id_type).alias(id_col), "host", "path", "rule", "verdict")


def _longest(stack: list, path: str, default: str) -> tuple[str | None, str]:
    """The rule for `path` of the innermost active host that has one; its longest."""
    for _, rules, lengths in reversed(stack):
        for length in sorted(lengths, reverse=True):
            if length <= len(path) and path[:length] in rules:
                return rules[path[:length]]
    return None, default
