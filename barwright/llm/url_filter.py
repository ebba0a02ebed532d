"""URL allow and block lists in a trie over reversed host labels and path segments.

The trie is broadcast while the rule list is within ``MAX_BROADCAST_RULES``; beyond it the same
longest-match rule is found by an equi-join on every (host suffix, path prefix) a URL offers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm.common import LOWER, UPPER

#: Rules that the broadcast trie may hold (about 100 bytes each in memory).
MAX_BROADCAST_RULES = 200_000

Rule = tuple[str, str, str]  # verdict, host, path


class UrlTrie:
    """Longest-match lookup: deepest host first, then the longest path prefix under it."""

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(("host", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            node.setdefault("tails", {})[last] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._path(node, path) or best
        return best or (None, None)

    @staticmethod
    def _path(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            fits = [t for t in node.get("tails", ()) if segment.startswith(t)]
            if fits:
                best = node["tails"][max(fits, key=len)]
            node = node.get(("path", segment))
            if node is None:
                break
        return best


def split_url(url: str) -> tuple[F.Column, F.Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL column; empty where there is none."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(text, shape, 1), UPPER, LOWER), F.regexp_extract(text, shape, 2)


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added (columns of these names are replaced).

    A rule ``(verdict, host, path)`` fits its host and every subdomain when the path starts with the
    rule's; the one with most host labels wins, then the longest path. Without a fitting rule,
    ``rule`` is null and ``verdict`` is ``default``. Null or malformed URLs have an empty host and
    path. Repeated rules: the last one given counts. Rows are neither dropped nor merged.
    """
    host, path = split_url(url_col)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # the given columns travel in one struct, so that no name of theirs can clash
    parts = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), host.alias("host"), path.alias("path"))
    if len(rules) > max_broadcast:
        return _judge_by_join(parts, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([trie.value.find(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], dtype=object)

    found = parts.withColumn("_found", look("host", "path"))
    return found.select("_row.*", "host", "path", F.col("_found.rule").alias("rule"), F.coalesce("_found.verdict", F.lit(default)).alias("verdict"))


def _judge_by_join(parts: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts by equi-join, for rule lists too large to broadcast.

    Only distinct (host, path) pairs are expanded, into host suffixes and those path prefixes whose
    length some rule of that host has, so the expansion does not depend on the number of pages.
    """
    spark: SparkSession = parts.sparkSession
    table = spark.createDataFrame([(v, h.lower(), p, i) for i, (v, h, p) in enumerate(rules)], "_v string, _h string, _p string, _i long")
    table = table.groupBy("_h", "_p").agg(F.max_by("_v", "_i").alias("_v"))
    lengths = table.groupBy("_h").agg(F.sort_array(F.collect_set(F.length("_p"))).alias("_lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.struct(F.array_join(F.slice("_labels", -i, i), ".").alias("h"), i.alias("n")))
    best = (
        parts.select("host", "path").distinct().withColumn("_labels", labels)
        .select("host", "path", F.explode(suffixes).alias("_s")).select("host", "path", F.col("_s.h").alias("_h"), F.col("_s.n").alias("_n"))
        .join(lengths, "_h")
        .select("host", "path", "_h", "_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_len"))
        .withColumn("_p", F.expr("substring(path, 1, _len)"))
        .join(table, ["_h", "_p"])
        .groupBy("host", "path").agg(F.max(F.struct("_n", "_len", F.concat("_h", "_p").alias("rule"), F.col("_v").alias("verdict"))).alias("_best"))
    )
    return parts.join(best, ["host", "path"], "left").select("_row.*", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
