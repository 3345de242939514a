"""Allow and block rules for urls, kept in a trie over reversed host labels and path segments.

A rule names a host, which stands for itself and its subdomains, and the beginning of a
path.  Of the rules that fit a url the longest wins (host and path together); urls that
no rule fits get the default verdict.

Defined cases: a null url, or one without ``://``, has an empty host and path; only a rule
with an empty host could fit it.  Of rules of equal length the one with the longer host
wins; of rules with one host and path the one whose verdict is last in order (block before
allow), whatever their order and number.  Null and repeated page_ids are carried row by
row; urls of any length are read whole; empty tables give no rows; other columns of the
input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.storage import attach

#: Rules beyond this count are joined instead of sent to every executor.
MAX_TRIE_RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class UrlTrie:
    """Nodes are dicts: labels from the last to the first, then path segments under ``/``.

    The last, perhaps partial, segment of a rule's path is looked up by its prefixes, of the
    lengths that the node's rules have.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault(label, {})
            *whole, tail = rule.path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(("seg", segment), {})
            by_size = node.setdefault("rules", {}).setdefault(len(tail), {})
            by_size[tail] = max(rule, by_size.get(tail, rule), key=lambda r: r.verdict)

    def on_host(self, host: str) -> list[dict]:
        """Where the paths of the rules for a host start, the longest suffix of the host first."""
        found, node = [], self.root
        for label in [None, *reversed(host.split("."))] if host else [None]:
            node = node if label is None else node.get(label)
            if node is None:
                break
            if "/" in node:
                found.append(node["/"])
        return found[::-1]

    @staticmethod
    def on_path(node: dict, segments: list[str]) -> Rule | None:
        """The longest rule below a host whose path begins the segments."""
        best = None
        for k, segment in enumerate(segments):
            for size, tails in node.get("rules", {}).items():
                rule = tails.get(segment[:size]) if size <= len(segment) else None
                if rule and (best is None or len(rule.path) > len(best.path)):
                    best = rule
            node = node.get(("seg", segment)) if k < len(segments) - 1 else None
            if node is None:
                break
        return best

    def find(self, places: list[dict], path: str) -> Rule | None:
        """The winner among the rules at ``places`` (of ``on_host``)."""
        segments = path.split("/")
        return max(filter(None, (self.on_path(node, segments) for node in places)), key=lambda r: len(r.text), default=None)


def url_parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column, both empty where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"\A([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Map-only: the trie is sent to the executors when the rules number MAX_TRIE_RULES at
    most (a size checked here); more rules go through ``judge_urls_by_join``.
    """
    if len(rules) > MAX_TRIE_RULES:
        return judge_urls_by_join(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"), default)
    spark = attach(pages.sparkSession)
    trie = spark.sparkContext.broadcast(UrlTrie(rules))

    def run(batches):
        rules = trie.value
        for batch in batches:
            hosts = batch.column("host").dictionary_encode()
            places = [rules.on_host(h) for h in hosts.dictionary.to_pylist()]
            found = [rules.find(places[h], p) if places[h] else None for h, p in zip(hosts.indices.to_pylist(), batch.column("path").to_pylist())]
            rule = pa.array([r and r.text for r in found], pa.string())
            verdict = pa.array([r.verdict if r else default for r in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for rule tables of any size: urls meet the rules of each of their host suffixes."""
    host, path = url_parts(F.col("url").cast("string"))
    parts = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.array_append(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.lit(""))
    places = parts.select("row", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    table = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    fits = places.join(table, "suffix").where(F.startswith("path", "rule_path"))
    text = F.concat("suffix", "rule_path")
    best = fits.groupBy("row").agg(F.max(F.struct(F.length(text).alias("n"), F.length("suffix").alias("host"), text.alias("rule"), "verdict")).alias("best"))
    return parts.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
