"""URL filters: a trie over reversed host labels and path segments.

Nulls and urls without "://" have an empty host and path and fit no rule; so does a path that does not begin with the
rule's. A url that fits no rule gets the default verdict (allow). Of two rules of one length the blocking one wins.
Repeated rows stay; columns beyond page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Rules that one broadcast trie may hold; larger sets are joined instead.
TRIE_RULES = 200_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


class Node:
    __slots__ = ("next", "tails", "paths")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.tails: dict[str, tuple] = {}
        self.paths: Node | None = None


class Trie:
    """Host labels from the last to the first lead to a trie of whole path segments; what a rule has after its last slash is a tail there."""

    def __init__(self, rules):
        self.root = Node()
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.next.setdefault(label, Node())
            node.paths = node = node.paths or Node()
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.next.setdefault(segment, Node())
            rank = (len(host) + len(path), verdict == "block", host + path, verdict)
            node.tails[tail] = max(rank, node.tails.get(tail, rank))

    def match(self, host: str, path: str) -> tuple | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            inner = node.paths
            for segment in segments if inner else ():
                for tail, rank in ((segment[:k], inner.tails.get(segment[:k])) for k in range(len(segment) + 1)) if inner.tails else ():
                    best = max(best, rank) if best and rank else best or rank
                inner = inner.next.get(segment)
                if inner is None:
                    break
        return best


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules=RULES, default: str = "allow", trie_rules: int = TRIE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row. rules: a list, or a DataFrame (host, path, verdict) of any size."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        if rules.limit(trie_rules + 1).count() > trie_rules:
            return _joined(parsed, rules, default)
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            match = trie.value.match
            found = [match(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x and x[2] for x in found], pa.string()), pa.array([x[3] if x else default for x in found], pa.string())], [*batch.schema.names, "rule", "verdict"])

    return mapped(parsed, run, "page_id long, host string, path string, rule string, verdict string")


def _joined(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for rule sets beyond the bound: hosts, once each, meet the rules of their suffixes; paths follow."""
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    places = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = places.select("host", "path", F.explode(suffix).alias("r_host")).join(rules, "r_host").where(F.startswith("path", "r_path")).groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
