"""URL filters: a sort-merge range join between URLs and (host, path) rules.

A URL's canonical key is its host with the labels reversed (``www.example.org`` becomes
``org.example.www.``). A rule's host, reversed likewise, is a prefix of the key of its host and
of every subdomain, so that it covers the interval of keys from the prefix up to the prefix with
its last byte raised by one. Intervals of prefixes nest or are disjoint. Both sides are sorted by
key; one sweep merges them and keeps a stack of the rules whose intervals are open. A rule on the
stack fits if the URL's path starts with its path; the longest fitting rule wins.

URLs are range-partitioned by (key, path, id), so a host with a third of all rows is dealt over
many tasks. Rules come in blocks of ``block_bytes`` at most; each block takes one sort and sweep of
its own (one block holds tens of thousands of rules), and the
longest winner over all blocks holds.

Defined results: a null URL or one without ``://`` has an empty host and path and takes the
default verdict; an empty rule table gives the default everywhere; repeated rules count once
(``block`` before ``allow`` if two rules of one text disagree); repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_key(host: str) -> str:
    return ".".join(reversed(host.lower().split("."))) + "."


class Sweep:
    """The sorted rules of one block, merged with keys that come in ascending order."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        nodes: dict[str, dict[str, tuple[str, str]]] = {}
        for host, path, verdict in sorted(set(rules), key=lambda r: (r[0], r[1], r[2] == "block")):
            nodes.setdefault(rule_key(host), {})[path] = (host + path, verdict)
        self.starts = sorted(nodes)
        #: By node: its rules by path, and the lengths of these paths, longest first.
        self.rules = [(nodes[k], sorted({len(p) for p in nodes[k]}, reverse=True)) for k in self.starts]
        self.stack: list[int] = []
        self.next = 0

    def longest(self, key: str, path: str) -> tuple[str, str] | None:
        starts, stack = self.starts, self.stack
        while stack and not key.startswith(starts[stack[-1]]):
            stack.pop()
        while self.next < len(starts) and starts[self.next] <= key:
            at = starts[self.next]
            while stack and not at.startswith(starts[stack[-1]]):
                stack.pop()
            if key.startswith(at):
                stack.append(self.next)
            self.next += 1
        best = None
        for node in stack:
            by_path, lengths = self.rules[node]
            for n in lengths:
                if n <= len(path) and (hit := by_path.get(path[:n])):
                    if best is None or len(hit[0]) > len(best[0]):
                        best = hit
                    break
        return best


def rule_blocks(rules: Sequence[tuple[str, str, str]], block_bytes: int) -> Iterator[list[tuple[str, str, str]]]:
    block, used = [], 0
    for rule in rules:
        block.append(tuple(rule))
        used += sum(map(len, rule)) + 64
        if used >= block_bytes:
            yield block
            block, used = [], 0
    if block:
        yield block


def judge_urls(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, id_col: str = "page_id",
               url_col: str = "url", default: str = "allow", block_bytes: int = 32 << 20) -> DataFrame:
    """``id_col``, host, path, rule (null if none fits) and verdict of every row of ``urls``."""
    id_type = urls.schema[id_col].dataType
    out = (
        urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
        .select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        .select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    )
    for block in rule_blocks(rules, block_bytes):
        out = _sweep(out, block)
    return out.select(F.col("id").cast(id_type).alias(id_col), "host", "path", "rule", "verdict")


def _sweep(judged: DataFrame, block: list[tuple[str, str, str]]) -> DataFrame:
    keyed = judged.withColumn("key", host_key(F.col("host")))
    ordered = keyed.repartitionByRange("key", "path", "id").sortWithinPartitions("key", "path", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(block)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "path", "rule", "verdict")]
            rules, verdicts = [], []
            for key, path, rule, verdict in zip(*columns, strict=True):
                hit = sweep.longest(key, path)
                if hit and (rule is None or len(hit[0]) > len(rule)):
                    rule, verdict = hit
                rules.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("host"), batch.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    return ordered.mapInArrow(run, judged.schema)
