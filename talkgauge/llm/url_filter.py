"""URL filters: a sort-merge range join of URLs with allow and block rules.

A host's labels, reversed and each closed with a dot, make a key in which a host and all its
subdomains are one interval: every key that starts with the host's. Intervals of rules are nested or
apart, so one sweep over sorted URLs and sorted rules keeps the rules that hold at a URL on a stack.
Of the rules on the stack whose path begins the URL's path, the longest wins.

Each task sorts the URLs that it reads and sweeps them against the rules, which go out in blocks
of a bounded number of rules and bytes. URLs are not shuffled, so a host that has a third of all rows costs no more than others.
With more rules than one block holds there is one sweep for each block, whose fits are a part of one table, and the longest of a
URL's fits wins; nothing then depends on the rules' number but time.

A URL that is null or has no ``://`` has an empty host and path, and no rule fits it. Hosts are kept as
they are but for A-Z in lower case, ports and user names included. A rule of which another has the same host and path
gives way to the one that blocks. Repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.llm.common import lower_ascii, materialize, shared_path

#: Rules in one block, and bytes of their hosts and paths; some 20 MB in a Python worker.
BLOCK_RULES, BLOCK_BYTES = 100_000, 8 << 20


def host_and_path(url):
    """Host between the first ``://`` and ``/ ? #`` or the end; path from there to ``? #`` or the end."""
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def host_key(host):
    """The labels in reverse, each closed with a dot: ``a.example.net`` is ``net.example.a.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


class Sweep:
    """Merges URLs in key order with the sorted rules; ``stack`` has the rules whose interval holds the key."""

    def __init__(self, rules: list[tuple[bytes, list[tuple[bytes, str, str]]]]):
        self.rules, self.at, self.stack, self.key = rules, 0, [], None

    def longest(self, key: bytes, path: bytes) -> tuple[str, str] | None:
        if key != self.key:
            stack, rules = self.stack, self.rules
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            while self.at < len(rules) and rules[self.at][0] <= key:
                if key.startswith(rules[self.at][0]):
                    stack.append(rules[self.at])
                self.at += 1
            self.key = key
        best = None
        for prefix, paths in self.stack:
            for start, rule, action in paths:  # the longest path of a host comes first
                if path.startswith(start):
                    rank = (len(prefix) - 1 + len(start), len(prefix))
                    if best is None or rank > best[0]:
                        best = (rank, rule, action)
                    break
        return best and best[1:]


def _nested(rows: list[tuple[str, str, str, str]]) -> list[tuple[bytes, list[tuple[bytes, str, str]]]]:
    """Sorted (key, path, rule, action) as one entry for each key, longest path first."""
    hosts: dict[bytes, dict[bytes, tuple[str, str]]] = {}
    for key, path, rule, action in rows:
        paths = hosts.setdefault(key.encode(), {})
        if action == "block" or path.encode() not in paths:
            paths[path.encode()] = (rule, action)
    return [(key, sorted(((p, *x) for p, x in paths.items()), key=lambda p: -len(p[0]))) for key, paths in sorted(hosts.items())]


def _sweep(urls: DataFrame, rules: list, default: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(_nested(rules))

    def judge(batches):
        sweep = Sweep(shared.value)
        for batch in batches:
            found = [sweep.longest(key.encode(), path.encode()) for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist())]
            rule = pa.array([x and x[0] for x in found], pa.string())
            verdict = pa.array([x[1] if x else default for x in found], pa.string())
            kept = [i for i, name in enumerate(batch.schema.names) if name != "key"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), rule, verdict], names=[*(batch.schema.names[i] for i in kept), "rule", "verdict"])

    kept = ", ".join(f"`{name}` {kind}" for name, kind in urls.dtypes if name != "key")
    return urls.sortWithinPartitions("key").mapInArrow(judge, f"{kept}, rule string, verdict string")


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", block_rules: int = BLOCK_RULES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row.

    ``rules`` has ``host, path, action`` (allow or block); a path starts with ``/``. ``rule`` is the rule's host and path; it is null, and the verdict
    the default, where none fits.
    """
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", host_key("host"))
    sorted_rules = rules.select(
        host_key(lower_ascii(F.col("host"))).alias("key"), F.col("path"),
        F.concat(lower_ascii(F.col("host")), F.col("path")).alias("rule"), F.lower("action").alias("action"),
    ).dropna()
    size = F.octet_length("key") + F.octet_length("rule") + F.octet_length("path")
    n, n_bytes = sorted_rules.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n <= block_rules and n_bytes <= block_bytes:
        return _sweep(urls, [tuple(row) for row in sorted_rules.collect()], default)
    stored = materialize(sorted_rules, "rules")
    urls = materialize(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    fits, part = shared_path(pages.sparkSession, "fits"), urls.select("row", "key", "path")
    rank = F.struct(F.octet_length("rule").alias("n"), F.instr("rule", "/").alias("host"), (F.col("verdict") == "block").alias("block"))

    def sweep(block: list) -> None:
        _sweep(part, block, default).filter("rule is not null").select("row", "rule", "verdict", rank.alias("rank")).write.mode("append").parquet(fits)

    held, held_bytes = [], 0
    for row in stored.orderBy("key", "path").toLocalIterator():
        more = sum(len((row[i] or "").encode()) for i in range(3))
        if held and (len(held) == block_rules or held_bytes + more > block_bytes):
            sweep(held)
            held, held_bytes = [], 0
        held.append(tuple(row))
        held_bytes += more
    sweep(held)
    best = pages.sparkSession.read.parquet(fits).groupBy("row").agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
