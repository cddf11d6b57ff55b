"""URL filters: rules and blocked hosts in sorted arrays of 64-bit digests.

An index holds the xxhash64 digests of its strings in sorted order, and the strings themselves. A worker maps both from
an unnamed temporary file (made from bytes that Spark sends, so a lost executor rebuilds it), probes a whole batch by one
vectorised binary search, and confirms every hit against the stored string, so a collision cannot decide. A list of
`MAX_INDEX_BYTES` at most is sent to every task. A longer one (a table of any size) is dealt by digest into shards, each
an index of its own, and meets the distinct hosts' suffixes there.

Defined results: a null url, or one without `://`, has empty host and path, no rule and the verdict "allow"; repeated
rows are judged each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.shared import attach, materialize

#: The most that an index may hold if every executor gets a copy, and what a shard holds about.
MAX_INDEX_BYTES, SHARD_BYTES = 64 << 20, 16 << 20

#: Fixed values: (verdict, host, path) of the rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Names of unwanted sites, each under the three domains of the pages.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org")]


def build(strings: list[str]) -> bytes:
    """Count, sorted digests, string offsets and strings, as one block of bytes."""
    order = sorted((xxhash.xxh64_intdigest(b), b) for b in {s.encode() for s in strings})
    offsets = np.cumsum([0, *[len(b) for _, b in order]], dtype=np.uint64)
    return np.uint64(len(order)).tobytes() + np.array([d for d, _ in order], dtype=np.uint64).tobytes() + offsets.tobytes() + b"".join(b for _, b in order)


class DigestIndex:
    """A memory-mapped index made by build()."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:  # unnamed: nothing is left behind
            f.write(block)
            f.flush()
            self.map = np.memmap(f, dtype=np.uint8, mode="r")
        n = int(self.map[:8].view(np.uint64)[0])
        self.digests = self.map[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = self.map[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.strings = self.map[16 + 16 * n :]

    def contains(self, keys: list[bytes]) -> np.ndarray:
        if not keys or not len(self.digests):
            return np.zeros(len(keys), dtype=bool)
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        at = np.searchsorted(self.digests, digests)
        hit = np.zeros(len(keys), dtype=bool)
        for k in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests)):
            i = int(at[k])
            while i < len(self.digests) and self.digests[i] == digests[k] and not hit[k]:  # equal digests stand together
                hit[k] = self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes() == keys[k]
                i += 1
        return hit


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) of a url."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = rest
    for stop in "/?#":
        host = host.partition(stop)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def host_suffixes(host: str, longest: int) -> list[str]:
    """The host and the domains above it that have longest characters at most, shortest first; a longer one is in no list."""
    out, at = [], len(host)
    while at >= 0 and (at := host.rfind(".", 0, at)) >= 0 and len(host) - at - 1 <= longest:
        out.append(host[at + 1 :])
    return out if at >= 0 or len(host) > longest else [*out, host]


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(host) of a text file with a host a line; blank lines and those that open with # are left out."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("host"))
    return lines.where((F.col("host") != "") & ~F.startswith("host", F.lit("#")))


def _listed_hosts(hosts: DataFrame, listed: DataFrame, size: int, longest: int) -> DataFrame:
    """(host) of the distinct hosts that the list, or a domain above them, names; both sides are dealt into shards by digest."""
    shards = size // SHARD_BYTES + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, s) for h in batch.column(0).to_pylist() for s in host_suffixes(h, longest)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], names=["host", "suffix"])

    def probe(names: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        hit = DigestIndex(build(names["host"].tolist())).contains([s.encode() for s in asked["suffix"]])
        return asked.loc[hit, ["host"]]

    suffixes = hosts.mapInArrow(cut, "host string, suffix string")
    by = F.pmod(F.xxhash64("suffix"), F.lit(shards)), F.pmod(F.xxhash64("host"), F.lit(shards))
    left = listed.select("host", by[1].alias("shard")).groupBy("shard")
    return left.cogroup(suffixes.withColumn("shard", by[0]).groupBy("shard")).applyInPandas(probe, "host string").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked: list[str] | DataFrame = BLOCKED_HOSTS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule that fits decides, else whether the host or one above is blocked.

    blocked is a list of hosts or a table (host).
    """
    spark = pages.sparkSession
    verdicts = {host + path: verdict for verdict, host, path in rules}
    lengths = sorted({len(path) for _, _, path in rules}, reverse=True)
    names = blocked if isinstance(blocked, DataFrame) else spark.createDataFrame([(h,) for h in blocked], "host string")
    size, longest = names.agg(F.coalesce(F.sum(F.octet_length("host") + 16), F.lit(0)), F.coalesce(F.max(F.length("host")), F.lit(0))).first()
    longest = max([longest, *[len(host) for _, host, _ in rules]])
    small = size <= MAX_INDEX_BYTES
    sent = spark.sparkContext.broadcast((build(list(verdicts)), build([r[0] for r in names.collect()] if small else [])))  # MAX_INDEX_BYTES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ruled, listed = (DigestIndex(b) for b in sent.value)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            keys, owner, hosts, host_owner = [], [], [], []
            for k, (host, path) in enumerate(parts):
                for s in host_suffixes(host, longest) if host else []:
                    hosts.append(s.encode())
                    host_owner.append(k)
                    for n in lengths:
                        if len(path) >= n:
                            keys.append((s + path[:n]).encode("utf-8", "surrogatepass"))
                            owner.append(k)
            rule: list[str | None] = [None] * len(parts)
            for i in np.flatnonzero(ruled.contains(keys)).tolist():
                found = keys[i].decode()
                if rule[owner[i]] is None or len(found) > len(rule[owner[i]]):
                    rule[owner[i]] = found
            bad = np.zeros(len(parts), dtype=bool)
            bad[np.array(host_owner, dtype=np.int64)[listed.contains(hosts)]] = True
            verdict = [verdicts[r] if r is not None else "block" if b else "allow" for r, b in zip(rule, bad.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    judged = pages.select(id_col, url_col).mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string")
    if small:
        return judged
    judged = materialize(judged, "judged")
    counted = materialize(judged.where(F.col("rule").isNull() & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n")), "hosts")
    bad = counted.join(_listed_hosts(counted.select("host"), names, size, longest), "host", "left_semi")
    open_, rest = F.col("rule").isNull() & (F.col("host") != ""), ~(F.col("rule").isNull() & (F.col("host") != ""))
    marked = attach(judged.where(open_), counted.join(bad.select("host", F.lit("block").alias("listed")), "host", "left"), "host", "n", counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    return judged.where(rest).union(marked.select(id_col, "host", "path", "rule", F.coalesce("listed", "verdict")))
