"""Listed URLs allow or block pages: a blocked Bloom filter finds possible hits, an exact join decides.

A rule is a canonical URL, (host, path) with A-Z of the host in lower case.  It fits a page if the
page's host is the rule's or a subdomain of it and the page's path starts with the rule's.  The
longest rule (host and path together, then the longer host) wins; without one the verdict is
``default``.

1. Every rule sets eight bits, one in each 32-bit word of one 256-bit block; Spark joins the bits
   with ``bit_or`` by block.  The number of blocks follows the number of rules up to ``max_blocks``
   (8 MB at the default), so what is broadcast is bounded; beyond that more pages are possible hits, and
   results stay the same.
2. A page asks for its host and the hosts above it, as far as a rule's host has that length, and for those
   that the filter may hold, for the starts of its path of each rule's length.  A host of a rule is entered
   in the filter as well.
3. Keys that may be listed are counted and joined with the rules by equality; false positives
   find no partner.  Keys that many pages share are handed back by a bounded broadcast.

Rows are never dropped: a null URL, or one without ``://``, has an empty host and path; null page
ids and repeated rows are judged like others, each by itself; further columns are not looked at.
Rules with a null host or verdict, or whose path neither is empty (or null) nor starts with ``/``, fit nothing.
Of rules for the same host and path with different verdicts ``block`` wins.  No rules: ``default`` for all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import batches_of, cut_lineage, join_hot, only

WORDS = 8
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL, both empty if it is null or has no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def canonical_rules(rules: DataFrame) -> DataFrame:
    """(key, host, path, verdict), each key once."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    sound = only(rules, host="host", path="path", verdict="verdict").select(host.alias("host"), path.alias("path"), "verdict")
    sound = sound.filter("host IS NOT NULL AND verdict IS NOT NULL AND (path = '' OR startswith(path, '/'))")
    # "block" sorts behind "allow"
    return sound.groupBy(F.concat("host", "path").alias("key")).agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("verdict").alias("verdict"))


def places(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key and the bit it has in each of the block's words."""
    digests = b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys)
    halves = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    bits = (halves[:, 1:] >> (np.arange(WORDS, dtype=np.uint64) * np.uint64(5))) & np.uint64(31)
    return (halves[:, 0] & np.uint64(blocks - 1)).astype(np.int64), (np.uint64(1) << bits).astype(np.uint32)


def bloom_filter(keys: DataFrame, blocks: int) -> np.ndarray:
    """Blocks of eight words with the bits of all keys; ``keys`` has one column."""

    def bits_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1 << 14):
            block, masks = places(batch.column(0).to_pylist(), blocks)
            found, at = np.unique(block, return_inverse=True)
            words = np.zeros((len(found), WORDS), np.uint32)
            np.bitwise_or.at(words, at, masks)
            yield pa.RecordBatch.from_arrays([pa.array(found), *[pa.array(words[:, k].astype(np.int64)) for k in range(WORDS)]], ["block", *[f"w{k}" for k in range(WORDS)]])

    schema = "block long, " + ", ".join(f"w{k} long" for k in range(WORDS))
    rows = keys.mapInArrow(bits_of, schema).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]).toArrow()
    table = np.zeros((blocks, WORDS), np.uint32)
    block = rows.column("block").to_numpy()
    for k in range(WORDS):
        table[block, k] = rows.column(f"w{k}").to_numpy().astype(np.uint32)
    return table


def may_hold(table: np.ndarray, keys: list[str]) -> np.ndarray:
    if not keys:
        return np.zeros(0, bool)
    block, masks = places(keys, len(table))
    return ((table[block] & masks) == masks).all(axis=1)


def hosts_above(host: str, lengths: frozenset[int]) -> list[str]:
    """The host and its parent domains, as far as some rule's host is as long."""
    n = len(host)
    return [host[n - k :] for k in lengths if k == n or (k < n and host[n - k - 1] == ".")]


def possible_keys(table: np.ndarray, hosts: list[str], paths: list[str], host_lengths: frozenset[int], path_lengths: frozenset[int]) -> list[list[str]]:
    """For each page the keys of rules that fit it, and now and then one that no rule has."""
    out: list[list[str]] = [[] for _ in hosts]
    tops = [(i, h) for i, host in enumerate(hosts) for h in hosts_above(host, host_lengths)]
    kept = may_hold(table, [h for _, h in tops])
    starts = [(i, h + paths[i][:k]) for (i, h), ok in zip(tops, kept) if ok for k in path_lengths if k <= len(paths[i])]
    for (i, key), ok in zip(starts, may_hold(table, [k for _, k in starts])):
        if ok:
            out[i].append(key)
    return out


def given_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_blocks: int = 1 << 18) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``max_blocks`` is a power of two."""
    spark = pages.sparkSession
    listed = cut_lineage(canonical_rules(rules))
    sizes = listed.agg(F.count("*"), F.collect_set(F.length("host")), F.collect_set(F.length("path"))).first()
    host_lengths, path_lengths = frozenset(sizes[1]), frozenset(sizes[2])
    blocks = 1
    while blocks < max_blocks and blocks * 16 < 2 * sizes[0]:
        blocks *= 2
    keys = listed.select("key").unionByName(listed.select(F.col("host").alias("key")).distinct())
    filter_bits = spark.sparkContext.broadcast(bloom_filter(keys, blocks))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 4096):
            found = possible_keys(filter_bits.value, batch.column("host").to_pylist(), batch.column("path").to_pylist(), host_lengths, path_lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "keys"])

    host, path = host_and_path(F.col("url"))
    asked = only(pages, page_id="page_id", url="url").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    asked = asked.mapInArrow(ask, "page_id long, host string, path string, keys array<string>")
    asked = cut_lineage(asked.withColumn("row", F.monotonically_increasing_id()))

    possible = asked.filter("size(keys) > 0").select("row", "page_id", "host", "path", F.explode("keys").alias("key"))
    seen = possible.groupBy("key").agg(F.count("*").alias("n"))
    fits = F.struct(F.length("key").alias("size"), F.length("rule_host").alias("host_size"), F.col("key").alias("rule"), F.col("rule_verdict").alias("verdict"))
    exact = cut_lineage(seen.join(listed.select("key", F.col("host").alias("rule_host"), F.col("verdict").alias("rule_verdict")), "key"))
    hits = join_hot(possible, exact, "key", possible.count())
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("rule_host").isNotNull(), fits)).alias("best"))
    columns = ["page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")]
    none = asked.filter("size(keys) = 0").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return best.select(*columns).unionByName(none)


def rules_sql(default: str = "allow") -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
        rests AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
        fits AS (SELECT n, arg_max(rule_host || rule_path, 10000 * length(rule_host || rule_path) + length(rule_host)) AS rule,
                   arg_max(rule_verdict, 10000 * length(rule_host || rule_path) + length(rule_host)) AS verdict
                 FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM parts LEFT JOIN fits USING (n)"""
