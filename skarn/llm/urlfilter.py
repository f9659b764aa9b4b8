"""URL filters: a blocked Bloom filter, then an exact hash join.

Listed canonical URLs are prefixes: a host (fitting its subdomains) and the start
of a path, such as ``example.com/en/7`` or ``net/de/``.  A page URL has one
candidate key for each of its host suffixes and each listed path length; those
that pass the blocked Bloom filter (one 512-bit block a key) go to a hash join
with the list, which removes the false positives.  The longest listed URL wins.

The filter has ``BITS_PER_KEY`` bits a listed URL, between 1 MB and ``MAX_BLOCKS``
blocks (64 MB), so what the driver gathers and broadcasts is bounded; beyond some
53 million listed URLs more candidates pass to the join.

Hosts, paths and candidates are built-in functions.  Only pages with a candidate
that passes the filter are shuffled, by (host, path) and a salt; all others get
the default where they are read.

Defined cases: null URLs and URLs without ``://`` have an empty host and path,
fit no rule and get the default; with an empty list all do; repeated rows are
judged alike; columns named host, path, rule and verdict are replaced, other extra
columns are carried through; of equal listed URLs the smallest verdict counts (``allow``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, own, table, with_batches

#: Blocks of 512 bits: 1 MB and 64 MB.
MIN_BLOCKS, MAX_BLOCKS = 1 << 14, 1 << 20
BITS_PER_KEY = 10
PROBES = 6
#: Salts of the join of pages with the verdicts of their host and path.
SALTS = 16
DEFAULT = "allow"

#: The rules of the digest query: host, path, verdict.  Fixed values.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

#: A-Z and what they are lowered to.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "(?s)/.*$", 0)


def bloom_bits(key: str, blocks: int) -> tuple[int, list[int]]:
    """The block of a key and its bits within the 512 of the block."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) % blocks, [(h >> (9 * i)) & 511 for i in range(PROBES)]


def build_bloom(listed: DataFrame, blocks: int) -> np.ndarray:
    """The filter's words; partial words are or-ed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[int, int] = {}
            for key in batch.column(0).to_pylist():
                block, bits = bloom_bits(key, blocks)
                for b in bits:
                    at = block * 8 + (b >> 6)
                    words[at] = words.get(at, 0) | 1 << (b & 63)
            mask = np.array(list(words.values()), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.int64()), pa.array(mask)], ["word", "mask"])

    partial = listed.select("key").mapInArrow(run, "word long, mask long")
    out = np.zeros(blocks * 8, np.int64)
    for word, mask in partial.groupBy("word").agg(F.bit_or("mask")).collect():
        out[word] = mask
    return out.view(np.uint64)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Host suffixes at dots, each with each listed length of the path's start."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))
    every = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    url_col: str = "url",
    *,
    default: str = DEFAULT,
    blocks: int | None = None,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``listed`` has host, path and verdict; its path starts with ``/`` or is empty.
    ``blocks``: those of the filter, which else follow from the list.
    """
    entries = listed.select(
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("key"),
        F.length(F.coalesce("path", F.lit(""))).alias("n"),
        F.col("verdict").alias("verdict"),
    )
    # A URL has a bounded length, and so have these lists of lengths.
    of_length = entries.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()
    lengths, n_listed = sorted(r["n"] for r in of_length), sum(r["k"] for r in of_length)
    if blocks is None:
        blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, n_listed * BITS_PER_KEY // 512))
    bloom = pages.sparkSession.sparkContext.broadcast(build_bloom(entries, blocks))

    def passes(key: str) -> bool:
        block, bits = bloom_bits(key, blocks)
        words = bloom.value
        return all(int(words[block * 8 + (b >> 6)]) >> (b & 63) & 1 for b in bits)

    def compute(batch: pa.RecordBatch) -> dict:
        asked: dict[str, bool] = {}
        out = []
        for keys in batch.column(batch.schema.get_field_index(own("keys"))).to_pylist():
            for k in keys:
                if k not in asked:
                    asked[k] = passes(k)
            out.append([k for k in keys if asked[k]])
        return {own("keys"): out}

    host, path = split_url(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # The filter reads a key's host and path once for each page, not the page's other columns twice.
    split = pages.select(*kept, host.alias(own("host")), path.alias(own("path")))
    possible = split.withColumn(own("keys"), candidates(F.col(own("host")), F.col(own("path")), lengths))
    parsed = with_batches(possible, compute, [T.StructField(own("keys"), T.ArrayType(T.StringType()))])
    parsed = parsed.withColumnsRenamed({own("host"): "host", own("path"): "path"})
    hit = cut(parsed.filter(F.size(own("keys")) > 0))
    asked = hit.select("host", "path", F.explode(own("keys")).alias("key")).distinct()
    exact = entries.groupBy("key").agg(F.min("verdict").alias("verdict"))
    best = asked.join(exact, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "verdict")).alias("b"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    rules = best.select("host", "path", F.col("b.key").alias("rule"), F.col("b.verdict").alias("verdict"), part.alias(own("salt")))
    salted = hit.withColumn(own("salt"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS).cast("long")))
    found = salted.join(rules, ["host", "path", own("salt")], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    none = parsed.filter(F.size(own("keys")) == 0).withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    shown = [*kept, "host", "path", "rule", "verdict"]
    return found.select(*shown).unionByName(none.select(*shown))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP5_SQL = r"""
WITH rules(rhost, rpath, verdict) AS (
    VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
           ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), parts AS (
    SELECT page_id, url, coalesce(regexp_extract(substr(url, nullif(strpos(url, '://'), 0) + 3), '^[^?#]*'), '') AS rest FROM pages
), split AS (
    SELECT page_id, url,
           translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
    FROM parts
), ranked AS (
    SELECT s.*, r.rhost || r.rpath AS rule, r.verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
    FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT page_id, url, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE k = 1
"""
