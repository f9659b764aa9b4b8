"""Line dedup by a sharded minimal perfect hash.

1. Every document gives its distinct line hashes (128 bits); they are counted
   with map-side partial sums: one row per distinct line hash.
2. The distinct hashes are dealt into shards of a bounded number of keys.  Each
   shard builds a minimal perfect hash (displacements per bucket) and stores, at
   the place of each key, a 64-bit fingerprint and a document count in two
   compact arrays.  An array slot is addressed without storing any key.
3. The documents' line hashes are routed to the shard that owns them and probe
   its arrays; the line texts are never joined.  Only hashes of frequent lines
   come back, as one short list per document, and the texts are rewritten.

Skew: a shard that owns a line of very many documents is probed in parts of about
``part_rows`` probes, each with a copy of the shard's arrays.  Which shards are
split, and in how many parts, follows from the counts; at most ``MAX_SPLIT``
shards can be, as the parts grow where there would be more, so that this list is
broadcast at any size.  Rows that repeat are salted where lists meet texts.

Defined cases: a null or empty text is one empty line (whose key is empty and so
never dropped while ``min_chars`` >= 1) and comes back as an empty text from
``dedup_lines`` and unchanged from ``drop_frequent_lines``; a line that occurs
twice in a document counts once for it; rows of one id are one document, a row
without an id is a document of its own; extra columns are carried through, but
for columns named n_lines or n_dropped, which ``dedup_lines`` replaces and
``drop_frequent_lines`` keeps; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, own, row_key, table, text_bytes, with_batches

MIN_DOCS = 10
MIN_CHARS = 1
#: Keys of a shard, and probes of a part of it.
SHARD_KEYS = PART_ROWS = 100_000
#: Shards that are probed in several parts, at most; 12 bytes each.
MAX_SPLIT = 500_000
#: Salts of the join of texts with the lists of their frequent lines.
SALTS = 8
BLANK = b" \t\n\x0b\x0c\r"
_WIDE = np.dtype("<i8")


def line_key(line: bytes) -> bytes:
    """Blanks stripped at both ends, A-Z lower-cased; the other bytes stay."""
    return line.strip(BLANK).lower()


def line_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode())


# --- minimal perfect hash -------------------------------------------------


def _mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Hash and displace: a bucket's displacement sends its keys to free places.

    ``keys`` are distinct uint64.  Buckets are placed largest first; the last
    ones, of a single key, take a free place directly (negative displacement).
    """

    def __init__(self, displacements: np.ndarray, size: int):
        self.displacements, self.size = displacements, size

    @classmethod
    def build(cls, keys: np.ndarray, per_bucket: int = 4) -> PerfectHash:
        size = len(keys)
        n_buckets = max(1, -(-size // per_bucket))
        shift = np.zeros(n_buckets, np.int32)
        if not size:
            return cls(shift, 0)
        bucket = (_mix(keys, 1) % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=n_buckets)
        ends = np.cumsum(counts)
        taken = np.zeros(size, bool)
        ranked = np.argsort(-counts, kind="stable")
        n, single = np.uint64(size), int((counts > 1).sum())
        # Buckets of one size are tried together: each round gives all that are
        # still unplaced their next displacement and keeps those without clash.
        for b_size in range(int(counts.max()), 1, -1):
            open_ = ranked[:single][counts[ranked[:single]] == b_size]
            members = keys[order[(ends[open_] - b_size)[:, None] + np.arange(b_size)]] if len(open_) else None
            salt = 0
            while len(open_):
                salt += 1
                at = (_mix(members, salt + 1) % n).astype(np.int64)
                row = np.sort(at, axis=1)
                good = (row[:, 1:] != row[:, :-1]).all(axis=1) & ~taken[at].any(axis=1)
                cand = np.flatnonzero(good)
                if len(cand):
                    flat, who = at[cand].ravel(), np.repeat(np.arange(len(cand)), b_size)
                    first = np.full(size, len(cand), np.int64) if len(cand) > size // 8 else None
                    if first is not None:
                        np.minimum.at(first, flat, who)
                        fine = (first[flat] == who).reshape(-1, b_size).all(axis=1)
                    else:
                        _, inverse = np.unique(flat, return_inverse=True)
                        low = np.full(inverse.max() + 1, len(cand), np.int64)
                        np.minimum.at(low, inverse, who)
                        fine = (low[inverse] == who).reshape(-1, b_size).all(axis=1)
                    won = cand[fine]
                    taken[at[won].ravel()] = True
                    shift[open_[won]] = salt
                    left = np.ones(len(open_), bool)
                    left[won] = False
                    open_, members = open_[left], members[left]
        alone = ranked[single:]
        alone = alone[counts[alone] == 1]
        shift[alone] = -1 - np.flatnonzero(~taken)[: len(alone)].astype(np.int32)
        return cls(shift, size)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key of the set; some place for any other key."""
        shift = self.displacements[(_mix(keys, 1) % np.uint64(len(self.displacements))).astype(np.int64)]
        hashed = (_mix(keys, (shift + 1).astype(np.int64).astype(np.uint64)) % np.uint64(max(1, self.size))).astype(np.int64)
        return np.where(shift < 0, -1 - shift.astype(np.int64), hashed)


# --- the operator -----------------------------------------------------------


def _line_hashes(keyed: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row key a, b, hashes): the distinct line hashes of each row, 16 bytes each."""

    def compute(batch: pa.RecordBatch) -> dict:
        out = []
        for text in text_bytes(batch.column(batch.schema.get_field_index(own("text")))):
            keys = {line_key(x) for x in (text or b"").split(b"\n")}
            out.append(b"".join([line_hash(k) for k in keys if code_points(k) >= min_chars]))
        return {own("lines"): out}

    return with_batches(
        keyed.select(F.col(id_col).alias(own("id")), own("a"), own("b"), F.col(text_col).alias(own("text"))),
        compute,
        [T.StructField(own("lines"), T.BinaryType())],
        drop=(own("text"),),
    )


def _unpacked(lines: DataFrame, *kept: str) -> DataFrame:
    """One row per row and line: the kept columns and the two halves x, y of the hash."""
    rows = lines.select(*kept, own("lines"))
    fields = [*rows.schema.fields[:-1], T.StructField(own("x"), T.LongType()), T.StructField(own("y"), T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(batch.num_columns - 1).to_pylist()
            half = np.frombuffer(b"".join(packed), _WIDE).reshape(-1, 2)
            n = pa.array(np.repeat(np.arange(len(packed)), [len(p) // 16 for p in packed]))
            columns = [batch.column(i).take(n) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(half[:, 0].copy()), pa.array(half[:, 1].copy())], [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def count_lines(lines: DataFrame) -> DataFrame:
    """(x, y, n): documents of each distinct line hash, summed on the map side first.

    Where ids repeat, a document's line is taken once before the count.
    """
    ids = lines.filter(F.col(own("id")).isNotNull())
    if ids.groupBy(own("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = _unpacked(lines)
    else:
        once = _unpacked(ids, own("id")).distinct().select(own("x"), own("y"))
        rows = once.unionByName(_unpacked(lines.filter(F.col(own("id")).isNull())))
    return rows.groupBy(own("x"), own("y")).agg(F.count(F.lit(1)).alias(own("n")))


def _shard(n_shards: int) -> Column:
    return F.pmod(F.xxhash64(own("x")), F.lit(n_shards))


def slot_keys(x: np.ndarray, y: np.ndarray, salt: int) -> np.ndarray:
    """The 64 bits by which a line hash is placed in its shard."""
    return _mix(x.view(np.uint64), salt) ^ y.view(np.uint64)


def build_shards(counts: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: a salt, and displacements, fingerprints and counts as arrays."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[own("x")].to_numpy(np.int64), pdf[own("y")].to_numpy(np.int64)
        salt, keys = 0, slot_keys(x, y, 0)
        while len(np.unique(keys)) < len(keys):  # distinct hashes of 128 bits: another salt parts them
            salt += 1
            keys = slot_keys(x, y, salt)
        hashed = PerfectHash.build(keys)
        place = hashed.places(keys)
        prints, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint32)
        prints[place] = x
        count[place] = np.minimum(pdf[own("n")].to_numpy(), 2**32 - 1)
        return pd.DataFrame(
            {
                own("shard"): [int(pdf[own("shard")].iloc[0])],
                own("salt"): [salt],
                own("displacements"): [hashed.displacements.astype("<i4").tobytes()],
                own("prints"): [prints.astype("<i8").tobytes()],
                own("counts"): [count.astype("<u4").tobytes()],
            }
        )

    schema = f"{own('shard')} long, {own('salt')} long, {own('displacements')} binary, {own('prints')} binary, {own('counts')} binary"
    return counts.withColumn(own("shard"), _shard(n_shards)).groupBy(own("shard")).applyInPandas(build, schema)


def split_shards(counts: DataFrame, n_shards: int, part_rows: int) -> DataFrame:
    """(shard, parts) of the shards that are asked more often than ``part_rows`` times.

    With T probes there are fewer than T / part_rows of them.
    """
    load = counts.groupBy(_shard(n_shards).alias(own("shard"))).agg(F.sum(own("n")).alias(own("load")))
    return load.filter(F.col(own("load")) > part_rows).select(own("shard"), F.ceil(F.col(own("load")) / part_rows).cast("int").alias(own("parts")))


def probe_shards(probes: DataFrame, shards: DataFrame, split: DataFrame, n_shards: int, min_docs: int) -> DataFrame:
    """The probes whose line has a count of at least ``min_docs``, by way of the arrays.

    Probes have a, b, x, y and a row number m, which deals them to the parts.
    """
    few = F.broadcast(split)  # MAX_SPLIT rows at most
    part = F.pmod(F.xxhash64(own("m")), F.coalesce(own("parts"), F.lit(1)))
    sent = probes.withColumn(own("shard"), _shard(n_shards)).join(few, own("shard"), "left").withColumn(own("part"), part)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(own("parts"), F.lit(1)).cast("long") - 1))
    copies = shards.join(few, own("shard"), "left").withColumn(own("part"), every).drop(own("parts"))
    names = [own(c) for c in "abxy"]

    def probe(asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or arrays.empty:
            return asked[names].iloc[:0]
        row = arrays.iloc[0]
        prints, count = np.frombuffer(row[own("prints")], "<i8"), np.frombuffer(row[own("counts")], "<u4")
        hashed = PerfectHash(np.frombuffer(row[own("displacements")], "<i4"), len(prints))
        x = asked[own("x")].to_numpy(np.int64)
        place = hashed.places(slot_keys(x, asked[own("y")].to_numpy(np.int64), int(row[own("salt")])))
        return asked.loc[(prints[place] == x) & (count[place] >= min_docs), names]

    by = [own("shard"), own("part")]
    asked = sent.select(*names, *by).groupBy(*by)
    return asked.cogroup(copies.groupBy(*by)).applyInPandas(probe, ", ".join(f"{n} long" for n in names))


def dedup_lines(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    *,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    shard_keys: int = SHARD_KEYS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """``docs`` with the text rewritten, and n_lines and n_dropped added."""
    a, b = row_key(id_col, text_col)
    keyed = docs.withColumn(own("a"), a).withColumn(own("b"), b)
    lines = cut(_line_hashes(keyed, id_col, text_col, min_chars))
    counts = cut(count_lines(lines))
    size = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum(own("n")).alias("rows")).first()
    n_shards = max(1, ceil((size["keys"] or 0) / shard_keys))
    split = split_shards(counts, n_shards, max(part_rows, ceil((size["rows"] or 0) / MAX_SPLIT)))
    numbered = _unpacked(lines, own("a"), own("b")).withColumn(own("m"), F.monotonically_increasing_id())
    found = probe_shards(numbered, build_shards(counts, n_shards), split, n_shards, min_docs)
    half = F.struct(own("x"), own("y"))
    # The line hashes of a row are distinct; rows that repeat share their list.
    per_row = found.groupBy(own("a"), own("b")).agg(F.collect_set(half).alias(own("drop")))
    per_row = per_row.withColumn(own("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = keyed.withColumn(own("salt"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS).cast("long")))
    joined = salted.join(per_row, [own("a"), own("b"), own("salt")], "left")
    rows = joined.select(*docs.columns, own("drop"))

    def compute(batch: pa.RecordBatch) -> dict:
        drops = batch.column(batch.schema.get_field_index(own("drop")))
        flat = drops.flatten()
        sizes = np.asarray(pc.fill_null(pc.list_value_length(drops), 0), np.int64)
        pairs = np.stack([np.asarray(flat.field(0)), np.asarray(flat.field(1))], 1).astype(_WIDE) if len(flat) else np.zeros((0, 2), _WIDE)
        packed, at = pairs.tobytes(), 0
        texts, n_lines, n_dropped = [], [], []
        for text, n in zip(text_bytes(batch.column(batch.schema.get_field_index(text_col))), sizes, strict=True):
            gone = {packed[i : i + 16] for i in range(at * 16, (at + n) * 16, 16)}
            at += n
            split_ = (text or b"").split(b"\n")
            kept = split_
            if gone:
                kept = [x for x in split_ if code_points(k := line_key(x)) < min_chars or line_hash(k) not in gone]
            texts.append(b"\n".join(kept).decode())
            n_lines.append(len(split_))
            n_dropped.append(len(split_) - len(kept))
        return {text_col: texts, "n_lines": n_lines, "n_dropped": n_dropped}

    added = [
        T.StructField(text_col, T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
    ]
    return with_batches(rows, compute, added, drop=(own("drop"),))


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with its own columns, in their order, and the text rewritten; null texts stay null.

    ``length_col`` names a column that follows the length of a text that changed.
    """
    names = {c: own(f"c{i}") for i, c in enumerate(docs.columns) if c not in (text_col, id_col)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns], F.col(text_col).isNull().alias(own("null")))
    done = dedup_lines(renamed, text_col, id_col, **options).withColumn(text_col, F.when(~F.col(own("null")), F.col(text_col)))
    if length_col in names:
        now = F.when(F.col("n_dropped") > 0, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(names[length_col]))
        done = done.withColumn(names[length_col], now)
    return done.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), frequent AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""
