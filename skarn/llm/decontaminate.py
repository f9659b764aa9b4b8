"""Benchmark decontamination with a broadcast hash set of test n-grams.

The normalised windows of the benchmark are hashed into a sorted array that is
broadcast; tasks roll the same hash over all word windows of the whole training
texts, and compare the words themselves wherever a hash is found, so no hash
collision counts.  Words inside verified windows are hit; documents are kept,
removed, or have their hit spans cut out.

The broadcast set is bounded: it holds at most ``max_windows`` windows.  A larger
benchmark is dealt by item into several sets, one pass over the documents each,
and the hit positions of the passes are merged before any decision.

Defined cases: null texts have no words; an item of fewer than ``window`` words
is one window of its own length, an item without words has none; items without an
id hit like all others and are one item, null and last, together; equal windows of several items count for each of them; repeated rows are
judged alike; other columns are carried through; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, own, row_key, table, text_bytes, with_batches

WINDOW = 13
MAX_WINDOWS = 1_000_000
#: Contaminated: some hit and at least 1 in SHARE words hit.
SHARE = 20
#: Bytes to words: A-Z lowered, every other ASCII byte but 0-9 and a-z a blank.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def fold(text: bytes | None) -> bytes:
    return (text or b"").translate(FOLD)


def in_order(items: Iterable[str | None]) -> list[str | None]:
    """Sorted as strings, null last."""
    return sorted(items, key=lambda i: (i is None, i or ""))


def rolled(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` codes (0: a word that no window has)."""
    n = len(codes) - length + 1
    out = codes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, length):
            out = out * _PRIME + codes[i : i + n]
        return out ^ (out >> np.uint64(31))


class Windows:
    """The windows of one part of the benchmark; what tasks get by broadcast.

    Words are numbered, so a window is a place in one array of numbers: a hash, a
    place and the numbers of its items are kept, some 40 bytes in all.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.codes: dict[bytes, int] = {}
        self.names: list[str | None] = in_order({item for item, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        flat, at, starts = array("I"), 0, defaultdict(list)
        for item, text in items:
            words = fold(text).split()
            flat.extend([self.codes.setdefault(w, len(self.codes) + 1) for w in words])
            size = min(window, len(words))
            if size:
                starts[size].append((np.arange(at, at + len(words) - size + 1), number[item]))
            at += len(words)
        self.flat = np.array(flat, np.uint32)
        self.by_length = {n: self._distinct(n, found) for n, found in starts.items()}

    def _distinct(self, length: int, found: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
        """Hashes in order, a place of each distinct window, and where its items begin."""
        places = np.concatenate([p for p, _ in found])
        items = np.repeat(np.array([i for _, i in found], np.int64), [len(p) for p, _ in found])
        grams = np.lib.stride_tricks.sliding_window_view(self.flat, length)[places]
        _, first, which = np.unique(grams, axis=0, return_index=True, return_inverse=True)
        hashes = np.zeros(len(first), np.uint64)
        for i in range(0, len(first), 4096):
            part = grams[first[i : i + 4096]].astype(np.uint64)
            hashes[i : i + 4096] = rolled(part.ravel(), length)[::length]
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        owned = np.unique(rank[which.ravel()] * len(self.names) + items)
        ends = np.searchsorted(owned, np.arange(len(order) + 1) * len(self.names))
        return hashes[order], places[first[order]], (owned % len(self.names)).astype(np.int32), ends

    def _verified(self, codes: np.ndarray, length: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of runs that are windows, and which windows, word for word."""
        hashes, places, _, _ = self.by_length[length]
        hashed = rolled(codes, length)[starts]
        at, step = np.searchsorted(hashes, hashed), np.arange(length)
        good, which = [], []
        while len(starts):
            alike = at < len(hashes)
            alike[alike] = hashes[at[alike]] == hashed[alike]
            starts, at, hashed = starts[alike], at[alike], hashed[alike]
            same = (self.flat[places[at][:, None] + step] == codes[starts[:, None] + step]).all(axis=1)
            good.append(starts[same])
            which.append(at[same])
            starts, at, hashed = starts[~same], at[~same] + 1, hashed[~same]  # other words, equal hash
        return np.concatenate([*good, np.zeros(0, np.int64)]), np.concatenate([*which, np.zeros(0, np.int64)])

    def scan(self, data: bytes) -> tuple[list[bytes], np.ndarray | None, set[str]]:
        """The words, which of them are hit (None: none), and the items found."""
        words = data.split()
        found: set[str] = set()
        if not self.by_length or not words:
            return words, None, found
        get = self.codes.get
        codes = np.fromiter([get(w, 0) for w in words], np.uint64, len(words))
        # A window lies in a run of known words; most texts have no long one.
        known = np.concatenate(([0], np.cumsum(codes != 0)))
        edges = None
        for length, (_, _, owned, ends) in self.by_length.items():
            if length > len(words):
                continue
            starts = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(starts):
                continue
            starts, which = self._verified(codes, length, starts)
            if not len(starts):
                continue
            if edges is None:
                edges = np.zeros(len(words) + 1, np.int64)
            edges[starts] += 1
            edges[starts + length] -= 1
            for w in np.unique(which).tolist():
                found.update([self.names[i] for i in owned[ends[w] : ends[w + 1]].tolist()])
        return words, None if edges is None else np.cumsum(edges[:-1]) > 0, found


def _parts(benchmark: DataFrame, item_col: str, text_col: str, window: int, max_windows: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of parts of about ``max_windows`` words, so of no more windows,
    and the parts, of which the driver holds one at a time."""
    words = F.regexp_count(F.col(own("t")), F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"))
    items = benchmark.select(F.col(item_col).cast("string").alias(own("i")), F.col(text_col).cast("string").alias(own("t")))
    items = items.filter(F.col(own("t")).isNotNull())
    total = items.agg(F.sum(words)).first()[0] or 0
    n = max(1, ceil(total / max_windows))
    chosen = lambda part: items if n == 1 else items.filter(F.pmod(F.xxhash64(own("i"), own("t")), F.lit(n)) == part)
    return n, ([(r[0], r[1].encode()) for r in chosen(part).collect()] for part in range(n))


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    *,
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
    share: int = SHARE,
    clean_text: bool = False,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (array, sorted as strings, null last) and contaminated.

    ``clean_text`` adds clean_text: the text without its hit spans.
    """
    spark = docs.sparkSession
    n, parts = _parts(benchmark, item_col, "text", window, max_windows)
    if n == 1:
        return _scan_once(docs, spark.sparkContext.broadcast(Windows(next(parts), window)), text_col, share, clean_text)
    return _scan_parts(docs, parts, text_col, window, share, clean_text)


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("contaminated", T.BooleanType()),
]


def without(text: bytes | None, hit: np.ndarray | None) -> str | None:
    """The text without the hit words and the separators inside hit spans."""
    if text is None or hit is None:
        return None if text is None else text.decode()
    spans = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for first, last in edges.reshape(-1, 2):
        out.append(text[at : spans[first][0]])
        at = spans[last - 1][1]
    return b"".join([*out, text[at:]]).decode()


def _scan_once(docs: DataFrame, shared, text_col: str, share: int, clean_text: bool) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> dict:
        windows = shared.value
        out: dict[str, list] = {f.name: [] for f in _FIELDS} | ({"clean_text": []} if clean_text else {})
        for text in text_bytes(batch.column(batch.schema.get_field_index(text_col))):
            words, hit, found = windows.scan(fold(text))
            n = 0 if hit is None else int(hit.sum())
            out["n_words"].append(len(words))
            out["n_hit"].append(n)
            out["items"].append(in_order(found))
            out["contaminated"].append(n > 0 and share * n >= len(words))
            if clean_text:
                out["clean_text"].append(without(text, hit))
        return out

    return with_batches(docs, compute, _FIELDS + [T.StructField("clean_text", T.StringType())] * clean_text)


def _scan_parts(docs: DataFrame, parts, text_col: str, window: int, share: int, clean_text: bool) -> DataFrame:
    """One pass for each part of a benchmark too large for one broadcast.

    The hits of a pass are cut before the next, so one broadcast lives at a time.
    """
    context = docs.sparkSession.sparkContext
    a, b = row_key(text_col)
    keyed = docs.withColumn(own("a"), a).withColumn(own("b"), b)
    passes = None
    fields = [T.StructField(own("spans"), T.BinaryType()), T.StructField(own("items"), T.ArrayType(T.StringType()))]
    for part in parts:
        shared = context.broadcast(Windows(part, window))

        def compute(batch: pa.RecordBatch, shared=shared) -> dict:
            spans, items = [], []
            for text in text_bytes(batch.column(batch.schema.get_field_index(own("t")))):
                _, hit, found = shared.value.scan(fold(text))
                spans.append(None if hit is None else np.flatnonzero(hit).astype("<i8").tobytes())
                items.append(in_order(found))
            return {own("spans"): spans, own("items"): items}

        narrow = keyed.select(own("a"), own("b"), F.col(text_col).alias(own("t")))
        hits = cut(with_batches(narrow, compute, fields, drop=(own("t"),)).filter(F.col(own("spans")).isNotNull()))
        shared.destroy()
        passes = hits if passes is None else passes.unionByName(hits)
    merged = passes.groupBy(own("a"), own("b")).agg(
        F.collect_set(own("spans")).alias(own("spans")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(own("items"))))).alias(own("items")),
    )
    rows = keyed.join(merged, [own("a"), own("b")], "left").drop(own("a"), own("b"))

    def decide(batch: pa.RecordBatch) -> dict:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        out: dict[str, list] = {f.name: [] for f in _FIELDS} | ({"clean_text": []} if clean_text else {})
        for text, spans, items in zip(text_bytes(column(text_col)), column(own("spans")).to_pylist(), column(own("items")).to_pylist(), strict=True):
            n_words, hit = len(fold(text).split()), None
            if spans:
                hit = np.zeros(n_words, bool)
                for span in spans:
                    hit[np.frombuffer(span, "<i8")] = True
            n = 0 if hit is None else int(hit.sum())
            out["n_words"].append(n_words)
            out["n_hit"].append(n)
            out["items"].append(in_order(items or []))
            out["contaminated"].append(n > 0 and share * n >= n_words)
            if clean_text:
                out["clean_text"].append(without(text, hit))
        return out

    return with_batches(rows, decide, _FIELDS + [T.StructField("clean_text", T.StringType())] * clean_text, drop=(own("spans"), own("items")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    # Columns of the caller with our names come back unchanged.
    names = {c: own("c_" + c) if c in {*(f.name for f in _FIELDS), "clean_text"} else c for c in docs.columns}
    judged = scan_documents(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), benchmark, **options)
    return judged.filter(~F.col("contaminated")).select(*[F.col(n).alias(c) for c, n in names.items()])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = scan_documents(docs, table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP6_SQL = r"""
WITH docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark
), grams AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM grams),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (
    SELECT p.doc_id, p.i, p.n, g.item_id FROM places p JOIN grams g ON p.n = g.n AND p.g = g.g
), covered AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""
