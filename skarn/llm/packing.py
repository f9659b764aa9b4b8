"""Best-fit packing of token sequences (bounded-space online best fit).

Texts are tokenized in Arrow batches, cut into pieces of at most ``capacity``
ids, and the piece descriptors (not the ids) are dealt by hash into groups of a
bounded number of pieces.  Each group is packed by one task with a fixed number
of open bins.  The open bins are keyed by their free space in a bitset, so the
tightest bin that still takes a piece is one shift and one lowest-set-bit away;
when one bin too many would be open, the fullest closes first.

Within a group the pieces arrive in runs of some thousands, by a hash, and within
a run longest first.  So every run brings short pieces that fill what is open, and
a small number of open bins does: on check_s (55,398 pieces, 15,498 sequences at
least) 1024 open bins need 15,499 sequences, 256 need 16,347 and 4096 need 15,499;
one run of all pieces would need 16,888, 17,726 and 15,624.

Defined cases: a null or empty text is the end-of-text id alone; an empty table
gives no rows; repeated rows are packed as often as they occur and are dealt to
groups like any others; a null id is
carried through; other columns are ignored; a text of any length is cut into
full pieces, of which only the last may be shorter.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, own, slices, table, text_bytes

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 1024
GROUP_PIECES = 100_000
RUN_PIECES = 8000
#: Tokenized words that a task keeps; a full memory is emptied, never relied on.
MEMORY_WORDS = 800_000

_loaded: dict[str, tuple] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A run of Latin letters (ASCII lowered), then signs that end a word and never join a letter.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?;:|%$#&*]*)")


def _byte_letters() -> dict[int, int]:
    """Byte-level letters: printable Latin-1 bytes stand for themselves, others for 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class WordTokenizer:
    """Ids of whole texts, put together from the ids of their words.

    The vocabulary drops white space and never joins across it, so the ids of a
    text are those of its parts between ASCII white space, in order.  A plain
    word goes to the vocabulary's merges directly; any other part is encoded in
    full, and so is a text that may hold a special token.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        # What is in a word's way from text to merges; only this one is known to be safe.
        self.direct = '"Lowercase"' in self.whole.to_str() and '"end_of_word_suffix":"</w>"' in self.whole.to_str()

    def encode(self, part: str) -> bytes:
        return np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, core: bytes) -> bytes:
        letters = core.decode()
        if not core.isascii():
            letters = letters.lower().encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.merges.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, part: bytes) -> bytes:
        plain = _PLAIN.fullmatch(part) if self.direct else None
        if plain is None:
            ids = self.encode(part.decode())
        else:
            core, tail = plain.groups()
            ids = self.known.get(core) if tail else None
            if ids is None:
                ids = self.word(core)
            if tail:
                end = self.known.get(tail)
                if end is None:
                    end = self.known[tail] = self.encode(tail.decode())
                ids += end
        if len(part) <= 64:
            self.known[part] = ids
        return ids

    def __call__(self, text: bytes) -> bytes:
        if b"<|" in text or not self.direct:
            return self.encode(text.decode())
        words = text.lower().split()
        get = self.known.get
        found = [get(w) for w in words]
        if None in found:
            learn = self.learn
            found = [f if f is not None else get(w) or learn(w) for f, w in zip(found, words, strict=True)]
            if len(self.known) > MEMORY_WORDS:
                self.known.clear()
        return b"".join(found)


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


class BestFit:
    """Bounded-space best fit; ``place`` returns (bin, offset) of a piece."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free_bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = self.bins = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
            self.opened -= 1
        else:
            if self.opened == self.limit:  # the fullest open bin has the least free space
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.opened -= 1
            free, found = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            self.by_free[left].append(found)
            self.free_bits |= 1 << left
            self.opened += 1
        return found, self.capacity - free


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    path: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    path = path or tokenizer_path()
    end = np.array([end_id], "<u4").tobytes()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(own("text")))
    id_type = source.schema[id_col].dataType
    fields = [
        T.StructField(id_col, id_type),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path)
        step = 4 * capacity
        for batch in slices(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(text_bytes(batch.column(1))):
                data = encode(text or b"") + end
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    rows.append(row)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        encode.known = {}  # workers outlive their tasks

    return source.mapInArrow(run, T.StructType(fields))


def pack(
    pieces: DataFrame,
    *,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    group_pieces: int = GROUP_PIECES,
    run_pieces: int = RUN_PIECES,
    order: tuple[str, ...] = ("piece", "start", "ids_crc32"),
) -> DataFrame:
    """``pieces`` with sequence_id and offset; lengths must be 1 to ``capacity``.

    The pieces are cut first, so that a lost executor costs no second
    tokenization and the number of groups follows the number of pieces.  Groups
    hold descriptors only, one group a task; ids join them by a row number that
    is written with the pieces.
    """
    dealt = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    keys = [n for n in dealt if n != "ids"]
    row, group_, mark, ties = own("row"), own("group"), own("mark"), [F.col(c) for c in order if c in dealt]
    stable = cut(pieces.select(*dealt, F.monotonically_increasing_id().alias(row)))
    n = stable.count()
    groups = max(1, ceil(n / group_pieces))
    runs = max(1, ceil(n / groups / run_pieces))
    narrow = stable.select(*keys, row)
    schema = T.StructType(
        [*narrow.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    marked = narrow.withColumn(mark, F.xxhash64(*[F.col(c) for c in keys], F.col(row)))  # the row number parts rows that repeat
    at_group = marked.withColumn(group_, F.pmod(F.xxhash64(F.col(mark)), F.lit(groups)).cast("int"))
    ordered = at_group.repartitionById(groups, F.col(group_)).sortWithinPartitions(
        F.col(group_), F.pmod(F.xxhash64(F.col(mark), F.lit(3)), F.lit(runs)), F.desc("length"), F.col(mark), *ties
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, packer = None, None
        for batch in batches:
            groups_, lengths = batch.column(batch.schema.get_field_index(group_)).to_pylist(), batch.column(batch.schema.get_field_index("length")).to_pylist()
            sequence, offset = [], []
            for g, n in zip(groups_, lengths, strict=True):
                if g != group:
                    group, packer = g, BestFit(capacity, open_bins)
                bin_, at = packer.place(n)
                sequence.append((g << 40) | bin_)
                offset.append(at)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in [*keys, row]]
            columns += [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    placed = ordered.mapInArrow(run, schema)
    if "ids" in dealt:
        placed = stable.join(placed.select(row, "sequence_id", "offset"), row)
    return placed.select(*dealt, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed training sequences: sequence_id and its ids in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), keep_ids=False))
