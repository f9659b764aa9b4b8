"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of a bounded sample of
its labelled texts.  Texts are reduced to their lower-cased words (digits and
signs to blanks) and cut into chunks; every chunk of the whole text is compressed
with every dictionary, at one level for all, and the language with the smallest
total wins.  Where the margin to the second is narrow the prediction is marked as
rejected.

Bounds, all parameters: a dictionary holds at most ``dict_bytes`` bytes and all
dictionaries ``total_bytes`` (more languages share it evenly), taken from the
labelled documents of the smallest hash of the id, at most ``doc_bytes`` from each
(a slice that starts at a hashed place, so that a few long texts do not fill a
dictionary).  Prediction reads whole texts and knows every language that has a
labelled word; more than ``MAX_LANGUAGES`` of them are an error, as a column of
that many values is no language column.

Defined cases: a null text or one without a letter is ``und`` with score 0; null
languages teach nothing, nor do texts without a word; with no labelled text
everything is ``und``; ties go to the language with most labels, then to the
smaller name; a language of one labelled text keeps it whole; repeated rows are
judged alike; a text that is shorter than any margin is still given its smallest
language, marked rejected; columns named lang_pred, score and rejected are
replaced, other extra columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, table, text_bytes, with_batches

DICT_BYTES = 48 * 1024
TOTAL_BYTES = 16 << 20
DOC_BYTES = 1024
CHUNK = 1024
LEVEL = 6
#: Rejected: the smallest total is less than this share below the second.
MARGIN = 0.02
#: Languages in the labels beyond which learning raises an error.
MAX_LANGUAGES = 10_000
UNKNOWN = "und"


def learn_dictionaries(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    dict_bytes: int = DICT_BYTES,
    total_bytes: int = TOTAL_BYTES,
    doc_bytes: int = DOC_BYTES,
) -> dict[str, bytes]:
    """Raw dictionary contents by language, in order of the number of labels; the
    driver holds a few times ``total_bytes``."""
    lang, text = F.col(lang_col).cast("string").alias("lang"), F.col(text_col)
    rows = docs.filter(F.col(lang_col).isNotNull() & text.isNotNull() & (F.length(text) > 0))
    per_lang = max(1, dict_bytes // doc_bytes)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    mark = F.xxhash64(key, F.lit(5))
    start = F.pmod(F.xxhash64(key, F.lit(7)), F.greatest(F.lit(1), F.length(text) - doc_bytes // 2)).cast("int") + 1
    # The smallest hash in each of some buckets: sums of longs on the map side,
    # however many documents a language has; then the texts of just those rows.
    bucket = F.pmod(F.xxhash64(key, F.lit(9)), F.lit(per_lang * 2))
    marked = rows.select(lang, bucket.alias("b"), mark.alias("m"), F.substring(text, start, F.lit(doc_bytes)).alias("t"))
    smallest = cut(marked.groupBy("lang", "b").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("n")))
    named = smallest.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(named) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} values")
    size = min(dict_bytes, total_bytes // max(1, len(named)))
    wanted = smallest.orderBy("lang", "m").select("lang", "b", "m")
    if size < dict_bytes:  # many languages: fewer documents of each
        first = Window.partitionBy("lang").orderBy("m")  # 2 * per_lang rows a language
        wanted = wanted.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= max(1, 2 * size // doc_bytes)).drop("r")
    # A language has at most 2 * per_lang rows of 20 bytes here.
    chosen = marked.join(F.broadcast(wanted), ["lang", "b", "m"]).groupBy("lang", "m").agg(F.min("t").alias("t")).collect()
    parts: dict[str, list] = {}
    for name, m, t in chosen:
        parts.setdefault(name, []).append((m, t))
    # In order of the number of labels, which decides ties.
    samples = {r["lang"]: [t for _, t in sorted(parts.get(r["lang"], []))] for r in named}
    made = _own_lines(docs.sparkSession, samples)
    return {name: content[-size:] for name, content in made.items() if content}


def _own_lines(spark: SparkSession, samples: dict[str, list[str]]) -> dict[str, bytes]:
    """The contents without lines that another language's texts compress better.

    Passages in a foreign language would otherwise stand for the language of the
    document that holds them.  One half of the texts judges the other's lines, on
    the executors; a language without texts in the judging half keeps its lines.
    """
    folded = {name: [[words_only(x.encode()) for x in t.split("\n")] for t in texts] for name, texts in samples.items()}
    kept: dict[str, list[tuple[int, bytes]]] = {name: [] for name in samples}
    for h in (0, 1):
        judges = {name: b" ".join(x for t in texts[1 - h :: 2] for x in t) for name, texts in folded.items()}
        rows = [(name, n, b"\n".join(x for x in t if x)) for name, texts in folded.items() for n, t in enumerate(texts) if n % 2 == h]
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(judges)  # half of the samples

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            compressors = Compressors(shared.value)
            for batch in batches:
                out = []
                for name, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    lines = [x for x in text.split(b"\n") if x]
                    if name in compressors.names:
                        at = compressors.names.index(name)
                        totals = [compressors.totals(x, CHUNK) for x in lines]
                        lines = [x for x, t in zip(lines, totals, strict=True) if t[at] <= t.min() * 1.02]
                    out.append(b" ".join(lines))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["name", "n", "t"])

        table_ = spark.createDataFrame(rows, "name string, n int, t binary").repartition(max(1, min(len(rows) // 32, 256)))
        for name, n, t in table_.mapInArrow(judge, "name string, n int, t binary").collect():
            kept[name].append((n, bytes(t)))
        shared.unpersist()
    # The halves as they were judged, the even texts first.
    return {name: b" ".join(t for n, t in sorted(texts, key=lambda x: (x[0] % 2, x[0])) if t) for name, texts in kept.items()}


_FOLD = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_only(text: bytes) -> bytes:
    """Lower-cased, ASCII digits, signs and runs of blanks to one blank."""
    if not text.isascii():
        text = text.decode().lower().encode()
    return b" ".join(text.translate(_FOLD).split())


class Compressors:
    """Compressors by language, built once in a worker; empty contents have none."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        used = {name: content for name, content in contents.items() if content}
        self.names = list(used)
        self.compressors = [self._one(c, level) for c in used.values()]

    @staticmethod
    def _one(content: bytes, level: int):
        import zstandard

        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def totals(self, text: bytes, chunk: int) -> np.ndarray:
        words = words_only(text)
        out = [0] * len(self.compressors)
        for at in range(0, len(words), chunk):
            part = words[at : at + chunk]
            for i, compress in enumerate(self.compressors):
                out[i] += len(compress(part))
        return np.array(out)


def has_letter(text: bytes) -> bool:
    if text.upper() != text.lower():  # an ASCII letter
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode())


def identify(
    docs: DataFrame,
    contents: dict[str, bytes],
    text_col: str = "text",
    *,
    chunk: int = CHUNK,
    margin: float = MARGIN,
    level: int = LEVEL,
) -> DataFrame:
    """``docs`` with lang_pred, score (how far the second is behind) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(contents)  # bounded by its making
    ready: list[Compressors] = []

    def compute(batch: pa.RecordBatch) -> dict:
        if not ready:
            ready.append(Compressors(shared.value, level))
        names = ready[0].names
        out: dict[str, list] = {"lang_pred": [], "score": [], "rejected": []}
        for text in text_bytes(batch.column(batch.schema.get_field_index(text_col))):
            if not names or not text or not has_letter(text):
                found, score, rejected = UNKNOWN, 0.0, True
            else:
                totals = ready[0].totals(text, chunk)
                order = np.argsort(totals, kind="stable")
                found = names[order[0]]
                behind = 1.0 if len(names) == 1 else float(1 - totals[order[0]] / max(1, totals[order[1]]))
                score, rejected = 1 - 0.5 ** (1 + behind / max(margin, 1e-9)), behind < margin
            out["lang_pred"].append(found)
            out["score"].append(float(score))
            out["rejected"].append(rejected)
        return out

    return with_batches(
        docs,
        compute,
        [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())],
    )


def held_out_of(column: str) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    contents = learn_dictionaries(docs.filter(~held_out_of("doc_id")))
    return identify(docs.select("doc_id", "text"), contents).select("doc_id", held_out_of("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
