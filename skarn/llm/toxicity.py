"""Counterfactual-regularised toxicity classifier.

A linear model over hashed word features (the word and its 4- to 7-letter
beginnings) scores every window: a sentence, or each run of ``WINDOW`` consecutive
words of a longer one.  A document scores as its worst window, so that long clean
texts do not dilute one insult and clean documents stay low.

Training, on a bounded sample of labelled documents: smoothed document
frequencies over their whole texts give starting weights; windows of clean
documents are negatives, and of each toxic document the window that the current
model finds worst is a positive (multiple-instance learning).  For every training
window that names a group, and for neutral template sentences, the identity term
is swapped for each other one of its list; the squared change of the logit is
penalised, so a term that goes with toxic labels in the sample does not make
neutral mentions of that group toxic.

Bounds, all parameters: at most ``max_docs`` labelled documents of each label are
used, those of the smallest hash of the id.  Their whole texts are read; of each
the ``max_windows`` windows that the starting weights find worst are fitted, by
tasks cut out and hashed, so the driver gets features of a bounded size and one
score a document, never texts.  Scoring reads whole texts.

Defined cases: null and empty texts score as a text without features (low); null
labels, other labels than 0 and 1 and null ids teach nothing; an id labelled both
0 and 1 counts as 1; of several texts of one id the smallest is used; a table
without both labels, or without labels, gives the model's base rate; repeated rows
score alike; columns named score and predicted are replaced by ``score`` and kept
by ``remove_toxic``, other extra columns are carried through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, own, table, text_bytes, with_batches

MAX_DOCS = 2500
MAX_WINDOWS = 64
THRESHOLD = 0.7
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7)
SWAP_WEIGHT = 1.0
MEMORY_WORDS = 400_000
#: Consecutive words of a long sentence that are scored together, at every place.
WINDOW = 48
#: The step of features that swaps change.
SWAP_RATE = 0.3
#: Features that one step of the training's sums works on.
PART = 1 << 20

#: Group terms that are swapped for one another; a parameter, by language.
IDENTITY_TERMS = {
    "en": "women men muslims christians jews hindus immigrants refugees gay lesbian transgender black white asian disabled".split(),
    "fr": "femmes hommes musulmans chrétiens juifs immigrés réfugiés homosexuels noirs blancs handicapés".split(),
    "de": "frauen männer muslime christen juden einwanderer flüchtlinge homosexuelle schwarze weiße behinderte".split(),
    "es": "mujeres hombres musulmanes cristianos judíos inmigrantes refugiados homosexuales negros blancos discapacitados".split(),
}
#: Neutral mentions, label 0, of which every swap is a training pair.
TEMPLATES = {
    "en": ["we met some {} people at the market", "the {} in our town vote in may"],
    "fr": ["nous avons rencontré des {} au marché", "les {} de la ville votent en mai"],
    "de": ["wir trafen die {} auf dem markt", "die {} der stadt wählen im mai"],
    "es": ["vimos a los {} en el mercado", "los {} de la ciudad votan en mayo"],
}

#: Sentence ends to line feeds, other ASCII but letters, digits and ' to blanks.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b == 0x27 else b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".!?\n" else 0x20
    for b in range(256)
)


def sentences(text: bytes | None) -> list[list[bytes]]:
    """The words of every sentence."""
    return [words for x in (text or b"").translate(_FOLD).split(b"\n") if (words := x.split())]


def windows(text: bytes | None) -> list[set[bytes]]:
    """The distinct words of every sentence, of long ones those of runs that overlap by half."""
    out = []
    for words in sentences(text):
        starts = range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2) if len(words) > WINDOW else (0,)
        out += [set(words[i : i + WINDOW]) for i in starts]
    return out


def word_features(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings."""
    import xxhash

    letters = word.decode(errors="replace")
    out = [xxhash.xxh3_64_intdigest(b"w" + word) % BUCKETS]
    for n in PREFIXES:
        if len(letters) >= n:
            out.append(xxhash.xxh3_64_intdigest(b"p%d" % n + letters[:n].encode()) % BUCKETS)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logit(self, text: bytes | None, known: dict[bytes, float]) -> float:
        best = 0.0
        for words in sentences(text):
            for w in set(words).difference(known):
                known[w] = float(self.weights[word_features(w)].sum())
            best = max(best, sum(map(known.__getitem__, set(words))) if len(words) <= WINDOW else _worst_run(words, known))
        if len(known) > MEMORY_WORDS:
            known.clear()
        return best + self.bias


def _worst_run(words: list[bytes], weight: dict[bytes, float]) -> float:
    """The largest sum of the distinct words of WINDOW consecutive ones."""
    held: dict[bytes, int] = {}
    total, best = 0.0, -np.inf
    for i, w in enumerate(words):
        held[w] = held.get(w, 0) + 1
        if held[w] == 1:
            total += weight[w]
        if i >= WINDOW:
            gone = words[i - WINDOW]
            held[gone] -= 1
            if not held[gone]:
                total -= weight[gone]
        if i >= WINDOW - 1:
            best = max(best, total)
    return best


@dataclass
class Example:
    """What training takes of a labelled document."""

    flat: np.ndarray  # features of the worst windows, one after the other
    ends: np.ndarray  # where each window ends
    swaps: list[tuple[str, str | None, float]]


def swaps(window: set[bytes], terms: dict[str, list[str]]) -> list[tuple[str, str | None, float]]:
    """Each identity term of a window with each other one of its list (None: it is there too), and their share."""
    out = []
    for group in terms.values():
        names = [t.encode() for t in group]
        for w in sorted(window.intersection(names)):
            others = [t for t in names if t != w]
            out += [(w.decode(), None if t in window else t.decode(), 1 / len(others)) for t in others]
    return out


def example(text: bytes | None, start: np.ndarray | None, terms: dict[str, list[str]], max_windows: int, known: dict[bytes, tuple]) -> Example:
    """The windows that the weights ``start`` find worst, and the swaps of all windows."""
    every, found = windows(text) or [set()], Counter()
    for w in set().union(*every).difference(known):
        features = word_features(w)
        known[w] = (features, 0.0 if start is None else float(start[features].sum()))
    if len(every) > max_windows:
        worth = [sum(known[w][1] for w in x) for x in every]
        used = sorted(sorted(range(len(every)), key=lambda i: (-worth[i], i))[:max_windows])
    else:
        used = range(len(every))
    flat, ends = [], []
    for i in used:
        for word in sorted(every[i]):
            flat += known[word][0]
        ends.append(len(flat))
    for window in every:
        for one, other, share in swaps(window, terms):
            found[one, other] += share
    if len(known) > MEMORY_WORDS // 8:
        known.clear()
    return Example(np.array(flat, np.int32), np.array(ends, np.int32), [(*pair, n) for pair, n in found.items()])


def document_features(text: bytes | None) -> np.ndarray:
    """The distinct features of a whole text."""
    words = set((text or b"").translate(_FOLD).split())
    return np.unique(np.array([f for w in words for f in word_features(w)], np.int64))


def starting_weights(per: np.ndarray, n_docs: np.ndarray, min_docs: int = 3, prior_docs: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log odds of the features by their document counts, and which are usable."""
    odds = np.log((per[1] + 0.5) / (n_docs[1] + 1)) - np.log((per[0] + 0.5) / (n_docs[0] + 1))
    # Few toxic documents are weak evidence; features of fewer than min_docs get no weight.
    usable = per[0] + per[1] >= min_docs
    return np.where(usable, np.clip(odds, -1, 6) * (per[1] + 0.5) / (per[1] + prior_docs), 0.0), usable


class _Rows:
    """Feature lists of sentences; their sums are made part by part."""

    def __init__(self, examples: list[Example]):
        lengths = [np.diff(e.ends, prepend=0) for e in examples]
        self.n = sum(map(len, lengths))
        self.flat = np.concatenate([np.zeros(0, np.int32), *[e.flat for e in examples]])
        self.at = np.repeat(np.arange(self.n, dtype=np.int32), np.concatenate([np.zeros(0, np.int64), *lengths]))
        self.cuts = [*range(0, len(self.flat), PART), len(self.flat)]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, j in pairwise(self.cuts):
            low = int(self.at[i])
            part = np.bincount(self.at[i:j] - low, weights[self.flat[i:j]])
            out[low : low + len(part)] += part
        return out

    def gradient(self, error: np.ndarray) -> np.ndarray:
        out = np.zeros(BUCKETS)
        for i, j in pairwise(self.cuts):
            out += np.bincount(self.flat[i:j], error[self.at[i:j]], minlength=BUCKETS)
        return out


def _base_rate(y: np.ndarray) -> Model:
    rate = (y.sum() + 1) / (len(y) + 10) if len(y) else 0.1
    return Model(np.zeros(BUCKETS), float(np.log(rate / (1 - rate))))


def _one_label(y: np.ndarray) -> bool:
    return not len(y) or y.min() == y.max()


def fit_examples(
    examples: list[Example],
    y_doc: np.ndarray,
    terms: dict[str, list[str]],
    weights: np.ndarray,
    usable: np.ndarray,
    *,
    rounds: int = 3,
    steps: int = 30,
    l2: float = 3e-5,
    rate: float = 0.05,
    swap_weight: float = SWAP_WEIGHT,
) -> Model:
    """The weights, from the starting ones and before ``_calibrated``; both labels must occur."""
    # Only the swapped words differ in a pair, so equal swaps are one row with a count.
    pairs = Counter()
    for e in examples:
        for one, other, n in e.swaps:
            pairs[(one,), () if other is None else (other,)] += n
    sizes = np.array([len(e.ends) for e in examples])
    owner_, n_doc_rows = np.repeat(np.arange(len(examples)), sizes), int(sizes.sum())
    neutral, known = [], {}
    for lang, group in terms.items():
        for template in TEMPLATES.get(lang, []):
            neutral += [example(template.format(t).encode(), None, {}, 1, known) for t in group]
            pairs.update({((x,), (z,)): 1 / max(1, len(group) - 1) for x in group for z in group if x != z})
    changes = [_Rows([_of_words(pair[side]) for pair in pairs]) for side in (0, 1)]
    times, n_pairs = np.array(list(pairs.values()), np.float64), sum(pairs.values())
    rows = _Rows([*examples, *neutral])
    n_rows = rows.n
    weights, bias = weights.copy(), -4.0
    # Swapped features move as far as the penalty asks, also from a start far off.
    swapped = np.zeros(BUCKETS, bool)
    for side in changes:
        swapped[side.flat] = True
    toxic_row = y_doc[owner_] == 1
    starts = np.cumsum(sizes) - sizes
    grad2 = np.full(BUCKETS, 1e-8)
    grad2_bias = 1e-8
    for _ in range(rounds):
        logit = rows.sums(weights) + bias
        # The worst window of each toxic document, and those almost as bad.
        top = np.maximum.reduceat(logit[:n_doc_rows], starts)
        worst = logit[:n_doc_rows] >= top[owner_] - 1e-9
        used = np.ones(n_rows, bool)
        used[:n_doc_rows] = ~toxic_row | worst
        y = np.zeros(n_rows)
        y[:n_doc_rows] = toxic_row & worst
        importance = np.where(y == 1, 1.0 / max(1, (y == 1).sum()), 1.0 / max(1, ((y == 0) & used).sum())) * used
        for _ in range(steps):
            z = rows.sums(weights) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * importance
            grad = rows.gradient(error) + l2 * weights
            if n_pairs:
                pull = 2 * swap_weight * (changes[0].sums(weights) - changes[1].sums(weights)) * times / n_pairs
                grad += changes[0].gradient(pull) - changes[1].gradient(pull)
            grad2 += grad * grad
            weights = weights - np.where(swapped, SWAP_RATE, rate) * usable * grad / np.sqrt(grad2)
            bias_grad = error.sum()
            grad2_bias += bias_grad * bias_grad
            bias -= rate * bias_grad / np.sqrt(grad2_bias)
    return Model(weights, float(bias))


def _of_words(words: tuple[str, ...]) -> Example:
    flat = [f for w in words for f in word_features(w.encode())]
    return Example(np.array(flat, np.int32), np.array([len(flat)], np.int32), [])


def fit(
    texts: list[bytes],
    labels: list[int],
    *,
    terms: dict[str, list[str]] | None = None,
    max_windows: int = MAX_WINDOWS,
    min_docs: int = 3,
    **options,
) -> Model:
    """A model of texts at hand; ``train`` is the form for tables."""
    terms = IDENTITY_TERMS if terms is None else terms
    y, known, sums = np.array(labels, np.int64), {}, {}
    if _one_label(y):
        return _base_rate(y)
    per = np.zeros((2, BUCKETS))
    for t, c in zip(texts, labels, strict=True):
        per[c, document_features(t)] += 1
    weights, usable = starting_weights(per, np.bincount(y, minlength=2), min_docs)
    examples = [example(t, weights, terms, max_windows, known) for t in texts]
    model = fit_examples(examples, y, terms, weights, usable, **options)
    return _calibrated(model, np.array([model.logit(t, sums) for t in texts]), y)


def _calibrated(model: Model, z: np.ndarray, y: np.ndarray) -> Model:
    """Scale and shift so that THRESHOLD lies between the labels as well as it can."""
    order = np.sort(z)
    middles = np.concatenate(([order[0] - 1], (order[1:] + order[:-1]) / 2))
    clean, toxic = np.sort(z[y == 0]), np.sort(z[y == 1])
    # Balanced by label; a false alarm counts five times: clean documents are to be kept.
    lost = np.searchsorted(toxic, middles) / len(toxic) + 5 * (len(clean) - np.searchsorted(clean, middles)) / len(clean)
    best = np.flatnonzero(lost <= lost.min() + 1e-12)
    cut_at = float((middles[best[0]] + middles[best[-1]]) / 2)
    scale = 4.0 / max(1e-6, float(np.median(toxic)) - cut_at)
    at_threshold = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return Model(model.weights * scale, (model.bias - cut_at) * scale + at_threshold)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_docs: int, held_out: Column | None) -> DataFrame:
    """(id, toxic, t): at most ``max_docs`` documents of each label, by hash of the id."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias(own("id")), F.col("toxic").cast("int").alias("toxic"))
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.groupBy(own("id")).agg(F.max("toxic").alias("toxic"))
    # One task's smallest hashes, then the smallest of these: nothing is gathered.
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64(own("id")), own("id")).limit(max_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias(own("id")), F.col(text_col).alias(own("t"))).filter(F.col(own("t")).isNotNull())
    met = texts.join(F.broadcast(chosen), own("id"))  # 2 * max_docs ids at most
    return met.groupBy(own("id"), "toxic").agg(F.min(own("t")).alias(own("t")))


def _document_counts(chosen: DataFrame) -> np.ndarray:
    """Documents of each label by feature, counted by tasks over whole texts."""
    names = ["toxic", "feature", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                per[label, document_features(text)] += 1
        label, feature = np.nonzero(per)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(feature), pa.array(per[label, feature])], names)

    summed = chosen.select("toxic", own("t")).mapInArrow(run, "toxic long, feature long, n long").groupBy("toxic", "feature").agg(F.sum("n").alias("n"))
    got, out = summed.toArrow(), np.zeros((2, BUCKETS))  # 2 * BUCKETS rows at most
    out[got["toxic"].to_numpy(), got["feature"].to_numpy()] = got["n"].to_numpy()
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    max_docs: int = MAX_DOCS,
    held_out: Column | None = None,
    terms: dict[str, list[str]] | None = None,
    max_windows: int = MAX_WINDOWS,
    min_docs: int = 3,
    **options,
) -> Model:
    terms = IDENTITY_TERMS if terms is None else terms
    # Written once: it is read for the counts, for the examples and for the scores.
    chosen = cut(training_rows(docs, labels, id_col, text_col, max_docs, held_out))
    y = np.array([r[0] for r in chosen.select("toxic").collect()], np.int64)
    if _one_label(y):
        return _base_rate(y)
    weights, usable = starting_weights(_document_counts(chosen), np.bincount(y, minlength=2), min_docs)
    start, known = docs.sparkSession.sparkContext.broadcast(weights), {}  # BUCKETS floats

    def compute(batch: pa.RecordBatch) -> dict:
        texts = text_bytes(batch.column(batch.schema.get_field_index(own("t"))))
        found = [example(t, start.value, terms, max_windows, known) for t in texts]
        return {
            "flat": [e.flat.tobytes() for e in found],
            "ends": [e.ends.tobytes() for e in found],
            "swaps": [[{"one": x, "other": z, "n": n} for x, z, n in e.swaps] for e in found],
        }

    pair = T.StructType([T.StructField("one", T.StringType()), T.StructField("other", T.StringType()), T.StructField("n", T.DoubleType())])
    fields = [T.StructField("flat", T.BinaryType()), T.StructField("ends", T.BinaryType()), T.StructField("swaps", T.ArrayType(pair))]
    made = with_batches(chosen, compute, fields, drop=(own("t"),), at_end=known.clear)
    rows = sorted(made.collect(), key=lambda r: r[0])
    y = np.array([r["toxic"] for r in rows], np.int64)
    examples = [Example(np.frombuffer(r["flat"], np.int32), np.frombuffer(r["ends"], np.int32), [tuple(p) for p in r["swaps"]]) for r in rows]
    del rows
    model = fit_examples(examples, y, terms, weights, usable, **options)
    got = _logits(chosen, model, own("t"), own("z")).select(own("z"), "toxic").collect()
    return _calibrated(model, np.array([r[0] for r in got]), np.array([r[1] for r in got], np.int64))


def _logits(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    known: dict[bytes, float] = {}

    def compute(batch: pa.RecordBatch) -> dict:
        column = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        return {name: pa.array([shared.value.logit(t, known) for t in column], pa.float64())}

    return with_batches(docs, compute, [T.StructField(name, T.DoubleType())])


def score(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats
    known: dict[bytes, float] = {}

    def compute(batch: pa.RecordBatch) -> dict:
        column = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        z = np.array([shared.value.logit(t, known) for t in column])
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= threshold).astype(np.int32), pa.int32())}

    return with_batches(docs, compute, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def remove_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with their own columns."""
    names = {c: own("c_" + c) if c in ("score", "predicted") else c for c in docs.columns}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    kept = score(renamed, model, names[text_col]).filter(F.col("predicted") == 0)
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def held_out_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), held_out=held_out_of(own("id")))
    return score(docs, model).select("doc_id", F.coalesce(held_out_of("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
