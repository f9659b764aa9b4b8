"""MinHash near-dedup, with exact links and distributed connected components.

1. Each text gives its distinct word shingles (64-bit hashes), many universal
   hash minima of them and, from groups of minima, one key per band.  Texts of
   equal shingle sets are one node from here on, named by their smallest id.
2. Within each band bucket every node is compared with the bucket's smallest
   node only (a star, never all pairs): first by their signatures, the minima
   themselves, and where enough of these agree on the full sets; alternating
   large-star and small-star joins what is linked.
3. A bucket whose nodes still lie in several components may hold links that no
   star has seen.  Its nodes meet in the group of its smallest component, where
   tasks compare the full sets of nodes of different components, block by block,
   and give back a spanning forest of the links found.  So no link between two
   texts that share a band is lost, and no task holds more than one block pair.

With 26 bands of 5 rows a pair of similarity 0.85 shares no band with probability
2.4e-7, one of 0.9 with 1e-10.  A pair goes on from its signatures when the share
of equal minima is at most ``SLACK`` under the similarity asked for; of 130
minima of a pair of similarity 0.85 fewer agree with probability 1.1e-12.  A star
pair that is lost so is met again in step 3, which compares full sets only.

Skew: sets and edge ends that very many rows name are broadcast, in a number that
a bound on their rows keeps under ``MAX_HOT``; the full set of a node that is the
centre of very many pairs is dealt to several parts of them.

Defined cases: a null text or one without words has an empty set, is linked with
nothing and is kept; a row without an id takes no part and is kept; repeated
rows are copies of each other, the row of the smallest id counts as the original
and of rows with the same id and set all are kept by the digest query and one by
``remove_near_duplicates``; rows of one id with different sets are judged each
by its own set, and the digest names them all by that id; extra columns are
carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, own, release, table, text_bytes, with_batches

SHINGLE = 5
BANDS, ROWS = 26, 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Nodes of one block of a group, of those asked and of those compared with.
BLOCK = 8192
#: Shingles of all sets of one block, 8 bytes each.
BLOCK_SHINGLES = 8 << 20
#: A pair's share of equal minima may lie so far under the similarity.
SLACK = 0.25
#: Rows that name one key from which on it is hot, and hot keys at most.
HOT_ROWS, MAX_HOT = 4096, 500_000
#: Groups of several blocks that are broadcast (16 bytes each); more are joined by a shuffle.
MAX_LARGE = 500_000
MEMORY_WORDS = 400_000

_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _word_codes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        import xxhash

        if len(_words) > MEMORY_WORDS:
            _words.clear()
        for w in set(words):
            if w not in _words:
                _words[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _forget() -> None:
    _words.clear()


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = _word_codes(words)
    size_ = min(size, len(codes))
    n = len(codes) - size_ + 1
    with np.errstate(over="ignore"):
        out = codes[:n].copy()
        for i in range(1, size_):
            out = _mix(out + np.uint64(i)) + codes[i : i + n] * np.uint64(0x9E3779B97F4A7C15)
        out = _mix(out + np.uint64(size_))
    return np.unique(out)


def set_name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import xxhash

    x, y = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8")
    return int(x), int(y)


def _universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240613)
    return rng.integers(0, 2**64, n, np.uint64) | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of a * x + b (the top 32 bits) over the set, for each a and b."""
    out = np.full(len(a), np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):  # long texts in bounded memory
            part = (a[:, None] * shingles[None, at : at + 4096] + b[:, None]).min(axis=1)
            out = np.minimum(out, part)
    return out >> np.uint64(32)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for column in rows.T:
        key = _mix(key ^ column)
    return key


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(id, t, s, n_shingles, x, y, bands): t and s name the text, x and y its set, bands are its bucket keys."""
    a, b = _universal(bands * rows)

    def compute(batch: pa.RecordBatch) -> dict:
        n, x, y, keys = [], [], [], []
        for text in text_bytes(batch.column(batch.schema.get_field_index(own("text")))):
            found = shingle_set(text, shingle)
            n.append(len(found))
            name = set_name(found)
            x.append(name[0])
            y.append(name[1])
            keys.append(band_keys(minima(found, a, b), bands).view(np.int64) if len(found) else None)
        return {"n_shingles": n, own("x"): x, own("y"): y, own("bands"): keys}

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias(own("id")), text.alias(own("text")), *[F.xxhash64(F.lit(n), text).alias(own(c)) for n, c in enumerate("ts")])
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField(own("x"), T.LongType()), T.StructField(own("y"), T.LongType())]
    return with_batches(narrow, compute, [*fields, T.StructField(own("bands"), T.ArrayType(T.LongType()))], drop=(own("text"),), at_end=_forget)


# --- skew -------------------------------------------------------------------


def hot_limit(rows: int) -> int:
    """Rows from which on a key is hot: fewer than MAX_HOT keys can be."""
    return max(HOT_ROWS, -(-rows // MAX_HOT))


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique and whose ``n_left`` counts the rows of ``left``.

    Hot keys are broadcast, at most MAX_HOT rows; all others are shuffled.
    """
    names = [c for c in right.columns if c not in (*on, "n_left")]
    hot, cold = F.col("n_left") > hot_limit(rows), F.col("n_left") <= hot_limit(rows)
    few = F.broadcast(right.filter(hot).select(*on, *names, F.lit(True).alias(own("hot"))))
    tried = left.join(few, on, "left")
    most = tried.filter(F.col(own("hot")).isNull()).drop(*names, own("hot")).join(right.filter(cold).drop("n_left"), on, how)
    return tried.filter(F.col(own("hot"))).drop(own("hot")).unionByName(most)


# --- connected components ---------------------------------------------------


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Larger neighbours of each node are linked with its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n_left"))
    return join_hot(both, low, ["u"], "inner", 2 * rows).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and itself, are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own_ = low.select("u", F.col("m").alias("v"))
    return linked.unionByName(own_).filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the smallest node reachable.

    Large-star and small-star alternate until nothing changes; every round is
    cut in the checkpoint folder, so neither the lineage nor the driver grows.
    """
    now = cut(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state[0]:
        now = cut(_small_star(_large_star(now, state[0])))
        release(edges.sparkSession)
        state, before = _state(now), state
        if state == before:
            break
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


# --- links --------------------------------------------------------------------


def _sets_of(docs: DataFrame, nodes: DataFrame, repeats: bool, id_col: str, text_col: str, shingle: int, minima_: int) -> DataFrame:
    """(node, set, sig) of the wanted nodes (node, first, x, y), from the texts of the id ``first``.

    ``repeats``: an id may have several texts, of which the one of x and y is meant.
    """
    a, b = _universal(minima_)

    def compute(batch: pa.RecordBatch) -> dict:
        found = [shingle_set(t, shingle) for t in text_bytes(batch.column(batch.schema.get_field_index(own("t"))))]
        names = [set_name(s) for s in found]
        sig = [minima(s, a, b).astype(np.uint32).view(np.int32) for s in found]
        return {"set": [s.view(np.int64) for s in found], "sig": sig, own("x"): [n[0] for n in names], own("y"): [n[1] for n in names]}

    fields = [T.StructField("set", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.IntegerType())), T.StructField(own("x"), T.LongType()), T.StructField(own("y"), T.LongType())]
    texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).cast("string").alias(own("t")))
    wanted = texts.join(nodes.select("first").distinct(), "first", "left_semi")
    made = with_batches(wanted, compute, fields, drop=(own("t"),), at_end=_forget)
    if not repeats:  # an id has one text
        return made.select(F.col("first").alias("node"), "set", "sig").dropDuplicates(["node"])
    return made.drop("first").dropDuplicates([own("x"), own("y")]).join(nodes.select("node", own("x"), own("y")), [own("x"), own("y")]).select("node", "set", "sig")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that meet the similarity, by their signatures and then by their full sets.

    What belongs to a ``u`` of very many pairs is dealt to several parts of them.
    """
    pairs = cut(pairs)
    limit = hot_limit(pairs.count())
    split = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    split = F.broadcast(split.select("u", F.ceil(F.col("n") / limit).cast("int").alias("parts")))  # MAX_HOT at most
    dealt = pairs.join(split, "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def with_ends(rows: DataFrame, column: str) -> DataFrame:
        of_v = sets.select(F.col("node").alias("v"), F.col(column).alias(own("v")))
        of_u = sets.select(F.col("node").alias("u"), F.col(column).alias(own("u"))).join(split, "u", "left")
        of_u = of_u.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return rows.join(of_v, "v").join(of_u, ["u", "part"])

    equal = F.aggregate(F.zip_with(own("u"), own("v"), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, e: s + e)
    likely = with_ends(dealt, "sig").filter(equal >= (percent / 100 - SLACK) * F.size(own("u"))).select("u", "v", "part")
    both = F.size(F.array_intersect(own("u"), own("v"))).cast("long")
    union = F.size(own("u")) + F.size(own("v")) - both
    return with_ends(likely, "set").filter(100 * both >= percent * union).select("u", "v")


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def links_between(nodes: np.ndarray, component: np.ndarray, sets: list[np.ndarray], asked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the components of a block.

    The shingles index the nodes; one pass over the postings of an asked node
    gives its intersection with every other node at once.
    """
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    holder = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], holder[order]
    edges = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True]))) if len(tokens) else np.zeros(1, np.int64)
    distinct = tokens[edges[:-1]] if len(tokens) else tokens
    forest, out = _Forest(), []
    for i in np.flatnonzero(asked).tolist():
        at = np.searchsorted(distinct, sets[i])
        lows, highs = edges[at], edges[at + 1]
        counts = highs - lows
        several = counts > 1
        if not several.any():
            continue
        counts, lows = counts[several], lows[several]
        index = np.arange(counts.sum()) + np.repeat(lows - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
        both = np.bincount(holder[index], minlength=len(sets))
        linked = np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (component != component[i]))
        for j in linked.tolist():
            if forest.join(int(component[i]), int(component[j])):
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _remaining(buckets: DataFrame, components: DataFrame, sets: DataFrame, weights: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (u, v) between components that still share a bucket; ``weights`` has the shingles w of a node."""
    placed = buckets.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    torn = placed.groupBy("key").agg(F.min("component").alias("group"), F.max("component").alias("high"))
    torn = torn.filter(F.col("group") != F.col("high")).select("key", "group")
    members = cut(placed.join(torn, "key").select("group", "node", "component").distinct().join(weights, "node").select("group", "node", "w", "component"))
    asked = F.col("component") != F.col("group")
    # Only groups of more than one block, by nodes or by shingles, are dealt.
    n_blocks = lambda n, w: F.ceil(F.greatest(F.lit(1), F.col(n) / F.lit(block), F.col(w) / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = members.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.count_if(asked).alias("n_asked"), F.sum(F.when(asked, F.col("w")).otherwise(0)).alias("w_asked")
    )
    large = sizes.filter((F.col("n") > block) | (F.col("w") > BLOCK_SHINGLES)).select("group", n_blocks("n", "w").alias("ab"), n_blocks("n_asked", "w_asked").alias("qb"))
    total = members.agg(F.count(F.lit(1)), F.sum("w")).first()
    if total[0] <= block * MAX_LARGE and (total[1] or 0) <= BLOCK_SHINGLES * MAX_LARGE:
        large = F.broadcast(large)
    dealt = members.join(large, "group", "left").fillna(1, ["ab", "qb"])
    mine = F.pmod(F.xxhash64("node"), F.col("ab")).cast("int")
    my_q = F.pmod(F.xxhash64("node", F.lit(1)), F.col("qb")).cast("int")
    to_all = dealt.select("group", "node", "component", mine.alias("a"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("asked"))
    to_ask = dealt.filter(asked).select("group", "node", "component", F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("a"), my_q.alias("q"), F.lit(True).alias("asked"))
    rows = to_all.unionByName(to_ask).groupBy("group", "a", "q", "node", "component").agg(F.bool_or("asked").alias("asked"))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sets_ = [np.asarray(s, np.int64) for s in pdf["set"]]
        found = links_between(pdf["node"].to_numpy(), pdf["component"].to_numpy(), sets_, pdf["asked"].to_numpy(), percent)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return rows.join(sets, "node").groupBy("group", "a", "q").applyInPandas(links, "u long, v long")


def _reps(named: DataFrame) -> tuple[DataFrame, bool]:
    """(x, y, first, node, bands, w, n_left), a row a set: its smallest id and its node.

    The node is the smallest id.  Where one id has several sets (the second value
    tells) such sets are numbered by a hash of theirs, salted until all differ.
    """
    sets = named.groupBy(own("x"), own("y")).agg(
        F.min(own("id")).alias("first"), F.first(own("bands")).alias(own("bands")), F.first("n_shingles").alias("w"), F.count(F.lit(1)).alias("n_left")
    )
    sets = cut(sets)
    several = sets.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("first", F.lit(True).alias("clash"))
    if several.isEmpty():
        return sets.withColumn("node", F.col("first")), False
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))
    marked = sets.withColumn("part", F.pmod(F.col(own("x")), F.lit(16).cast("long"))).join(several.withColumn("part", part), ["first", "part"], "left")
    salt = 0
    while True:
        node = F.when(F.col("clash"), F.xxhash64(own("x"), own("y"), F.lit(salt))).otherwise(F.col("first"))
        out = cut(marked.withColumn("node", node).drop("part", "clash"))
        if out.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return out, True
        salt += 1


def _classes(
    docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (x, y, first, component_id, original, n_left), a row a set.

    ``original`` marks one set of each component, that of the smallest id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    signed = cut(signatures(docs, id_col, text_col, bands, rows, shingle))
    reps, clash = _reps(signed.filter(F.col(own("id")).isNotNull() & (F.col("n_shingles") > 0)))
    keyed = reps.select("node", F.explode(own("bands")).alias("key"))  # a set's bands have distinct keys
    low = keyed.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("high")).filter(F.col("u") != F.col("high"))
    buckets = cut(keyed.join(low.select("key", "u"), "key").select("key", "node", "u"))
    stars = buckets.filter(F.col("node") != F.col("u")).select("u", F.col("node").alias("v")).distinct()
    wanted = buckets.select("node").distinct()
    repeats = not signed.groupBy(own("id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col(own("id")).isNotNull() & (F.col("n") > 1)).isEmpty()
    wanted = reps.join(wanted, "node", "left_semi") if repeats else wanted.withColumn("first", F.col("node"))
    sets = cut(_sets_of(docs, wanted, repeats, id_col, text_col, shingle, bands * rows))
    release(docs.sparkSession)
    linked = cut(_confirmed(stars, sets, percent))
    release(docs.sparkSession)
    first = connected_components(linked)
    more = cut(_remaining(buckets.select("key", "node"), first, sets, reps.select("node", "w"), percent, block))
    release(docs.sparkSession)
    every = linked.unionByName(more) if more.take(1) else None
    final = first if every is None else connected_components(every)
    named = reps.select(own("x"), own("y"), "first", "node", "n_left").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not clash:
        original = F.col("node") == F.col("component")
        return signed, named.select(own("x"), own("y"), "first", F.col("component").alias("component_id"), original.alias("original"), "n_left")
    least = named.groupBy("component").agg(F.min(F.struct("first", own("x"), own("y"))).alias("least"))
    named = named.join(least, "component")
    original = (F.col("least.first") == F.col("first")) & (F.col(f"least.{own('x')}") == F.col(own("x"))) & (F.col(f"least.{own('y')}") == F.col(own("y")))
    return signed, named.select(own("x"), own("y"), "first", F.col("least.first").alias("component_id"), original.alias("original"), "n_left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; ids must be integers.

    Options: percent, bands, rows, shingle and block, as the constants above.
    """
    signed, classes = _classes(docs, id_col, text_col, **options)
    takes_part = F.col(own("id")).isNotNull() & (F.col("n_shingles") > 0)
    rows = signed.select(own("id"), "n_shingles", own("x"), own("y"))
    sets = classes.select(own("x"), own("y"), "component_id", "n_left")
    out = join_hot(rows.filter(takes_part), sets, [own("x"), own("y")], "inner", rows.count())
    alone = rows.filter(~takes_part).withColumn("component_id", F.col(own("id")))
    return out.unionByName(alone).select(
        F.col(own("id")).alias(id_col), "n_shingles", "component_id", F.coalesce(F.col(own("id")) == F.col("component_id"), F.lit(True)).alias("kept")
    )


def remove_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, with all columns of ``docs``; repeated rows go too.

    Empty texts and rows without an id stay.
    """
    signed, classes = _classes(docs, id_col, text_col, **options)
    originals = classes.filter("original").select(own("x"), own("y"), F.col("first").alias(own("id")))
    # One text of each original set under its id: texts may differ in case and blanks.
    rows = signed.filter(F.col("n_shingles") > 0).select(own("id"), own("x"), own("y"), own("t"), own("s")).distinct()
    keep = rows.join(originals, [own("id"), own("x"), own("y")]).groupBy(own("id"), own("x"), own("y")).agg(F.min(F.struct(own("t"), own("s"))).alias("k"))
    keep = keep.select(F.col(own("id")).alias(own("keep")), F.col(f"k.{own('t')}").alias(own("kt")), F.col(f"k.{own('s')}").alias(own("ks")))
    blank = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True)) | F.col(id_col).isNull()
    text = F.col(text_col).cast("string")
    full = docs.filter(~blank)
    hashed = full.select("*", F.col(id_col).cast("long").alias(own("keep")), *[F.xxhash64(F.lit(n), text).alias(own(c)) for n, c in enumerate(("kt", "ks"))])
    texts = hashed.join(keep, [own("keep"), own("kt"), own("ks")], "left_semi")
    if not signed.groupBy(own("id"), own("t"), own("s")).agg(F.count(F.lit(1)).alias("n")).filter(F.col(own("id")).isNotNull() & (F.col("n") > 1)).isEmpty():
        texts = texts.dropDuplicates([own("keep"), own("kt"), own("ks")])  # combined on the map side: a hot row stays small
    return texts.select(*docs.columns).unionByName(docs.filter(blank))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
    SELECT u, v FROM common JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
    WHERE 100 * c >= 85 * (a.n + b.n - c)
), reach AS (
    SELECT doc_id, doc_id AS r FROM documents
    UNION
    SELECT reach.doc_id, links.v FROM reach JOIN links ON reach.r = links.u
)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.r) AS component_id, d.doc_id = min(r.r) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""
