"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import random
import re
import zlib

import numpy as np
import pytest

from skarn.llm import packing, toxicity

pipeline = pytest.importorskip("corpus_pipeline")

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def toxic_texts(rows, model):
    """Texts with a sentence, or 48 words of one, whose distinct words weigh too much."""
    out = set()
    for _, text, *_ in rows:
        best = 0.0
        for sentence in re.split(r"[.!?\n]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+", sentence)
            for i in range(max(1, len(words) - 47) if words else 0):
                run = set(words[i : i + 48])
                best = max(best, sum(model.weights[f] for w in run for f in toxicity.word_features(w.encode())))
        if 1 / (1 + np.exp(-(best + model.bias))) >= 0.7:
            out.add(text)
    return out


def plain_toxicity(rows, model):
    gone = toxic_texts(rows, model)
    return [r for r in rows if r[1] not in gone]


def plain_line_dedup(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)

    holders = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, lang, source, n in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < 10]
        now = None if text is None else "\n".join(kept)
        out.append((doc_id, now, lang, source, n if len(kept) == len(lines) else len(now)))
    return out


def plain_near_dedup(rows):
    rows = sorted(set(rows), key=lambda r: (r[0], r[1] or ""))
    sets, component = [], list(range(len(rows)))
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((component[i], component[j]))
                component = [a if c == b else c for c in component]
    return [r for i, r in enumerate(rows) if component[i] == i]


def plain_decontamination(rows, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))

    windows = set()
    for text in items:
        w = words(text)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    out = []
    for r in rows:
        w, hit = words(r[1]), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def plain_pieces(rows):
    """(doc_id, piece, start, length, crc) by the tokenizer itself."""
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(packing.tokenizer_path()), []
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            out.append((doc_id, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def plain_best_fit(lengths):
    """The number of sequences, with all of them open."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(4096 - n)
    return len(free)


def made_rows(rng):
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(1500)]

    def prose(n):
        return " ".join(rng.choice(stems) for _ in range(n))

    items = [prose(40), prose(13), prose(6), "", None]
    texts = [prose(60) for _ in range(30)]
    for i in range(8):  # chains of copies, each with one more word edited
        for place in (15, 30, 45)[: 1 + i % 3]:
            words = texts[-1].split() if place != 15 else texts[i].split()
            words[place] = "Edited"
            texts.append(" ".join(words))
    texts += [texts[3], texts[3].title(), "  " + texts[4].replace(" ", "\t") + " "]
    texts += [prose(20) + " " + items[0].upper() + " " + prose(20), prose(100) + " " + items[1], prose(400) + " " + items[1], items[2].replace(" ", ", ")]
    texts += ["\n".join([prose(30), " Subscribe to Our letter\t", "", prose(20)]) for _ in range(12)]
    texts += [prose(30) + "\nseen in nine only" for _ in range(9)]
    texts += [f"{prose(15)}. you are an idiotic fool {prose(4)}. {prose(15)}" for _ in range(25)]
    texts += [prose(60) + " you are an idiotic fool " + prose(60), prose(5000), prose(2), "é", "", " \n\t", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5]], items


def test_stages_against_plain_versions(spark, tmp_path):
    rows, items = made_rows(random.Random(11))
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, int("idiotic" in r[1])) for r in rows if r[1] and r[0] % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    plain = {
        "toxicity": lambda now: plain_toxicity(now, model),
        "line dedup": plain_line_dedup,
        "near-dedup": plain_near_dedup,
        "decontamination": lambda now: plain_decontamination(now, items),
    }
    order = lambda r: tuple((x is not None, x) for x in r)
    now = rows
    for n, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        before, now = now, plain[name](now)
        assert before != now, name  # every stage has something to do
        stage(spark, docs, d).write.parquet(f"{d}/{n}")
        docs = spark.read.parquet(f"{d}/{n}")
        assert sorted(map(tuple, docs.collect()), key=order) == sorted(now, key=order), name
    packed = pipeline.run(spark, d).collect()
    pieces = plain_pieces(now)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(pieces)
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == plain_best_fit([p[3] for p in pieces])
