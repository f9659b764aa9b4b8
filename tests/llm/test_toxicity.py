"""Toxicity: what the swaps do, long sentences, conflicting labels, against brute force."""

import random
import zlib

import numpy as np
import pytest

from skarn.llm import toxicity
from skarn.llm.common import own

TERMS = {"xx": ["zorgs", "blims", "krags", "plinths"]}
PLACES = "garden river market bridge school forest station harbour library meadow".split()


def confounded():
    """Toxic documents nearly always name zorgs; neutral ones name the other groups."""
    rng = random.Random(4)
    clean, toxic = [], []
    for _ in range(120):
        group = rng.choice(TERMS["xx"][1:])
        clean.append(f"the {group} meet at the {rng.choice(PLACES)}. we walk to the {rng.choice(PLACES)} today")
    for n in range(120):
        insult = rng.choice(["idiotic", "filthy"]) if n % 3 else f"{rng.randrange(10**9):x}"  # every third one only the group marks
        toxic.append(f"we walk to the {rng.choice(PLACES)} today. the {insult} zorgs meet at the {rng.choice(PLACES)}")
    return [t.encode() for t in clean + toxic], [0] * 120 + [1] * 120


def neutral():
    rng = random.Random(5)
    return [(g, f"the {g} meet at the {rng.choice(PLACES)} near the {rng.choice(PLACES)}".encode()) for g in TERMS["xx"] for _ in range(25)]


def false_alarms(model):
    known: dict = {}
    bad = {g: 0 for g in TERMS["xx"]}
    for g, t in neutral():
        bad[g] += 1 / (1 + np.exp(-model.logit(t, known))) >= toxicity.THRESHOLD
    return bad


def test_swaps_take_false_alarms_from_neutral_mentions():
    texts, labels = confounded()
    without = toxicity.fit(texts, labels, terms=TERMS, swap_weight=0.0)
    model = toxicity.fit(texts, labels, terms=TERMS)
    assert false_alarms(without)["zorgs"] == 25  # the group's name alone counts as toxic
    assert sum(false_alarms(model).values()) == 0
    found = [1 / (1 + np.exp(-model.logit(t, {}))) >= toxicity.THRESHOLD for t, y in zip(texts, labels, strict=True) if y and (b"idiotic" in t or b"filthy" in t)]
    assert len(found) == 80 and all(found)  # insults are still found
    spread = lambda m: np.ptp([m.logit(f"the {g} meet here".encode(), {}) for g in TERMS["xx"]])
    assert spread(model) < 0.25 * spread(without)


def test_swaps_are_with_every_other_term():
    got = toxicity.swaps({b"zorgs", b"krags", b"walk"}, TERMS)
    assert {(a, b) for a, b, _ in got} == {("zorgs", "blims"), ("zorgs", None), ("zorgs", "plinths"), ("krags", None), ("krags", "blims"), ("krags", "plinths")}
    assert sum(n for *_, n in got) == pytest.approx(2)


def test_long_sentences_score_alike_wherever_a_run_starts():
    texts, labels = confounded()
    model = toxicity.fit(texts, labels, terms=TERMS)
    filler = ["quiet"] * 200
    insult = "the filthy zorgs meet here".split()
    scores = {round(model.logit(" ".join(filler[:n] + insult + filler[n:]).encode(), {}), 9) for n in range(50, 150)}
    assert len(scores) == 1
    # Brute force: the worst of all runs of WINDOW words.
    words = " ".join(filler[:60] + insult + filler[60:] + insult).encode().split()
    weight = {w: float(model.weights[toxicity.word_features(w)].sum()) for w in set(words)}
    runs = [sum(weight[w] for w in set(words[i : i + toxicity.WINDOW])) for i in range(len(words) - toxicity.WINDOW + 1)]
    assert model.logit(b" ".join(words), {}) == pytest.approx(max(0.0, *runs) + model.bias)


def test_conflicting_and_one_sided_labels(spark):
    texts, labels = confounded()
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(0, "another text"), (1, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    schema = "doc_id long, toxic int"
    marks = [(i, y) for i, y in enumerate(labels)]
    odd = [(5, 1), (5, 0), (6, None), (None, 1), (7, 9), (99999, 1)]
    train = lambda m: toxicity.train(docs, spark.createDataFrame(m, schema), terms=TERMS)
    first, second = train(marks + odd), train(odd[::-1] + marks[::-1])
    assert np.array_equal(first.weights, second.weights) and first.bias == second.bias
    rowed = toxicity.training_rows(docs, spark.createDataFrame(marks + odd, schema), "doc_id", "text", 2500, None)
    got = {r[0]: (r["toxic"], r[2]) for r in rowed.collect()}
    assert got[5][0] == 1 and got[0][1] == min("another text", texts[0].decode()) and len(got) == 240
    for marks_ in ([], [(1, 1), (2, 1)], [(1, 0)], [(1, None)]):
        model = train(marks_)
        assert not model.weights.any() and toxicity.score(docs, model).filter("score IS NULL OR predicted IS NULL").count() == 0
    assert toxicity.score(docs.limit(0), first).collect() == []


def test_train_is_fit_of_the_same_rows(spark):
    """The tasks' counts, windows and scores give what one process makes of all texts."""
    texts, labels = confounded()
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    made = toxicity.train(docs, marks, terms=TERMS)
    plain = toxicity.fit(texts, labels, terms=TERMS)
    assert np.allclose(made.weights, plain.weights, atol=1e-6) and made.bias == pytest.approx(plain.bias, abs=1e-6)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, made).collect()}
    for i, t in enumerate(texts):
        p = 1 / (1 + np.exp(-plain.logit(t, {})))
        assert got[i][0] == pytest.approx(p, abs=1e-6) and got[i][1] == int(p >= 0.7)


def test_query_learns_nothing_from_held_out_rows(spark, tmp_path):
    texts, labels = confounded()
    rows = [(i, t.decode()) for i, t in enumerate(texts)] + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    scores = []
    for flip in (False, True):
        marks = [(i, 1 - y if flip and i in held else y) for i, y in enumerate(labels)]
        spark.createDataFrame(marks, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        scores.append(sorted(tuple(r) for r in toxicity.op2_toxicity(spark, str(tmp_path)).collect()))
    assert scores[0] == scores[1] and {r[0] for r in scores[0] if r[1]} == held
    assert own("id") not in toxicity.op2_toxicity(spark, str(tmp_path)).columns
