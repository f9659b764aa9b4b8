"""Language identification: many languages, lone texts, ties, rejection, brute force."""

import random

import numpy as np
import zstandard

from skarn.llm import langid


def words(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    return " ".join(rng.choice(stems) for _ in range(n))


def test_many_languages_of_one_text(spark):
    rows = [(i, words(i, 80), f"l{i}") for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    contents = langid.learn_dictionaries(docs)
    assert set(contents) == {f"l{i}" for i in range(230)}
    asked = spark.createDataFrame([(i, words(i, 80)) for i in (3, 120, 229)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(asked, contents).collect()} == {i: f"l{i}" for i in (3, 120, 229)}
    small = langid.learn_dictionaries(docs, total_bytes=230 * 100)
    assert len(small) == 230 and max(map(len, small.values())) <= 100


def test_labels_that_teach_nothing(spark):
    rows = [(1, words(1, 50), "xx"), (2, "123 ... 456", "digits"), (3, "", "none"), (4, None, "null"), (5, words(2, 50), None), (None, words(3, 50), "yy")]
    contents = langid.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(contents) == {"xx", "yy"}
    assert langid.learn_dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_ties_go_to_the_language_with_most_labels(spark):
    text = words(5, 40)
    rows = [(1, text, "b"), (2, text, "a"), (3, text, "a")]
    contents = langid.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(contents) == ["a", "b"]
    same = {"b": text.encode(), "a": text.encode()}
    got = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), same).first()
    assert got["lang_pred"] == "b" and got["rejected"] and got["score"] == 0.5


def test_against_brute_force(spark):
    """Sums of compressed chunks, as zstandard gives them without our classes."""
    contents = {f"l{i}": words(i, 500).encode() for i in range(3)}
    rows = [(i, words(i % 3, 30 + 400 * (i % 2))) for i in range(9)] + [(9, words(0, 40) + " " + words(1, 40)), (10, None), (11, "12 !"), (12, "")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), contents)
    for r in got.collect():
        text = (r["text"] or "").encode()
        if not any(c.isalpha() for c in text.decode()):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        totals = []
        for content in contents.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=langid.LEVEL)
            make = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
            totals.append(sum(len(make.compress(text[i : i + langid.CHUNK])) for i in range(0, len(text), langid.CHUNK)))
        order = np.argsort(totals, kind="stable")
        assert r["lang_pred"] == f"l{order[0]}"
        assert r["rejected"] == (1 - totals[order[0]] / totals[order[1]] < langid.MARGIN)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, words(1, 30), 7, "keep")], "doc_id long, text string, score int, extra string")
    got = langid.identify(docs, {"l1": words(1, 90).encode()}).first()
    assert got["lang_pred"] == "l1" and got["extra"] == "keep" and 0 <= got["score"] <= 1
