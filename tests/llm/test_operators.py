"""The corpus operators against brute force, on nulls, ties, repeats and empty tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.llm import decontaminate, langid, licenses, linededup, neardup, packing, sharding, topk, toxicity, urlfilter

SCHEMA = "doc_id long, text string, extra string, score string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
COPY = "the quick brown fox jumps over the lazy dog and runs far away from home today"


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "   \n\t", "one", COPY, COPY.upper(), COPY + " again", LONG, LONG + " end", "a\nSame line \na", "Same LINE\nb", "same line", "été ÉTÉ\x1c naïve! <|endoftext|> it's"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(4, COPY, "x", "y"), (None, COPY, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing_round_trip(docs, empty):
    pieces = packing.token_pieces(docs, capacity=64)
    packed = packing.pack(pieces, capacity=64).collect()
    tok = packing.WordTokenizer(packing.tokenizer_path())
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(np.frombuffer(tok.encode(r["text"] or ""), "<u4").tolist() + [1])
    got = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        assert r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    for k, parts in want.items():
        assert sorted(got[k]) == sorted(x for p in parts for x in p)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in packed)
    assert len(bins) <= -(-total // 64) + 2
    assert packing.pack(packing.token_pieces(empty)).collect() == []
    assert sum(len(r["ids"]) for r in packing.sequences(packing.pack(pieces, capacity=64)).collect()) == total


def test_best_fit_closes_fullest():
    p = packing.BestFit(10, 2)
    assert [p.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 (free 3) was closed
    assert p.place(4) == (0, 6) and p.place(2) == (2, 8)


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_chain(spark, docs, empty):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):  # a family whose members often miss the smallest one
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            words[k] = f"z{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"q{rng.integers(0, 50)}" for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (8192, 7):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, block=block).collect()}
        assert got == brute_components(rows)
    got = neardup.near_duplicates(docs).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert len(got) == 15
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    left = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in neardup.remove_near_duplicates(docs).collect())
    assert [x[1] for x in left if not x[0]] == [0, 1, 2, 3, 4, 7, 9, 10, 11, 12] and left[-1][0]
    assert neardup.near_duplicates(empty).collect() == []


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 100), (200, 201)], "u long, v long")
    got = {r["node"]: r["component"] for r in neardup.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 200: 200, 201: 200}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64))
    for n in (1, 2, 17, len(keys)):
        places = linededup.PerfectHash.build(keys[:n]).places(keys[:n])
        assert sorted(places.tolist()) == list(range(n))


def test_line_dedup(docs, empty):
    for part in (100_000, 1):  # the second splits the shards of frequent lines into parts
        out = linededup.dedup_lines(docs, min_docs=3, shard_keys=5, part_rows=part)
        got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["extra"]) for r in out.collect() if r["doc_id"] in (0, 2, 9, 10, 11)}
        assert got == {(0, "", 1, 0, "x"), (2, "   \n\t", 2, 0, "x"), (9, "a\na", 3, 1, "x"), (10, "b", 2, 1, "x"), (11, "", 1, 1, "x")}
    assert out.count() == 15
    assert linededup.dedup_lines(empty).collect() == []


def test_decontamination(spark, docs, empty):
    words = [f"b{i}" for i in range(20)]
    bench = spark.createDataFrame([(7, " ".join(words)), (8, "Short, Item"), (9, None), (10, "!!"), (11, " ".join(words))], "item_id long, text string")
    rows = [(1, "x y " + " ".join(words[:13]) + " z"), (2, " ".join(words[:12])), (3, "a short item here"), (4, None), (5, " ".join(words) + " q" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = decontaminate.scan_documents(df, bench, clean_text=True)
    many = decontaminate.scan_documents(df, bench, max_windows=8, clean_text=True)
    cols = ["doc_id", "n_words", "n_hit", "items", "contaminated", "clean_text"]
    got = sorted(map(tuple, one.select(*cols).collect()))
    assert got == sorted(map(tuple, many.select(*cols).collect()))
    assert [(g[1], g[2], g[3], g[4]) for g in got] == [(16, 13, ["11", "7"], True), (12, 0, [], False), (4, 2, ["8"], True), (0, 0, [], False), (520, 20, ["11", "7"], False)]
    assert got[0][5] == "x y  z"
    assert decontaminate.remove_contaminated(docs.withColumn("items", F.lit(1)), bench).columns == [*docs.columns, "items"]
    assert decontaminate.scan_documents(df, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.scan_documents(empty, bench).collect() == []


def test_decontamination_without_item_id(spark, tmp_path):
    import duckdb

    words = [f"b{i}" for i in range(40)]
    bench = spark.createDataFrame([(None, " ".join(words[:14])), (None, " ".join(words[20:])), (3, " ".join(words[20:])), (None, None)], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(words[:13])), (2, " ".join(words)), (3, "nothing here")], "doc_id long, text string")
    for options in ({}, {"max_windows": 8}):
        got = decontaminate.scan_documents(df, bench, **options).orderBy("doc_id").collect()
        assert [(r["n_hit"], r["items"], r["contaminated"]) for r in got] == [(13, [None], True), (34, ["3", None], True), (0, [], False)]
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontaminate.op6_benchmark_decontamination(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(decontaminate.OP6_SQL).select(", ".join(got.columns)).fetchall())


def places_of(items, words, window):
    hit, found = [False] * len(words), set()
    for item, text in items:
        w = text.split()
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    found.add(item)
                    hit[j : j + k] = [True] * k
    return hit, found


@pytest.mark.parametrize("one_hash", [False, True])
def test_windows_against_brute_force(monkeypatch, one_hash):
    if one_hash:  # every window collides with every other: words decide
        monkeypatch.setattr(decontaminate, "rolled", lambda codes, n: np.zeros(max(0, len(codes) - n + 1), np.uint64))
    rng = np.random.default_rng(8)
    some = lambda n: b" ".join(b"abc"[i : i + 1] for i in rng.integers(0, 3, rng.integers(0, n)))
    for _ in range(150):
        items = [(f"i{rng.integers(0, 5)}", some(9)) for _ in range(rng.integers(0, 6))]
        doc = some(30) + b" zz " + some(9)
        words, hit, found = decontaminate.Windows(items, 4).scan(doc)
        got = [False] * len(words) if hit is None else hit.tolist()
        assert (got, found) == places_of(items, words, 4)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype("f4").tolist()) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (None, [1.0] * 8), (303, [1.0, 2.0])]
    rows += [(400 + i, rows[0][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("id") % 20 == 0, k=5, group_rows=64, query_rows=7, head=3).collect()
    v = {i: np.floor(np.pad(np.array(x, "f4").astype(float), (0, 8 - len(x))) * 64).astype(int) for i, x in rows if i is not None and i not in (300, 301, 302)}
    want = {(q, n + 1, i, -s) for q in v if q % 20 == 0 for n, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_urls(spark):
    urls = [None, "no scheme", "HTTP://A.Example.COM/en/712?x#y", "http://com/en/", "http://xcom/en/", "http://a.net/de/1", "http://example.net/de/88", "http://q.org/es", "x://org/es/?", "http://h"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(3, urls[3], "r")], "page_id long, url string, rule string")
    listed = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    for blocks in (1 << 14, 1):  # one block passes many false positives to the join
        got = urlfilter.filter_urls(pages, listed, blocks=blocks).orderBy("page_id").collect()
        assert [(r["rule"], r["verdict"]) for r in got] == [
            (None, "allow"), (None, "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block"), (None, "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow"), ("org/es/", "block"), (None, "allow"),
        ]
    assert (got[2]["host"], got[2]["path"]) == ("a.example.com", "/en/712")
    assert urlfilter.filter_urls(pages.limit(0), listed).collect() == []


def test_licenses(spark, docs, empty):
    rows = [(1, "Foo\nReleased under the MIT License.\nbar CC-BY x"), (2, "this work is licensed under the gnu GENERAL\npublic license version 3"), (3, None), (4, "Licensed under the Apache License 2.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [f["label"] for f in got[1]["found"]] == ["mit"] and [(p["at"], p["label"]) for p in got[1]["places"]] == [(7, "cc-by")]
    assert got[2]["found"] == [] and got[2]["places"][0]["at"] == 7 and got[3]["n_words"] == 0 and got[4]["found"] == []
    assert [f["label"] for f in licenses.scan_licenses(df, threshold=0.8).filter("doc_id = 4").first()["found"]] == ["apache-2.0"]
    short = spark.createDataFrame([(1, "A b\nc"), (2, "x\nc B,a")], "doc_id long, text string")
    found = licenses.scan_licenses(short, templates={"abc": ["A B C"]}).orderBy("doc_id").collect()
    assert [[(f["line"], f["label"]) for f in r["found"]] for r in found] == [[], [(1, "abc")]]
    assert licenses.scan_licenses(docs).count() == 15 and licenses.scan_licenses(empty).collect() == []


def test_wrapped_licenses(spark, tmp_path):
    mit = "Permission is hereby granted, free of\n * charge, to any person obtaining a copy of this\n * software and associated documentation files"
    far = "licensed\n" + "filler\n" * 60 + "under the Apache License, Version 2.0."
    rows = [(1, "word\n" * 37 + mit), (2, "this work is licensed under the gnu GENERAL\npublic license version 3"), (3, far), (4, "a\nb"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in licenses.op8_license_scans(spark, str(tmp_path)).collect()}
    assert got == {1: "mit", 2: "gpl,gpl-3.0", 3: "", 4: "", 5: ""}


def test_sharding_law(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows = [(i, "s" * int(n)) for i, n in enumerate(rng.integers(0, 4000, 1500))] + [(2000 + i, COPY) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for range_rows in (100_000, 50):
        got = sharding.assign_shards(df, range_rows=range_rows, oversample=16).toPandas()
        sizes = got.groupby("shard")["size"].sum()
        assert len(sizes) == 24 and sizes.max() - sizes.min() < 0.01 * sizes.mean() + 4000 and len(got) == 2400
        for _, s in got.groupby("shard")["slot"]:
            assert sorted(s) == list(range(len(s)))
    assert sharding.assign_shards(docs).count() == 15 and sharding.assign_shards(empty).collect() == []
    null = sharding.assign_shards(docs).filter("doc_id = 0").first()
    assert (null["size"], null["text_crc32"]) == (8, None)


def test_write_shards_writes_every_row(spark, tmp_path):
    rows = [(None, f"t{i} " * 9, i) for i in range(40)] + [(7, "same " * 20, i) for i in range(300)] + [(i, "s" * i, i) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long").repartition(3)
    sharding.write_shards(df, f"{tmp_path}/out", shards=4, range_rows=50)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = out.collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r["doc_id"], r["text"], r["extra"]) for r in got), key=key) == sorted(rows, key=key)
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots and slots == list(range(len(slots)))
    sizes = [sum(len(r["text"]) + 8 for r in got if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) < 1000 and out.columns == [*df.columns, "slot", "shard"]


def test_toxicity_counterfactual():
    clean = ["the town is calm today. we walk home", "a garden with many trees", "women and men live here", "immigrants work in our town"] * 30
    toxic = ["you are an idiotic fool. go home", "women are idiotic", "immigrants are idiotic people"] * 30
    texts, labels = [t.encode() for t in clean + toxic], [0] * len(clean) + [1] * len(toxic)
    model = toxicity.fit(texts, labels, min_docs=1)
    p = lambda t: 1 / (1 + np.exp(-model.logit(t.encode(), {})))
    assert p("he is idiotic") >= 0.7 > p("muslims live in our town")
    assert abs(p("immigrants live here") - p("refugees live here")) < 0.2
    assert p("") < 0.7 and toxicity.fit([], []).logit(None, {}) < 0


def test_toxicity_scores_every_row(docs, empty):
    model = toxicity.fit([b"good day"] * 5 + [b"bad idiot"] * 5, [0] * 5 + [1] * 5, min_docs=1)
    out = toxicity.score(docs, model)
    assert out.count() == 15 and out.filter("score NOT BETWEEN 0 AND 1 OR predicted IS NULL").count() == 0
    assert toxicity.remove_toxic(docs, model).columns == docs.columns
    assert toxicity.score(empty, model).collect() == []


def test_language(spark, docs, empty):
    en, fr = "the house and the tree of the town with this thing ", "la maison et les arbres de la ville avec cette chose "
    rows = [(i, (en if i % 2 else fr) * 4, "en" if i % 2 else "fr") for i in range(40)] + [(100, "the other house with a tree", None), (101, "les autres arbres de la maison", None), (102, "123 !", None), (103, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(df, langid.learn_dictionaries(df))
    assert {r["doc_id"]: r["lang_pred"] for r in out.filter("doc_id >= 100").collect()} == {100: "en", 101: "fr", 102: "und", 103: "und"}
    assert langid.identify(docs, {}).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, {}).collect() == []


def test_digest(docs):
    assert decontaminate.items_digest([]) == hashlib.sha256(b"").hexdigest()
