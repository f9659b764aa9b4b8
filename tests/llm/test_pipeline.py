"""The pipeline's stages on a small table, against plain versions of them."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    insult, line = "you are an idiotic fool", "subscribe to our letter"
    rows = [(i, f"plain text number {i} about gardens and trees of town {i * 7} with water and sun {i * 3}\n{line}", "en", "s", 10) for i in range(60)]
    rows += [(100 + i, f"{insult} {i}. go away from here {i}", "en", "s", 10) for i in range(30)]
    rows += [(200, rows[3][1], "en", "s", 10), (201, None, None, None, None), (202, "bench " * 3 + " ".join(f"k{i}" for i in range(13)), "en", "s", 10)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 100)) for r in rows[:85]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(13)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        docs.write.parquet(f"{d}/{n}")
        docs = spark.read.parquet(f"{d}/{n}")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert not ids & set(range(100, 130)) and set(range(60)) <= ids
        if name == "line dedup":
            assert docs.filter(docs.text.contains(line)).count() == 0
        if name == "near-dedup":
            assert 3 in ids and 200 not in ids and 201 in ids
        if name == "decontamination":
            assert ids == {*range(60), 201}
    packed = pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in packed} == ids and len({r["sequence_id"] for r in packed}) == 1
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "packing"]


def test_near_dedup_threshold(spark, tmp_path):
    words = [f"w{i}" for i in range(105)]

    def edited(*places):
        return " ".join("edit" if i in places else w for i, w in enumerate(words))

    # 101 shingles: two edited words leave 91 of 111 (0.82), three leave 86 of 116 (0.74).
    rows = [(1, " ".join(words)), (2, edited(30, 70)), (3, edited(20, 50, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == [1, 3]
