"""Packing: repeated rows, runs and few open bins, against the laws of a packing."""

from skarn.llm import packing


def check(rows, capacity):
    """Offsets are gapless from 0 and no sequence is over the capacity; the number of sequences."""
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_repeated_rows_are_dealt_to_all_groups(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 3, 7)] * 300, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, capacity=12, group_pieces=10).collect()
    assert len(rows) == 300 and len({r["sequence_id"] >> 40 for r in rows}) > 20
    assert check(rows, 12) < 110


def test_few_open_bins_close_early_and_cost_little(spark):
    lengths = [1 + (i * 7919) % 97 for i in range(4000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    few, many, one_run = (check(packing.pack(pieces, capacity=100, open_bins=b, run_pieces=r).collect(), 100) for b, r in ((64, 200), (4000, 4000), (64, 4000)))
    assert -(-sum(lengths) // 100) <= many <= few <= many * 1.05 and few < one_run  # 64 bins do, in runs
