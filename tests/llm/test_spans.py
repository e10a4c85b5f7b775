"""Spans of which some words differ, and edges that nearly all documents share."""

import random
from collections import Counter

from recordweave.llm import common, substring_dedup


def test_a_wrong_span_is_tried_window_by_window(spark):
    spans = spark.createDataFrame([(1, 5, 8, 9, 0), (1, 20, 21, 9, 7), (2, 3, 5, 9, 40)], "k long, s int, e int, source long, at int")
    wrong = spark.createDataFrame([(9, 0, 3), (9, 7, 1)], "source long, at int, n int")
    got = substring_dedup._parted(spans, wrong)
    assert got.dtypes == spans.dtypes
    assert sorted(tuple(r) for r in got.collect()) == [(1, 5, 6, 9, 0), (1, 6, 7, 9, 1), (1, 7, 8, 9, 2), (2, 3, 5, 9, 40)]


def test_a_hot_edge_gives_what_brute_force_gives(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 0.02)  # few rows: a key of every fiftieth is hot
    rnd = random.Random(2)
    texts = [" ".join([f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(0, 9))] + ["a b c d e f"] * (i % 3) + [f"x{i % 5}", "b", "c", "d", "y"]) for i in range(120)]
    width, seen, want = 4, set(), {}
    for i, t in enumerate(texts):
        words = t.split()
        gone = set()
        for j in range(len(words) - width + 1):
            window = tuple(words[j : j + width])
            if window in seen:
                gone.update(range(j, j + width))
            seen.add(window)
        want[i] = len(gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove(docs.repartition(4), width, 2).collect()}
    assert got == want and Counter(want.values()).most_common(1)[0][0] > 0
