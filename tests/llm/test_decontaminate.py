import random

import numpy as np

from gleaner.llm import decontaminate as D
from tests.llm.helpers import SCHEMA, SMALL, odd_rows

ITEM = "the quick brown fox jumps over a lazy dog while seven wizards quietly box under pale moonlight near old harbour walls tonight"


def plain_score(text, item):
    h = [[0.0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
    return max(map(max, h))


def test_alignment_equals_plain_version():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 6, rng.integers(1, 30)) for _ in range(60)]
    items = [rng.integers(0, 6, rng.integers(1, 12)) for _ in range(60)]
    scores = D.local_scores(texts, items)
    for t, i, s in zip(texts, items, scores, strict=True):
        assert abs(s - plain_score(t.tolist(), i.tolist())) < 1e-4
        equal, first, end = D.traced(t, i)
        assert s == 0 or 0 <= first < end <= len(t) and equal <= min(len(i), end - first)
        if s:
            assert abs(D.local_scores([t[first:end]], [i])[0] - s) < 1e-4


def corpus():
    random.seed(3)
    vocabulary = [f"tok{i}" for i in range(400)] + ["the", "a", "over"] * 40
    filler = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    words = ITEM.split()
    edited = [w if k % 6 else "other" for k, w in enumerate(words)]
    shorter = words[:8] + words[10:]
    rows = [(i, filler(200)) for i in range(30)]
    rows += [(100, filler(50) + " " + ITEM.upper() + "! " + filler(50)), (101, ITEM), (102, filler(30) + " " + " ".join(edited)),
             (103, " ".join(shorter) + " " + filler(400)), (104, " ".join(words[:5]) + " " + filler(80))]
    return rows


def test_copies_and_edits_are_found(spark):
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    out = {r["doc_id"]: r for r in D.leaks(spark.createDataFrame(corpus(), "doc_id long, text string").repartition(4), items).collect()}
    assert set(out) == {100, 101, 102, 103}
    assert out[100]["score"] == out[101]["score"] == 1.0 and out[100]["first_word"] == 50 and out[100]["end_word"] == 72
    assert 0.5 <= out[102]["score"] < 0.9 and out[103]["n_equal"] == 20 and out[103]["first_word"] == 0


def test_blocks_of_seeds_change_nothing(spark, monkeypatch):
    from gleaner.llm import seeded
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = sorted(D.leaks(docs, items).collect())
    monkeypatch.setattr(D, "WORD_BLOCK", 7)
    monkeypatch.setattr(seeded.regions, "__defaults__", (None, 5))
    assert sorted(D.leaks(docs, items).collect()) == whole


def test_small_table_against_substrings(spark):
    import pyarrow.parquet as pq
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    items = pq.read_table(f"{SMALL}/benchmark.parquet").to_pandas()
    planted = {(d, i) for d, t in zip(docs["doc_id"], docs["text"], strict=True) for i, b in zip(items["item_id"], items["text"], strict=True) if b in t}
    out = D.leaks(spark.createDataFrame(docs[["doc_id", "text"]]), spark.createDataFrame(items)).collect()
    assert planted and {(r["doc_id"], r["item_id"]) for r in out} == planted


def test_odd_rows_and_empty_tables(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    items = spark.createDataFrame([(1, "one two three four five six seven eight", "x"), (None, "two three four five six seven eight nine", "y")], "item_id long, text string, doc_id string")
    out = {(r["doc_id"], r["item_id"]) for r in D.leaks(rows, items).collect()}
    assert {(i, 1) for i in (1, 2, 3, 12, 13)} <= out and {d for d, _ in out} == {1, 2, 3, 12, 13}
    assert D.leaks(rows, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert D.leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
