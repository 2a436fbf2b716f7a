import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import metrics, spans

SEQUENCE = ["O", "B-PER", "I-PER", "O", "B-ORG", "B-ORG", "I-ORG", "O", "O", "B-LOC", "I-LOC", "I-LOC", "B-MISC"]


def tokens(spark, *sequences):
    rows = [(sid, tid, t) for sid, seq in enumerate(sequences) for tid, t in enumerate(seq)]
    return spark.createDataFrame(rows, "sid long, tid long, tag string")


def seeds(spark, *pairs):
    return spark.createDataFrame(list(pairs), "sid long, tid long")


@pytest.fixture(scope="module")
def golden(spark):
    return tokens(spark, SEQUENCE).cache()


@pytest.mark.parametrize("seed, expected", [
    (0, [0]), (1, [1, 2]), (2, [1, 2]), (4, [4]), (6, [5, 6]), (10, [9, 10, 11]), (12, [12]),
])
def test_typed_expansion(spark, golden, seed, expected):
    found = spans.expand_entities(seeds(spark, (0, seed)), golden, 1).collect()
    assert sorted(r["tid"] for r in found) == expected
    assert not any(r["invalid"] for r in found)


@pytest.mark.parametrize("seed, expected", [
    (1, [1, 2]), (5, [4, 5, 6]), (11, [9, 10, 11, 12]), (8, [8]),
])
def test_run_expansion(spark, golden, seed, expected):
    found = spans.expand_runs(seeds(spark, (0, seed)), golden, 1).collect()
    assert sorted(r["tid"] for r in found) == expected


def test_two_seeds_in_one_run_count_once(spark, golden):
    found = spans.expand_runs(seeds(spark, (0, 4), (0, 6)), golden, 2).collect()
    assert sorted(r["tid"] for r in found) == [4, 5, 6]


def test_orphan_inside_tag_is_flagged(spark):
    t = tokens(spark, ["O", "I-PER", "I-PER", "I-ORG"])
    found = {(r["start"], r["end"], r["type"], r["invalid"]) for r in spans.bio_entities(t).collect()}
    assert found == {(1, 3, "PER", True), (3, 4, "ORG", True)}


def plain_runs(seq, breaks):
    out, start = [], None
    for i, t in enumerate([*seq, "O"]):
        if start is not None and (t == "O" or breaks(seq[i - 1], t)):
            out.append((start, i, seq[start]))
            start = None
        if t != "O" and start is None:
            start = i
    return out


@pytest.mark.parametrize("chunk", [2, 3, 7, 1 << 20])
def test_chunked_runs_equal_a_plain_scan(spark, chunk):
    rng = random.Random(chunk)
    seqs = [[rng.choice(["O", "A", "A", "A", "B"]) for _ in range(rng.randint(1, 40))] for _ in range(30)]
    seqs.append(["A"] * 50)
    t = tokens(spark, *seqs)
    for scheme, rule in ((spans.io_break, lambda a, b: a != b), (spans.any_entity_break, lambda a, b: False)):
        found = {(r["sid"], r["start"], r["end"], r["tag"]) for r in spans.runs(t, scheme, chunk).collect()}
        assert found == {(i, *r) for i, s in enumerate(seqs) for r in plain_runs(s, rule)}


def pairs(spark, gold, pred):
    rows = [(0, i, g, p) for i, (g, p) in enumerate(zip(gold, pred))]
    return spark.createDataFrame(rows, "sid long, tid long, gold string, pred string")


def test_io_scores(spark):
    row = metrics.io_scores(pairs(spark, ["O", "A", "A", "O", "B"], ["O", "A", "A", "B", "B"])).first()
    assert (row["n_pred"], row["n_gold"], row["n_correct"]) == (2, 2, 1)
    assert row["precision"] == pytest.approx(0.5) and row["f1"] == pytest.approx(0.5)


def test_empty_prediction_scores_zero(spark):
    row = metrics.io_scores(pairs(spark, ["O", "A"], ["O", "O"])).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    none = metrics.io_scores(pairs(spark, ["O"], ["O"])).first()
    assert (none["n_pred"], none["f1"]) == (0, 0.0)


def test_type_errors(spark):
    p = pairs(spark, ["P-A", "O", "P-A", "O", "P-A", "O", "Q-C"], ["P-A", "O", "P-B", "O", "Q-C", "O", "O"])
    row = metrics.type_errors(p).first()
    assert (row["within"], row["outer"]) == (1, 1) and row["same_span"] == pytest.approx(3 + 1e-6)


def test_bio_scores(spark):
    gold = ["B-PER", "I-PER", "O", "B-ORG", "O", "B-PER"]
    pred = ["B-PER", "I-PER", "O", "B-PER", "O", "I-PER"]
    rows = {r["type"]: r for r in metrics.bio_scores(pairs(spark, gold, pred)).collect()}
    assert rows["PER"]["precision"] == pytest.approx(2 / 3) and rows["PER"]["recall"] == 1.0
    assert rows["ORG"]["f1"] == 0.0 and rows["ORG"]["number"] == 1
    assert rows["overall"]["f1"] == pytest.approx(2 / 3) and rows["overall"]["accuracy"] == pytest.approx(4 / 6)


def test_scores_by_split_and_added_up(spark):
    """One scan for all splits equals a scan for each, and counts of parts add up to those of the whole."""
    rows = [(f"s{i % 3}", i, t, g, p) for i in range(30) for t, (g, p) in enumerate(zip(
        ["B-A", "I-A", "O", "B-B", "O"], ["B-A", "O" if i % 2 else "I-A", "B-B" if i % 5 == 0 else "O", "B-B", "O"], strict=True))]
    df = spark.createDataFrame(rows + [("none", 99, 0, "O", "O")], "split string, sid long, tid long, gold string, pred string")
    for scores, order in ((metrics.bio_scores, "type"), (metrics.io_scores, "n_pred")):
        found = scores(df, ("split",)).orderBy("split", order).collect()
        for split in ("s0", "s1", "s2", "none"):
            alone = scores(df.where(F.col("split") == split)).orderBy(order).collect()
            assert [r.asDict() for r in alone] == [{k: v for k, v in r.asDict().items() if k != "split"} for r in found if r["split"] == split]
    parts = [metrics.bio_counts(df.where(F.col("sid") % 4 == i)) for i in range(4)]
    together = metrics.bio_from_counts(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))
    assert sorted(map(repr, together.collect())) == sorted(map(repr, metrics.bio_scores(df).collect()))
