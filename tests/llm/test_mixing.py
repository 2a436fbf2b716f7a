import itertools

from pyspark.sql import functions as F

from gleaner.llm import mixing as M
from tests.llm.helpers import SCHEMA, SMALL, odd_rows, words


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", 10 + 7 * a * b + c * 13) for a, b, c in itertools.product(range(3), range(3), range(2))],
                                  "source string, lang string, topic string, tokens long")
    targets = {"source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "lang": {"l0": 0.6, "l1": 0.3, "l2": 0.1}, "topic": {"t0": 0.5, "t1": 0.5}}
    tables = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in targets.items()}
    out = M.rake(cells, tables, rounds=12)
    for d, t in targets.items():
        for r in out.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert abs(r["w"] - t[r[d]]) < 1e-6
    # Fitting keeps the cells' odds ratios.
    w = {(r["source"], r["lang"], r["topic"]): (r["weight"], r["tokens"]) for r in out.collect()}
    odds = lambda k: w["s0", "l0", "t0"][k] * w["s1", "l1", "t0"][k] / w["s0", "l1", "t0"][k] / w["s1", "l0", "t0"][k]
    assert abs(odds(0) - odds(1)) < 1e-6


def test_budget_is_met_in_expectation(spark):
    raked = spark.createDataFrame([("a", 100, 0.7), ("b", 800, 0.2), ("c", 100, 0.1), ("d", 0, 0.0)], "source string, tokens long, weight double")
    out = {r["source"]: r["prob"] for r in M.calibrated(raked, 0.5).collect()}
    assert out["a"] == 1.0 and out["d"] == 0.0
    assert abs(sum(out[s] * n for s, n in (("a", 100), ("b", 800), ("c", 100))) - 500) < 1e-3
    assert {r["prob"] for r in M.calibrated(raked.where("tokens > 0"), 1.0).collect()} == {1.0}


def test_sample_follows_the_probabilities(spark):
    rows = M.features(spark.read.parquet(f"{SMALL}/documents.parquet"))
    cells = M.fitted(rows.select(*M.DIMENSIONS, "n_tokens"))
    out = M.mixed(rows, cells).collect()
    assert len(out) == rows.count()
    expected, kept = sum(r["prob"] * r["n_tokens"] for r in out), sum(r["n_tokens"] for r in out if r["sampled"])
    total = sum(r["n_tokens"] for r in out)
    assert abs(expected / total - M.BUDGET) < 1e-3 and abs(kept - expected) / total < 0.15
    assert all(r["n_tokens"] == len(words(r["text"])) for r in out)


def test_odd_rows_and_empty_table(spark):
    rows = M.features(spark.createDataFrame(odd_rows(), SCHEMA).withColumn("topic", F.lit(3)).withColumn("n_tokens", F.lit("x")))
    out = M.mixed(rows, M.fitted(rows)).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        assert 0 <= r["prob"] <= 1 and r["source"] and r["lang"] and r["n_tokens"] == len(words(r["text"]))
        assert r["n_tokens"] or not r["sampled"]
    empty = rows.limit(0)
    assert M.mixed(empty, M.fitted(empty)).count() == 0


def test_small_tables_of_cells_are_fitted_alike(spark, monkeypatch):
    rows = M.features(spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(spark.createDataFrame(odd_rows(), SCHEMA), allowMissingColumns=True))
    here = {tuple(r[d] for d in M.DIMENSIONS): r for r in M.fitted(rows).collect()}
    monkeypatch.setattr(M, "SMALL_CELLS", -1)
    joined = {tuple(r[d] for d in M.DIMENSIONS): r for r in M.fitted(rows).collect()}
    assert here.keys() == joined.keys() and len(here) > 20
    for k, r in here.items():
        assert r["tokens"] == joined[k]["tokens"] and abs(r["weight"] - joined[k]["weight"]) < 1e-12 and abs(r["prob"] - joined[k]["prob"]) < 2e-9
