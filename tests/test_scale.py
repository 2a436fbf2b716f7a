"""The routes that small tables never take, forced with small limits."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import initial, tfidf
from gleaner.operators.skew import at_most, positions
from gleaner.operators.topk import By, first_k
from gleaner.sources.corpus import dense_ids, holdout


def test_positions_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(7, rng.randint(1, 7), i) for i in range(6000)] + [(k, rng.randint(1, 7), k) for k in range(100, 3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, a long, b long").repartition(5)
    for limit in (500, 10**6):
        out = positions(df, ["k"], ["a", "b"], chunk_rows=limit).collect()
        seen = {}
        for r in sorted(out, key=lambda r: (r["k"], r["a"], r["b"])):
            assert r["tid"] == seen.get(r["k"], 0)
            seen[r["k"]] = r["tid"] + 1
        assert len(out) == len(rows)


def test_positions_by_text_and_ties(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.concat(F.lit("d"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"))
    out = positions(df, ["k"], ["id"], chunk_rows=10).collect()
    assert all(r["tid"] == int(r["id"][1:]) for r in out)
    ties = spark.range(1000).select(F.lit(1).alias("k"), F.lit(5).alias("same"))
    ranged = positions(ties, ["k"], ["same"], chunk_rows=10)
    assert sorted(r["tid"] for r in ranged.collect()) == list(range(1000))


@pytest.mark.parametrize("k", [37, 500, 1999, 5000])
@pytest.mark.parametrize("distinct", [3, 10**6])
def test_first_k_by_ranges(spark, k, distinct):
    rng = random.Random(k + distinct)
    rows = [(i, rng.randrange(distinct) / 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "sid long, score double").cache()
    for down in (False, True):
        found = first_k(df, [By("score", down), By("sid")], k, direct_rows=20).collect()
        expected = sorted(rows, key=lambda r: (-r[1] if down else r[1], r[0]))[:k]
        assert sorted(r["sid"] for r in found) == sorted(r[0] for r in expected)


@pytest.mark.parametrize("k", [3, 12, 35, 40, 60])
@pytest.mark.parametrize("down", [False, True])
def test_first_k_with_nulls_and_text(spark, k, down):
    """NULL and NaN come last, whichever way is taken and whatever the types."""
    value = lambda i: None if i % 4 == 1 else float("nan") if i % 4 == 2 else float(i % 7)
    rows = [(f"s{i:02d}", value(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "sid string, score double").repartition(3)
    bad = lambda v: v is None or v != v
    expected = sorted(rows, key=lambda r: (bad(r[1]), 0 if bad(r[1]) else -r[1] if down else r[1], r[0]))[:k]
    for limit in (10**9, 5):
        found = first_k(df, [By("score", down), By("sid")], k, direct_rows=limit).collect()
        assert sorted(r["sid"] for r in found) == sorted(r[0] for r in expected)
    by_text = first_k(df, [By("sid", down)], k, direct_rows=5).collect()
    assert sorted(r["sid"] for r in by_text) == sorted(sorted((r[0] for r in rows), reverse=down)[:k])


def test_large_k_is_not_gathered_in_one_task(spark):
    df = spark.range(1000).select(F.col("id").alias("sid"), F.col("id").alias("score"))
    small = first_k(df, [By("score"), By("sid")], 10)._jdf.queryExecution().executedPlan().toString()
    large = first_k(df, [By("score"), By("sid")], 900, direct_rows=1000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in small and large.count("limit=900") == 0


def test_broadcast_only_within_the_bound(spark):
    df = spark.range(10)
    assert "ResolvedHint" in at_most(df, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in at_most(df, 10**9)._jdf.queryExecution().analyzed().toString()


def test_holdout_size_and_stability(spark):
    rows = spark.range(1234).select(F.col("id"), F.lit("train").alias("split"))
    direct = holdout(rows, "id")
    by_cut = holdout(rows.repartition(7), "id", direct_rows=2)
    held = lambda df: {r["id"] for r in df.where("split = 'val_train'").collect()}
    assert len(held(direct)) == 13 and held(direct) == held(by_cut)
    assert direct.count() == 1234
    assert holdout(rows.where("split = 'none'"), "id").count() == 0


def test_dense_ids_in_ranges(spark):
    rows = spark.range(3000).select((F.col("id") * 17 % 3001).alias("id")).withColumn(
        "split", F.when(F.col("id") < 2900, "train").otherwise("test"))
    out = dense_ids(rows, ["id"], chunk_rows=100).collect()
    for split in ("train", "test"):
        ids = sorted((r["id"], r["sid"]) for r in out if r["split"] == split)
        assert [s for _, s in ids] == list(range(len(ids)))


def test_picks_do_not_depend_on_partitioning(spark):
    import __spark_entry__ as entry
    from conftest import SMALL
    results = []
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, entry.queries()["tl_stochastic_breaking_ties"](spark, SMALL).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert results[0] == results[1] and len(results[0]) == 500


SPLIT = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.codegen.wholeStage": "true", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def splitting(spark):
    """Spark as on a cluster: compiled, planned again while it runs, and with a very small idea of skew."""
    old = {k: spark.conf.get(k) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def final_plan(df):
    """Rows, and the plan that they came from in the end."""
    rows = sorted(map(repr, df.collect()))
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_word_is_split(splitting):
    """One word is a third of all tokens, on one side of the join; its rows go to several tasks."""
    word = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 4001).cast("string")))
    rows = splitting.range(0, 60_000, 1, 12).select(F.expr("id div 10").alias("sid"), (F.col("id") % 10).alias("tid"), word.alias("token"),
                                                    F.when(F.col("id") % 5 < 3, "NNP").otherwise("NN").alias("pos"))
    found, plan = final_plan(initial.nnp_frequency(rows, 40))
    assert "skew=true" in plan
    splitting.conf.set("spark.sql.adaptive.enabled", "false")
    assert sorted(map(repr, initial.nnp_frequency(rows, 40).collect())) == found


def test_a_frequent_term_is_split(splitting):
    text = F.concat_ws(" ", F.lit("hot"), F.concat(F.lit("w"), F.col("id").cast("string")), F.concat(F.lit("v"), (F.col("id") % 977).cast("string")))
    texts = splitting.range(0, 30_000, 1, 12).select(F.col("id").alias("sid"), text.alias("text"))
    found, plan = final_plan(tfidf.tfidf(texts, tfidf.Vectorizer((1, 1), None, None), ids=True))
    assert "skew=true" in plan and len(found) == 90_000
    splitting.conf.set("spark.sql.adaptive.enabled", "false")
    assert sorted(map(repr, tfidf.tfidf(texts, tfidf.Vectorizer((1, 1), None, None), ids=True).collect())) == found


def test_small_chunks_ask_for_a_bounded_number_of_ranges(spark, monkeypatch):
    """Spark samples for each range on the driver, so ranges must not grow with the table."""
    asked = []
    kind = type(spark.range(0))
    plain = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *keys: (asked.append(n), plain(self, n, *keys))[1])
    rows = spark.range(400).select(F.lit("a").alias("split"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"))
    placed = {r["id"]: r["sid"] for r in dense_ids(rows, ["id"], chunk_rows=2).collect()}
    assert placed == {i: n for n, i in enumerate(sorted(placed))} and len(placed) == 400
    assert asked == [16]


def test_holdout_reads_its_rows_twice_at_most(spark):
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(len(b))
            yield b
    rows = spark.range(300).withColumn("split", F.lit("train")).mapInPandas(counted, "id long, split string")
    for direct in (None, 1):  # by sort and limit, by ranges
        before = n.value
        held = holdout(rows, "id", direct_rows=direct).where("split = 'val_train'").count()
        assert held == 3 and n.value - before == 600
