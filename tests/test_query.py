import math

import pytest

from gleaner.functions import scores as S
from gleaner.operators import annotate, predictions, query
from pyspark.sql import functions as F

U = -100
# Three sentences of 5, 4 and 3 tokens, three classes. The flattest vector is (0, 2), the closest race (1, 0).
PREDICTIONS = [
    [[0.8, 0.1, 0.1], [0.6, 0.3, 0.1], [0.34, 0.33, 0.33], [0.9, 0.05, 0.05], [0.7, 0.2, 0.1]],
    [[0.5, 0.495, 0.005], [0.85, 0.1, 0.05], [0.75, 0.15, 0.1], [0.4, 0.3, 0.3]],
    [[0.65, 0.25, 0.1], [0.95, 0.03, 0.02], [0.55, 0.25, 0.2]],
]
GOLD = [[0, 0, 0, 1, 2], [1, 0, 0, 2], [0, 1, 2]]
NAMES = ["O", "B-PER", "I-PER"]


@pytest.fixture(scope="module")
def data(spark):
    pred = [(s, t, v) for s, sent in enumerate(PREDICTIONS) for t, v in enumerate(sent)]
    gold = [(s, t, NAMES[v]) for s, sent in enumerate(GOLD) for t, v in enumerate(sent)]
    return (
        spark.createDataFrame(pred, "sid long, tid long, scores array<double>").cache(),
        spark.createDataFrame(gold, "sid long, tid long, tag string").cache(),
        spark.createDataFrame([], "sid long, tid long, tag string"),
    )


@pytest.mark.parametrize("strategy, expected", [
    (query.ENTROPY, [(0, 2, "O")]), (query.BREAKING_TIES, [(1, 0, "B-PER")]), (query.LEAST_CONFIDENCE, [(0, 2, "O")]),
])
def test_golden_picks(data, strategy, expected):
    pred, gold, none = data
    for level in (query.ENTITY, query.TOKEN):
        out = query.query(level, strategy, pred, gold, none, 1)
        assert [tuple(r) for r in out.labelled.collect()] == expected


@pytest.mark.parametrize("strategy", query.STRATEGIES)
def test_levels_and_budgets(data, strategy):
    pred, gold, none = data
    out = query.query(query.TOKEN, strategy, pred, gold, none, 5)
    assert out.selections.count() == 5 and out.labelled.count() == 5
    again = query.query(query.TOKEN, strategy, pred, gold, out.labelled, 5)
    assert again.labelled.count() == 10
    everything = query.query(query.TOKEN, strategy, pred, gold, out.labelled, 1000)
    assert everything.labelled.count() == 12
    sentence = query.query(query.SENTENCE, strategy, pred, gold, out.labelled, 3)
    touched = {r["sid"] for r in out.labelled.collect()}
    assert {r["sid"] for r in sentence.selections.collect()} == {0, 1, 2} - touched
    assert query.query(query.ENTITY, strategy, pred, gold, everything.labelled, 3).labelled.count() == 12


def test_entity_seed_reveals_the_run(data):
    pred, gold, none = data
    seeds = pred.where("sid = 2 and tid = 2").select("sid", "tid")
    from gleaner.operators import spans
    assert sorted(r["tid"] for r in spans.expand_runs(seeds, gold, 1).collect()) == [1, 2]


def test_aggregation_is_pluggable(data):
    pred, gold, none = data
    mean = query.rank_sentences(pred, none, query.ENTROPY, 3, aggregate=F.avg).collect()
    expect = [sum(-sum(p * math.log(p) for p in v if p > 0) for v in s) / len(s) for s in PREDICTIONS]
    assert [r["sid"] for r in mean] == sorted(range(3), key=lambda i: -expect[i])


def test_scores(spark):
    df = spark.createDataFrame([([2.0, 1.0, 1.0],), ([0.5, 0.5, 0.0],)], "v array<double>")
    row = df.select(S.entropy("v").alias("e"), S.margin("v").alias("m"), S.confidence("v").alias("c"),
                    S.lowest("v").alias("l"), S.argmax("v").alias("a")).collect()
    assert row[0]["e"] == pytest.approx(1.5 * math.log(2)) and row[1]["e"] == pytest.approx(math.log(2))
    assert [r["m"] for r in row] == [1.0, 0.0] and [r["a"] for r in row] == [0, 0]
    assert [r["l"] for r in row] == [1.0, 0.0]
    big = spark.createDataFrame([([1000.0, 1000.0],)], "v array<double>").select(S.softmax("v").alias("p")).first()["p"]
    assert big == [0.5, 0.5]


def test_row_strategies(spark):
    rows = spark.createDataFrame([(0, [0.7, 0.2, 0.1]), (1, [0.4, 0.35, 0.25]), (2, [0.5, 0.49, 0.01])], "id long, scores array<double>")
    pick = lambda s, **o: [r["id"] for r in query.rank_rows(rows, s, 3, **o).collect()]
    assert pick(query.ENTROPY)[0] == 1
    assert pick(query.BREAKING_TIES) == [2, 1, 0]
    assert pick(query.LEAST_CONFIDENCE) == [2, 0, 1]
    assert pick(query.LEAST_CONFIDENCE, lowest_class=False) == [1, 2, 0]
    assert sorted(pick(query.RANDOM)) == [0, 1, 2]


def test_stochastic_picks_follow_the_weights(spark):
    # Margins 0.1 and 0.4: the first is four times as likely to come first.
    rows = spark.createDataFrame([(0, 0, [0.55, 0.45]), (1, 0, [0.7, 0.3])], "sid long, tid long, scores array<double>").cache()
    none = spark.createDataFrame([], "sid long, tid long, tag string")
    first = [query.rank_tokens(rows, none, query.STOCHASTIC_BREAKING_TIES, 1, seed).first()["sid"] for seed in range(40)]
    assert 24 <= first.count(0) <= 39


def test_annotation_merges(spark):
    gold = {0: [1, 0, 2, 0, 4], 1: [3, 4], 2: [1, 0, 0], 3: [0]}
    sentences = spark.createDataFrame(
        [(s, [f"w{i}" for i in range(len(t))], t) for s, t in gold.items()], "sid long, tokens array<string>, ner_tags array<int>")
    tokens = sentences.select("sid", F.posexplode("ner_tags").alias("tid", "tag")).select(
        "sid", F.col("tid").cast("long").alias("tid"), F.col("tag").cast("string").alias("tag"))
    labelled = annotate.from_arrays(spark.createDataFrame(
        [(0, [U, 0, 2, 0, 4]), (1, gold[1])], "sid long, al_tags array<int>"))
    labelled = labelled.withColumn("tag", F.col("tag_id").cast("string"))
    picks = spark.createDataFrame([(0, 0), (2, 0)], "sid long, tid long")

    def arrays(df):
        return {r["sid"]: r["al_tags"] for r in annotate.to_arrays(
            sentences, df.withColumn("tag_id", F.col("tag").cast("int"))).collect()}

    assert arrays(annotate.tokens(tokens, labelled, picks)) == {0: gold[0], 1: gold[1], 2: [1, U, U]}
    all_four = sentences.select("sid")
    assert arrays(annotate.sentences(tokens, labelled, all_four, 4)) == gold
    annotate.require_fresh(tokens, labelled, picks)
    with pytest.raises(ValueError, match="annotated"):
        annotate.require_fresh(tokens, labelled, spark.createDataFrame([(0, 1)], "sid long, tid long"))
    pool = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "sid long, tid long")
    left = predictions.without_labelled_tokens(pool, labelled).collect()
    assert [tuple(r) for r in left] == [(0, 0)]


def test_length_check(spark):
    nested = spark.createDataFrame([(0, PREDICTIONS[0]), (2, PREDICTIONS[2])], "sid long, scores array<array<double>>")
    short = spark.createDataFrame([(0, GOLD[0]), (2, GOLD[2][:2])], "sid long, ner_tags array<int>")
    with pytest.raises(ValueError, match="length"):
        predictions.require_same_lengths(nested, short)
    predictions.require_same_lengths(nested, spark.createDataFrame([(0, GOLD[0]), (2, GOLD[2])], "sid long, ner_tags array<int>"))


def test_mask_and_unroll(spark):
    raw = spark.createDataFrame(
        [(7, [[0.0, 0.0], [1.0, 3.0], [9.0, 9.0], [2.0, 2.0]], [U, 1, U, 0])], "sid long, logits array<array<double>>, label_ids array<int>")
    out = predictions.valid_softmax(raw).orderBy("tid").collect()
    assert [r["tid"] for r in out] == [0, 1] and out[1]["scores"] == [0.5, 0.5]
    tags = predictions.argmax_tags(raw, ["O", "B-X"]).orderBy("tid").collect()
    assert [(r["pred"], r["gold"]) for r in tags] == [("B-X", "B-X"), ("O", "O")]


def test_collapse(spark):
    rows = spark.createDataFrame([(1, 5), (1, 0), (1, 5), (2, 70000)], "sid long, tid long")
    assert {tuple([r["sid"], r["block_no"], tuple(r["tids"])]) for r in predictions.collapse(rows).collect()} == {
        (1, 0, (0, 5)), (2, 1, (70000,))}


@pytest.mark.parametrize("share", [0.0, 0.1, 0.999, 1.0])
def test_best_tokens_first_or_labels_left_out_first(spark, share):
    """The same picks whether the pool is joined with all labels or a few of its best tokens are; many labels among the best don't matter."""
    pool = spark.range(3_000).selectExpr("id % 300 AS sid", "id div 300 AS tid", "array(0.5D + (id * 7919 % 1000) / 2000, 0.5D - (id * 7919 % 1000) / 2000) AS scores")
    labelled = pool.where(F.col("sid") < 300 * share).selectExpr("sid", "tid", "'O' AS tag")
    for strategy in (query.BREAKING_TIES, query.RANDOM, query.STOCHASTIC_BREAKING_TIES):
        want = query.rank_tokens(pool, labelled, strategy, 12, 3).collect()
        got = query.rank_tokens(pool, labelled, strategy, 12, 3, spare=96).collect()
        assert sorted(got) == sorted(want) and len(want) == min(12, round(3_000 - labelled.count()))
