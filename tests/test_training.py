import pytest

from gleaner import UNKNOWN
from gleaner.operators import training

U = UNKNOWN
# Candidates are 0 to 1, 2 to 5 and 6 to 7; only the first is fully annotated.
POS = ["NNP", "O", "NNP", "IN", "NNP", "O", "NNP", "O", "O"]
KNOWN = [2, U, U, 0, 1, U, U, U, 0]


def tags_of(spark, style, pos=POS, known=KNOWN):
    rows = spark.createDataFrame(
        [(1, [f"w{i}" for i in range(len(known))], pos, known)],
        "sid long, tokens array<string>, pos_tags_text array<string>, al_tags array<int>")
    out = training.materialize(rows, style).orderBy("window_no").collect()
    assert all(len(r["tokens"]) == len(r["ner_tags"]) for r in out)
    return [r["ner_tags"] for r in out]


@pytest.mark.parametrize("style, expected", [
    (training.MASK_ALL, [KNOWN]),
    (training.DROP_ALL, [[2, 0, 1, 0]]),
    (training.MASK_ENTITY, [[2, 0, U, 0, 1, 0, U, 0, 0]]),
    (training.DROP_ENTITY, [[2, 0, 0, 1, 0, 0, 0]]),
    (training.DYNAMIC_WINDOW, [[2, 0], [2, 0, U, 0, 1, 0], [0, U, 0, 0]]),
])
def test_golden_sentence(spark, style, expected):
    assert tags_of(spark, style) == expected


@pytest.mark.parametrize("style", training.STYLES)
def test_full_sentence_passes_through(spark, style):
    assert tags_of(spark, style, ["NNP", "O", "NNPS"], [1, 0, 2]) == [[1, 0, 2]]


def test_no_candidate_keeps_the_mask(spark):
    assert tags_of(spark, training.DYNAMIC_WINDOW, ["O", "NNPS", "IN"], [U, U, 0]) == [[U, U, 0]]


def test_one_candidate_is_closed(spark):
    assert tags_of(spark, training.DYNAMIC_WINDOW, ["O", "NNP", "O"], [U, U, 0]) == [[0, 0, 0]]


def test_all_candidates_known_is_closed(spark):
    assert tags_of(spark, training.DYNAMIC_WINDOW, ["NNP", "O", "NNP"], [1, U, 3]) == [[1, 0, 3]]


def test_partly_known_neighbour_stops_the_window(spark):
    pos = ["O", "NNP", "NNP", "O", "NNP", "O"]
    assert tags_of(spark, training.DYNAMIC_WINDOW, pos, [0, 1, U, U, U, 0]) == [[0, 1, U, 0], [0, U, 0]]


def test_second_preposition_is_outside(spark):
    # N I N is one candidate; the next I and N are not joined to it.
    pos = ["NNP", "IN", "NNP", "IN", "NNP"]
    assert tags_of(spark, training.MASK_ENTITY, pos, [U, U, U, U, 0]) == [[U, U, U, 0, 0]]


def test_part_of_speech_is_required(spark):
    rows = spark.createDataFrame([(1, ["a"], [U])], "sid long, tokens array<string>, al_tags array<int>")
    with pytest.raises(ValueError, match="part-of-speech"):
        training.materialize(rows, training.DYNAMIC_WINDOW)
    with pytest.raises(ValueError, match="unknown training style"):
        training.materialize(rows, "other")


def test_very_long_sentence(spark):
    """Windows of 5,000 candidates; a row for each of them would once have held the whole sentence."""
    pos = ["NNP", "O", "O", "O"] * 5_000
    out = tags_of(spark, training.DYNAMIC_WINDOW, pos, [U, 0, 0, 0] * 5_000)
    assert len(out) == 5_000 and out[1] == [0, 0, 0, U, 0, 0, 0] and out[0] == [U, 0, 0, 0] and out[-1] == [0, 0, 0, U, 0, 0, 0]


def test_rejects(spark):
    rows = spark.createDataFrame(
        [(1, ["a", "b"], [U, U]), (2, ["a", "b"], [U, 0])], "sid long, tokens array<string>, al_tags array<int>")
    assert [r["sid"] for r in training.without_annotation(rows).collect()] == [1]
    assert [r["sid"] for r in training.materialize(rows, training.DROP_ALL).collect()] == [2]


def test_candidates_of_any_tags(spark):
    """Spans against a plain match of the tags, for empty, one-sided and null-free rows; each column can be read alone."""
    import random
    import re

    from pyspark.sql import functions as F

    from gleaner.operators import training as module
    rng = random.Random(6)
    rows = [(i, [rng.choice(["NNP", "NNP", "IN", "NN", "NNPS"]) for _ in range(rng.randint(0, 14))]) for i in range(200)]
    rows = [(i, ["w"] * len(p), p, [rng.choice([-100, 0]) for _ in p]) for i, p in rows]
    df = spark.createDataFrame(rows, "sid long, tokens array<string>, pos_tags_text array<string>, al_tags array<int>")
    found = module.with_candidates(df)
    got = {r["sid"]: r for r in found.select("sid", "inside", "cands").collect()}
    for sid, _, pos, tags in rows:
        letters = "".join({"NNP": "N", "IN": "I"}.get(p, "O") for p in pos)
        spans = [m.span() for m in re.finditer("N+(?:IN+)?", letters)]
        marked = re.sub("(N+)I(N+)", r"\1X\2", letters)
        runs = [m.span() for m in re.finditer("[NX]+", marked)]
        assert [(c["start"], c["end"], c["full"]) for c in got[sid]["cands"]] == [(a, b, -100 not in tags[a:b]) for a, b in runs]
        assert got[sid]["inside"] == [c in "NX" for c in marked] and {a for a, _ in runs} <= {a for a, _ in spans}
    # A style that only looks inside candidates doesn't build them.
    plan = module.drop_entity_looking_unknowns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan


def test_compiled_softmax_and_draws_equal_the_plain_ones(spark):
    from pyspark.sql import functions as F

    from gleaner.functions.hashing import before_place, uniform
    from gleaner.operators import predictions
    nan = float("nan")
    vectors = [[1.0, 2.0, 3.5], [0.0, 0.0, 0.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [None, 1.0, 2.0], [nan, 1.0, 2.0], [], None, [900.0, -900.0, 1.0]]
    raw = spark.createDataFrame([(1, vectors, [1, 2, 0, 0, 1, 1, 1, 1, 0]), (2, vectors[:2], [-100, 1]), (3, None, [1])],
                                "sid long, logits array<array<double>>, label_ids array<int>")
    plain, compiled = (sorted(map(str, predictions.valid_softmax(raw, c).collect())) for c in (None, 3))
    assert plain == compiled and len(plain) == 10
    ids = spark.range(3000).select(F.col("id"), F.concat(F.lit("5:x:")).alias("head"))
    for share in (0.0, 0.3, 0.85, 1.0):
        both = ids.select((uniform(5, F.lit("x"), "id") < share).alias("a"), before_place(F.col("head"), F.col("id"), share).alias("b"))
        assert both.where("a <> b").count() == 0
