import dataclasses
import json
import os

import pytest
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions import tags as G
from gleaner.operators import annotate, initial, predictions, query, training
from gleaner.plans import loop, registry, rounds
from gleaner.sources import checked, corpus, files, results, views

FIRST = ["Anna", "Bert", "Carl", "Dora"]
LAST = ["Smith", "Jones"]


def flat_rows(spark, n=120):
    rows = []
    for i in range(n):
        name = [FIRST[i % 4], LAST[i % 2]]
        tokens = ["today", *name, "went", "to", ["Paris", "Rome"][i % 2]]
        pos = [21, 22, 22, 38, 35, 22]
        split = "train" if i % 6 < 4 else "validation" if i % 6 == 4 else "test"
        rows.append((str(i), tokens, pos, [0, 1, 2, 0, 0, 5], [0, 3, 3, 0, 0, 1], split))
    return spark.createDataFrame(rows, corpus.FLAT_SCHEMA)


def test_vocabularies():
    assert (len(G.CONLL_TAGS), len(G.CONLL_POS)) == (9, 47)
    assert (len(G.ONTONOTES_TAGS), len(G.ONTONOTES_POS)) == (37, 49)


def test_flat_corpus_round_trip(spark, tmp_path):
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        flat_rows(spark).write.format(fmt).save(path)
        made = corpus.conll2003(corpus.read_flat(spark, path, fmt))
        counts = {r["split"]: r["count"] for r in made.sentences.groupBy("split").count().collect()}
        assert counts == {"train": 79, "val_train": 1, "validation": 20, "test": 20}
        row = made.sentences.first()
        assert row["pos_tags_text"] == ["NN", "NNP", "NNP", "VBD", "TO", "NNP"]
        assert made.label_to_id["B-LOC"] == 5 and made.id_to_label[5] == "B-LOC"


def test_full_mode_uses_validation_twice(spark):
    made = corpus.conll2003(flat_rows(spark), full=True)
    counts = {r["split"]: r["count"] for r in made.sentences.groupBy("split").count().collect()}
    assert counts == {"train": 80, "val_train": 20, "validation": 20, "test": 20}


def test_nested_corpus_splits_documents(spark, tmp_path):
    rows = [(f"d{i}", [(["Anna", "ran"], [25, 40], [1, 0])] * (i % 3 + 1), "train") for i in range(150)]
    path = str(tmp_path / "nested")
    spark.createDataFrame(rows, corpus.NESTED_SCHEMA).write.parquet(path)
    made = corpus.ontonotes(corpus.read_nested(spark, path))
    held = made.sentences.where("split = 'val_train'").select("document_id").distinct().collect()
    assert len(held) == 2
    whole = made.sentences.groupBy("document_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
    assert whole == 0 and made.sentences.first()["pos_tags_text"] == ["NNP", "VBD"]


def test_io_corpora(spark):
    fine = corpus.fewnerd(flat_rows(spark), ["O", "loc-a", "loc-b", "person-x"], fine=True)
    assert fine.tags == ["O", "LOC-A", "LOC-B", "PERSON-X"]
    assert fine.sentences.first()["ner_tags"] == [0, 3, 3, 0, 0, 1]
    assert corpus.fewnerd(flat_rows(spark), ["O"]).sentences.first()["ner_tags"] == [0, 1, 2, 0, 0, 5]


def test_views(spark):
    s = corpus.conll2003(flat_rows(spark)).sentences.withColumn("sid", F.col("id").cast("long")).where("sid = 0")
    row = views.text_view(s, G.CONLL_TAGS).first()
    assert row["text"] == "today Anna Smith went to Paris" and row["ner_tags"] == "O B-PER I-PER O O B-LOC"
    nouns = views.text_view(s, G.CONLL_TAGS, proper_nouns_only=True).first()
    assert (nouns["text"], nouns["pos_tags"]) == ("Anna Smith Paris", "NNP NNP NNP")
    with pytest.raises(ValueError, match="part-of-speech"):
        views.text_view(s.drop("pos_tags_text"), G.CONLL_TAGS, proper_nouns_only=True)
    assert views.text_view(s.drop("pos_tags_text"), G.CONLL_TAGS).first()["pos_tags"] == ""


def test_align_labels(spark):
    row = spark.createDataFrame(
        [([None, 0, 1, 2, 2, 3, None], [5, 6, 7, 8])], "word_ids array<int>, ner_tags array<int>")
    u = UNKNOWN
    assert views.align_labels(row).first()["labels"] == [u, 5, 6, 7, u, 8, u]


def test_types_of_tags(spark):
    names = ["O", "B-PER", "I-" + "X" * 12_000, "ART-FILM"]
    rows = spark.createDataFrame([(n,) for n in names], "tag string").select(G.entity_type(F.col("tag")).alias("t"))
    assert [r["t"] for r in rows.collect()] == [None, "PER", "X" * 12_000, "ART-FILM"]


def test_corpus_without_part_of_speech(spark):
    """Text comes through; whatever needs the tags fails instead of losing rows."""
    made = corpus.fewnerd(flat_rows(spark), ["O", "B-A", "I-A", "X", "Y", "Z"])
    s = made.sentences.withColumn("sid", F.col("id").cast("long"))
    assert "pos_tags_text" not in s.columns
    nulls = s.withColumn("pos_tags_text", F.lit(None).cast("array<string>"))
    for rows in (s, nulls):
        view = views.text_view(rows, made.tags).where("sid = 0").first()
        assert view["text"] == "today Anna Smith went to Paris" and view["pos_tags"] == ""
        assert initial.longest(views.text_view(rows, made.tags), 3).first()["score"] == 6
        marked = rows.withColumn("al_tags", F.col("ner_tags"))
        for style in (training.MASK_ENTITY, training.DROP_ENTITY, training.DYNAMIC_WINDOW):
            with pytest.raises(Exception, match="part-of-speech"):
                training.materialize(marked, style).collect()
        for choose in (lambda: initial.nnp_filter(rows, 5, 0.5), lambda: initial.nnp_frequency(corpus.to_tokens(rows, made.tags), 5),
                       lambda: views.text_view(rows, made.tags, proper_nouns_only=True)):
            with pytest.raises(Exception, match="part-of-speech"):
                choose().collect()


def test_proper_nouns_for_every_strategy(spark):
    s = corpus.conll2003(flat_rows(spark)).sentences.where("id = '0'")
    row = loop.proper_nouns(s).first()
    assert (row["tokens"], row["ner_tags"], row["pos_tags_text"]) == (["Anna", "Smith", "Paris"], [1, 2, 5], ["NNP"] * 3)
    assert loop.with_ids(s).columns[-1] == "sid" and loop.with_ids(loop.with_ids(s)).first()["sid"] == 0


@pytest.fixture(scope="module")
def small_corpus(spark):
    made = corpus.conll2003(flat_rows(spark))
    return corpus.Corpus(loop.with_ids(made.sentences).cache(), made.tags, made.pos)


@pytest.mark.parametrize("level, strategy, style", [
    (query.ENTITY, query.BREAKING_TIES, training.DYNAMIC_WINDOW),
    (query.SENTENCE, query.ENTROPY, training.MASK_ALL),
])
def test_loop(spark, small_corpus, tmp_path, level, strategy, style):
    config = loop.RunConfig(level=level, strategy=strategy, style=style, rounds=2, starting_ratio=0.05,
                            new_examples=[6], features=1 << 10, iterations=5)
    table, labelled = loop.run(spark, small_corpus, config)
    log = str(tmp_path / "log")
    assert [results.append(table, log), results.append(table, log), results.append(table.where("round = 1"), log)] == [2, 0, 0]
    log = results.read(spark, log, loop.RESULT_SCHEMA)
    assert log.count() == 2 and sorted(map(repr, log.collect())) == sorted(map(repr, table.collect())) and json.loads(log.first()["config"])["rounds"] == 2
    rows = sorted(table.collect(), key=lambda r: r["round"])
    annotated = [r["n_annotated"] for r in rows]
    assert annotated[0] == 3 * 6 and annotated == sorted(set(annotated))
    assert labelled.count() == annotated[-1] and labelled.select("sid", "tid").distinct().count() == annotated[-1]
    for r in rows:
        assert sum(t["n"] for t in r["distribution"]) == r["n_annotated"]
        assert {s["split"] for s in r["scores"]} == {"validation", "val_train", "test"}
        overall = [s for s in r["scores"] if s["split"] == "test" and s["type"] == "overall"]
        assert overall[0]["accuracy"] > 0.5


def files_below(path):
    return sum(len(f) for _, _, f in os.walk(path))


@pytest.mark.parametrize("level, stops", [(query.ENTITY, (1, 3)), (query.SENTENCE, (2,))])
def test_a_broken_run_goes_on(spark, small_corpus, tmp_path, level, stops):
    """Broken off while it trains for the n-th time, once or twice, and called again, it ends as an unbroken one."""
    config = loop.RunConfig(level=level, strategy=query.BREAKING_TIES, rounds=3, starting_ratio=0.05, new_examples=[5, 4])
    whole, labelled = loop.run(spark, small_corpus, config, registry._frequency_model, path=str(tmp_path / "whole"))
    trained = []

    def fit(*args):
        trained.append(1)
        if len(trained) in stops:
            raise InterruptedError
        return registry._frequency_model(*args)

    path = str(tmp_path / "broken")
    for done in range(len(stops)):
        with pytest.raises(InterruptedError):
            loop.run(spark, small_corpus, config, fit, path=path)
        assert loop.records(spark, rounds.RunStore(spark, path), 3).count() == stops[done] - 1 - done
        os.makedirs(f"{path}/labelled/round=7/orphan")  # what a broken step left
    again, relabelled = loop.run(spark, small_corpus, config, fit, path=path)
    assert not os.path.exists(f"{path}/labelled/round=7/orphan")
    assert sorted(relabelled.collect()) == sorted(labelled.collect())
    assert relabelled.select("sid", "tid").distinct().count() == relabelled.count()
    drop = lambda t: sorted(map(repr, t.drop("run").collect()))
    assert drop(again) == drop(whole) and again.select("run").distinct().count() == 1
    before = files_below(path), len(trained)
    assert drop(loop.run(spark, small_corpus, config, fit, path=path)[0]) == drop(whole)
    assert (files_below(path), len(trained)) == before  # nothing left to do
    longer = dataclasses.replace(config, rounds=4)
    assert loop.run(spark, small_corpus, longer, fit, path=path)[0].count() == 4
    with pytest.raises(ValueError, match="other settings"):
        loop.run(spark, small_corpus, dataclasses.replace(config, seed=2), fit, path=path)


def test_rounds_leave_no_checkpoints(spark, small_corpus, tmp_path):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    config = loop.RunConfig(level=query.TOKEN, strategy=query.ENTROPY, rounds=3, starting_ratio=0.05, new_examples=[3])
    before = set(os.listdir(folder))
    loop.run(spark, small_corpus, config, registry._frequency_model, path=str(tmp_path / "run"))
    assert set(os.listdir(folder)) == before


def test_log_holds_each_record_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "run string, round int, v string"
    rows = spark.createDataFrame([("a/b", 0, "x"), ("a/b", 1, "y"), ("c", 0, "z")], schema)
    assert results.read(spark, path, schema).count() == 0
    assert results.append(rows.where("round = 0"), path) == 2
    changed = rows.withColumn("v", F.lit("other"))
    assert results.append(changed, path) == 1  # only what is new; the rest stays as it was
    # An append that broke off before its markers, and one that lost the race for them.
    rows.write.json(f"{path}/data/part=broken")
    assert not files.put(spark, f"{path}/commits/c-000000.json", "{}")
    assert sorted(map(tuple, results.read(spark, path, schema).collect())) == [("a/b", 0, "x"), ("a/b", 1, "other"), ("c", 0, "z")]
    with pytest.raises(ValueError, match="no two the same"):
        results.append(rows.unionByName(rows), path)


def test_predictions_must_fit_the_tokens(spark, small_corpus):
    gold = corpus.to_tokens(small_corpus.sentences.where("split = 'train'"), small_corpus.tags)
    pred = gold.select("sid", "tid", F.array(*[F.lit(1.0 / 9)] * 9).alias("scores"))
    for level in query.LEVELS:
        for strategy in (query.RANDOM, query.ENTROPY):
            assert query.query(level, strategy, pred, gold, gold.limit(0), 3).selections.count() >= 3
            with pytest.raises(ValueError, match="predictions and tokens differ"):
                query.query(level, strategy, pred.where("sid <> 4 or tid <> 0"), gold, gold.limit(0), 3)
    short = query.query(query.TOKEN, query.ENTROPY, pred.where("sid <> 4"), gold, gold.limit(0), 3, guard=False)
    assert short.selections.count() == 3


@pytest.mark.parametrize("wrong", [
    {"initial": "other"}, {"level": "word"}, {"strategy": "best"}, {"style": "x"}, {"metric": "f2"}, {"starting_ratio": 0.0},
    {"starting_ratio": 1.5}, {"new_examples": []}, {"new_examples": [5, -1]}, {"rounds": 0}, {"iterations": 0},
])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        loop.RunConfig(**wrong)


def test_io_tags_need_the_io_metric(spark, small_corpus):
    io = corpus.Corpus(small_corpus.sentences, ["O", "PER", "LOC"])
    with pytest.raises(ValueError, match="io"):
        loop.run(spark, io, loop.RunConfig(starting_ratio=0.5))
    assert loop.RunConfig(full=True, starting_ratio=0.0).full


@pytest.mark.parametrize("name", loop.INITIAL)
def test_initial_by_name(spark, small_corpus, name):
    train = small_corpus.sentences.where("split = 'train'")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "sid long")
    lm = corpus.to_tokens(train, small_corpus.tags).select("sid", "tid", F.array(F.col("tid") + 1.0, F.col("sid") * 1.0, F.lit(0.5)).alias("logits"))
    config = loop.RunConfig(initial=name, starting_ratio=0.05, alpha=0.5)
    chosen = [r["sid"] for r in loop.choose_initial(train, small_corpus.tags, config, ids, lm).collect()]
    assert len(set(chosen)) == len(chosen) == 3


def test_rejects_add_up_with_accepted_rows(spark, tmp_path):
    good = {"id": "1", "tokens": ["a", "b"], "pos_tags": [0, 1], "ner_tags": [0, 2], "split": "train"}
    lines = {
        json.dumps(good): None, "": None, json.dumps(good)[:30]: ["corrupt"], "[1, 2": ["corrupt"],
        json.dumps({**good, "id": None, "split": "dev"}): ["id", "split"], json.dumps({**good, "tokens": ["a", None]}): ["tokens"],
        json.dumps({k: v for k, v in good.items() if k != "tokens"}): ["tokens"],
        json.dumps({**good, "ner_tags": [0]}): ["ner_tags length"], json.dumps({**good, "ner_tags": [0, 3], "pos_tags": [-1, None]}): ["ner_tags range", "pos_tags range"],
        json.dumps({**good, "pos_tags": None}): ["pos_tags"], json.dumps({**good, "tokens": [], "pos_tags": [], "ner_tags": []}): None,
    }
    (tmp_path / "flat.json").write_text("\n".join(lines))
    out = checked.read_flat(spark, str(tmp_path / "flat.json"), "json", 3, 2)
    assert out.accepted.count() == 2 and out.accepted.columns == ["id", "tokens", "pos_tags", "ner_tags", "fine_ner_tags", "split"]
    found = {r["record"]: r["reasons"] for r in out.rejects.collect()}
    want = {k: v for k, v in lines.items() if v}
    assert sorted(found.values()) == sorted(want.values()) and found["[1, 2"] == ["corrupt"] == found[json.dumps(good)[:30]]
    # Without part-of-speech tags they are not asked for; the fine tags are where they are wanted.
    assert checked.read_flat(spark, str(tmp_path / "flat.json"), "json", 3).accepted.count() == 3
    assert {tuple(r["reasons"]) for r in checked.read_flat(spark, str(tmp_path / "flat.json"), "json", 3, None, 9).rejects.collect()} >= {("fine_ner_tags",)}
    flat_rows(spark).drop("ner_tags").write.parquet(str(tmp_path / "short"))
    short = checked.read_flat(spark, str(tmp_path / "short"), "parquet", 9, 47)
    assert short.accepted.count() == 0 and {tuple(r["reasons"]) for r in short.rejects.collect()} == {("ner_tags",)}


def test_nested_rejects(spark, tmp_path):
    good = {"words": ["a", "b"], "pos_tags": [0, 1], "named_entities": [0, 2]}
    documents = [("1", [good, good], "train", None), ("2", [], "test", None), ("3", None, "train", ["sentences"]), ("4", [good, None], "train", ["sentences"]),
                 ("5", [good, {**good, "named_entities": [0]}], "train", ["ner_tags length"]), ("6", [{**good, "pos_tags": [7, 0]}, {**good, "words": None}], "train", ["tokens", "pos_tags range"])]
    (tmp_path / "d.json").write_text("\n".join(json.dumps({"document_id": i, "sentences": s, "split": p}) for i, s, p, _ in documents) + "\n{x")
    out = checked.read_nested(spark, str(tmp_path / "d.json"), "json", 3, 2)
    assert {r["document_id"] for r in out.accepted.collect()} == {"1", "2"}
    assert {r["id"]: r["reasons"] for r in out.rejects.collect()} == {None: ["corrupt"], **{i: w for i, _, _, w in documents if w}}


def test_labels_are_not_broadcast_for_small_files(spark, tmp_path):
    """A small file of labels may stand for many rows, which a broadcast would bring to the driver."""
    store = rounds.RunStore(spark, str(tmp_path / "run"))
    store.keep("labelled", spark.range(50).selectExpr("id AS sid", "0L AS tid", "'O' AS tag"))
    sentences = spark.createDataFrame([(1, ["a", "b"])], "sid long, tokens array<string>")
    known = store.labelled().withColumn("tag_id", F.lit(0))
    pool = spark.createDataFrame([(1, 0), (60, 0)], "sid long, tid long")
    left = predictions.without_labelled_tokens(pool, store.labelled())
    for rows in (annotate.to_arrays(sentences, known), annotate.to_arrays(sentences, spark.createDataFrame([(1, 0, 0)], "sid long, tid long, tag_id int")), left):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in left.collect()] == [(60, 0)]
    assert [r["al_tags"] for r in annotate.to_arrays(sentences, known).collect()] == [[0, -100]]


def test_pairs_of_sentences_are_those_of_the_join(spark):
    """By stretches as token by token: sentences without guesses, guesses without a token, gaps, repeats, turned order, missing tags."""
    tags = ["O", "B-PER", "I-PER"]
    sentences = spark.createDataFrame(
        [(1, ["a", "b", "c"], [0, 1, 2]), (2, ["a"], [2]), (3, ["a", "b"], [1, 1]), (4, [], []), (5, ["a", "b"], [1])], "sid long, tokens array<string>, ner_tags array<int>")
    guessed = [(1, 2, 0), (1, 0, 1), (1, 1, 2), (1, 3, 1), (1, 1, 0), (2, 0, None), (9, 0, 1), (5, 0, 0), (5, 1, 2), (5, -1, 2), (4, 0, 1), (None, 0, 1), (3, None, 1), (3, 1 << 40, 1)]
    guessed = spark.createDataFrame(guessed, "sid long, tid long, tag_id int").coalesce(1)
    out = predictions.pairs_of_sentences(sentences, guessed, tags)
    gold = corpus.to_tokens(sentences, tags).select("sid", "tid", F.col("tag").alias("gold"))
    want = gold.join(guessed.select("sid", "tid", predictions.decode(F.col("tag_id"), tags).alias("pred")), ["sid", "tid"])
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.select("sid", "tid", "gold", "pred").collect())) and out.count() == 7


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_held_out_tokens_are_not_shuffled_one_by_one(spark):
    """Gold tags go by sentence and guesses by stretch; the windows over runs take the pairs as they lie."""
    sentences = spark.range(40).selectExpr("id AS sid", "array('a', 'b', 'c') AS tokens", "array(0, 1, 2) AS ner_tags", "elt(id % 3 + 1, 'validation', 'val_train', 'test') AS split")
    predict = lambda rows: corpus.to_tokens(rows, ["O", "B-PER", "I-PER"]).select("sid", "tid", F.array(F.lit(0.1), F.lit(0.8), F.lit(0.1)).alias("scores"))
    held = loop.evaluate_splits(sentences, predict, ["O", "B-PER", "I-PER"], "bio")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(sid#" in plan and "tid#" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x)
    assert sorted((r["split"], r["type"], r["number"]) for r in held.collect())[:2] == [("test", "PER", 13), ("test", "overall", 13)]


def test_rounds_look_for_labels_among_reached_sentences_only(spark, small_corpus, tmp_path):
    """What a round trains on comes from the sentences that carry labels, which are kept once each; an older run without them gets them."""
    config = loop.RunConfig(level=query.TOKEN, strategy=query.ENTROPY, rounds=3, starting_ratio=0.05, new_examples=[5])
    path = str(tmp_path / "run")
    labelled = loop.run(spark, small_corpus, config, registry._frequency_model, path=path)[1].collect()
    reached = rounds.RunStore(spark, path).all_data(rounds.REACHED, 2)
    assert sorted(r["sid"] for r in reached.collect()) == sorted({r["sid"] for r in labelled})
    for name in os.listdir(f"{path}/steps"):
        if "reached" in name or "000002" in name or "000001-scored" in name:
            os.remove(f"{path}/steps/{name}")
    again = loop.run(spark, small_corpus, config, registry._frequency_model, path=path)[1]
    assert sorted(again.collect()) == sorted(labelled)
    steps = rounds.RunStore(spark, path)
    assert sum(steps.data(rounds.REACHED, n).count() for n in range(3)) == again.select("sid").distinct().count()
