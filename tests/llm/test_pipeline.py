import corpus_pipeline as P
from gleaner.llm import decontaminate, minhash, mixing
from tests.llm.helpers import SCHEMA, SMALL, odd_rows, words
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_minhash import expected as plain_components


def test_stages_against_plain_versions(spark):
    """Each stage on what the one before it kept; its decisions by a plain version of its rule."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SMALL).toPandas())
        kept.append((name, before, docs.collect()))
    stages = {name: (before, after) for name, before, after in kept}
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    for name in list(stages)[:-1]:
        assert [x for x in stages[name][1][0].asDict()] == ["doc_id", "text", "lang", "source", "n_chars"]

    before, after = stages["language_id"]
    assert len(after) > 0.95 * len(before)
    languages = {r["doc_id"]: r["lang"] for r in before}
    assert sum(r["lang"] == languages[r["doc_id"]] for r in after) > 0.95 * len(after)

    before, after = stages["line_dedup"]
    removed = plain_lines([(r["doc_id"], r["text"]) for r in before], 60)
    texts = {r["doc_id"]: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in set(removed[r["doc_id"]])) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == {i: t for i, t in texts.items() if words(t)}
    assert all(r["n_chars"] == len(r["text"]) for r in after if removed[r["doc_id"]])

    before, after = stages["near_dedup"]
    component, _ = plain_components([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == {i for i, c in component.items() if i == c}

    before, after = stages["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in before if any(t in r["text"] for t in items)}
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == leaked

    before, after = stages["mixing"]
    tokens = sum(len(words(r["text"])) for r in before)
    assert abs(sum(r["n_tokens"] for r in after) / tokens - mixing.BUDGET) < 0.15
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}


def test_run_equals_the_stages(spark):
    once = P.run(spark, SMALL)
    assert once.count() and {"weight", "prob", "topic", "n_tokens"} <= set(once.columns)


def test_odd_rows_through_every_stage(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() <= docs.count(), name
        assert name == "mixing" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).count() == 0, name


def test_repeated_ids_leave_one_row(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13), (2, "a b c d e f g", "en", "s", 13), (None, "x", "en", "s", 1)]
    out = P.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 1]
    assert decontaminate.N and minhash.K
