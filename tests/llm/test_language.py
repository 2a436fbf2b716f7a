from gleaner.llm import language as L
from gleaner.llm import queries
from tests.llm.helpers import SCHEMA, SMALL, documents, odd_rows


def test_held_out_accuracy(spark):
    langs = dict(documents()[["doc_id", "lang"]].itertuples(index=False))
    out = [r for r in queries.op5_language_id(spark, SMALL).collect() if r["held_out"]]
    right = sum(r["lang_pred"] == langs[r["doc_id"]] for r in out)
    assert len(out) > 30 and right / len(out) > 0.93
    assert sum(r["rejected"] for r in out) / len(out) < 0.05
    assert all(0 <= r["score"] <= 1 for r in out)


def test_only_text_decides(spark):
    """Predictions don't change with the columns that are no input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    learned = {"en": b"the and that with this there where they " * 40, "fr": "le la les des une avec pour dans qui est ".encode() * 40}
    once = [tuple(r)[1:] for r in L.predict(docs, learned).collect()]
    again = [tuple(r)[1:] for r in L.predict(docs.selectExpr("-doc_id as doc_id", "text", "'xx' as lang"), learned).collect()]
    assert once == again


def test_odd_rows(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    learned = L.learn(rows.select("doc_id", "text", "lang"))
    assert set(learned) == {"en", "de", "fr"}
    out = L.predict(rows, learned).collect()
    assert len(out) == rows.count()
    by_id = {r["doc_id"]: r for r in out}
    for i in (4, 5, 6, 14):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    kept = L.accepted(rows, learned)
    assert kept.columns == rows.columns and {4, 5, 6, 14}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_nothing_learned(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    assert L.learn(rows.where("lang is null").select("doc_id", "text", "lang")) == {}
    assert {r["lang_pred"] for r in L.predict(rows, {}).collect()} == {"und"}
    assert L.accepted(rows, {}).count() == rows.count()
    assert L.predict(rows.limit(0), {"en": b"the"}).count() == 0


def test_digits_and_marks_are_no_letters():
    assert L._judged("12 34 !? ²", ["en"], [None])[0] == "und"
    assert L._normal("Été 12, OK!") == "été ok "
