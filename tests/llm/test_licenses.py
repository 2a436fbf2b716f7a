import numpy as np

from gleaner.llm import licenses as L
from tests.llm.helpers import SCHEMA, documents, odd_rows


def plain_common(text, model):
    h = [[0] * (len(text) + 1) for _ in range(len(model) + 1)]
    for i, x in enumerate(model, 1):
        for j, y in enumerate(text, 1):
            h[i][j] = max(h[i - 1][j], h[i][j - 1], h[i - 1][j - 1] + (x == y))
    return h[-1][-1]


def test_wide_band_equals_plain_version():
    rng = np.random.default_rng(4)
    for _ in range(80):
        text, model = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 10))
        equal, first, end = L.banded(text, model, -len(model), len(text))
        assert equal == plain_common(text.tolist(), model.tolist())
        assert plain_common(text[first:end].tolist(), model.tolist()) == equal


def test_every_template_is_found_where_it_stands(spark):
    rows = [(i, f"some own words {i}\n{t}\nand a tail") for i, t in enumerate(L.TEMPLATES.values())]
    rows += [(100, "nothing to see here"), (101, "x " * 500 + L.TEMPLATES["isc"].replace("purpose", "end").upper() + " y" * 500)]
    out = L.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), L.templates(spark)).collect()
    got = {(r["doc_id"], r["template"]): r for r in out}
    for i, name in enumerate(L.TEMPLATES):
        r = got[i, name]
        assert r["coverage"] == 1.0 and r["first_word"] == 4
    assert 100 not in {d for d, _ in got}
    assert got[101, "isc"]["first_word"] == 500 and 0.9 < got[101, "isc"]["coverage"] < 1


def test_small_table_against_substrings(spark):
    docs = documents()
    short = {k: v for k, v in L.TEMPLATES.items() if k.endswith("short") or k == "cc-by-nc-4.0"}
    planted = {(d, k) for d, t in zip(docs["doc_id"], docs["text"], strict=True) for k, v in short.items() if v in t}
    out = {(r["doc_id"], r["template"]) for r in L.scan(spark.createDataFrame(docs[["doc_id", "text"]]), L.templates(spark)).where("coverage = 1").collect()}
    assert planted and {x for x in out if x[1] in short} == planted


def test_odd_rows_and_empty_tables(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    known = spark.createDataFrame([("t", "three four five six", 1), ("t", "three four five six", 1), ("u", None, 2), (None, "a b", 3)], "template string, text string, doc_id int")
    out = L.scan(rows, known).collect()
    assert sorted(r["doc_id"] or 0 for r in out) == [1, 2, 3, 12, 13] and {r["first_word"] for r in out} >= {2}
    assert L.scan(rows, known.limit(0)).count() == 0
    assert L.scan(rows.limit(0), known).count() == 0
