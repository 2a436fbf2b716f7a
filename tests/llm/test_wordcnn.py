import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import queries
from gleaner.llm import wordcnn as C
from gleaner.llm.words import SEPARATORS, text_blocks, words_of
from tests.llm.helpers import SCHEMA, SMALL, odd_rows

LANGUAGES = {"en": ("the of and to in is", "vile"), "de": ("der die und das nicht ist", "wurst")}


def made(n, seed=0):
    """Texts of invented words between frequent ones; label 1 where a form of the language's bad stem stands somewhere."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        common, bad = LANGUAGES[lang]
        words = ["".join(rng.choice(list("abcdefghij"), 5)) if rng.random() < 0.5 else rng.choice(common.split()) for _ in range(int(rng.integers(20, 120)))]
        label = int(rng.random() < 0.3)
        if label:
            for _ in range(2):
                words.insert(int(rng.integers(0, len(words))), bad + "".join(rng.choice(list("xyz"), 2)))
        rows.append((i, " ".join(words), lang, label))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = made(700)
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, label int")
    return C.learn(labels, df)


def test_held_out_accuracy_by_stems(spark, learned):
    rows = made(400, 1)
    out = {r["doc_id"]: r for r in C.score(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), learned).collect()}
    said = [(out[i]["score"] >= 0.5, label) for i, _, _, label in rows]
    assert sum(p for p, y in said if y) / sum(y for _, y in said) > 0.95
    assert sum(p for p, y in said if not y) / sum(not y for _, y in said) < 0.02
    assert all(out[i]["lang_guess"] == lang for i, _, lang, _ in rows)


def test_registered_query(spark):
    labels = dict(pq.read_table(f"{SMALL}/labels.parquet").to_pandas()[["doc_id", "toxic"]].itertuples(index=False))
    out = queries.op13_toxicity(spark, SMALL).collect()
    assert len(out) == pq.read_table(f"{SMALL}/documents.parquet").num_rows
    seen = [r for r in out if not r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in seen) / len(seen) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def plain_logit(net, text):
    """One text, word by word."""
    vectors = []
    for word in re.findall(r"[0-9a-zA-Z\x80-\xff]+", text.encode().decode("latin1")):
        texts = next(text_blocks(pa.array([word.encode("latin1").decode("utf8")])))
        found = words_of(texts, lower=True, breaks=SEPARATORS)
        vectors.append(net.vectors[net.rows(C.parts_of(texts, found))[0]].sum(axis=0))
    vectors = vectors or [np.zeros(C.DIM)]
    vectors += [np.zeros(C.DIM)] * C._PAD
    sums = [np.max([np.concatenate(vectors[i: i + w]) @ f for i in range(len(vectors) - C._PAD)], axis=0) for w, f in zip(C.WIDTHS, net.filters, strict=True)]
    return net.logits(np.concatenate(sums)[None])[0]


@pytest.mark.parametrize("slab", [1, 7, 1 << 14])
def test_whole_texts_are_scored(learned, monkeypatch, slab):
    monkeypatch.setattr(C, "_SLAB", slab)
    texts = ["", "the", " \n", "wurstxx", *[r[1] for r in made(5, 2)], "naïve vilexy été " * 30, "", "zz, VILEXX! of"]
    block = next(text_blocks(pa.array(texts)))
    words = words_of(block, lower=True, breaks=SEPARATORS)
    got = learned.logits(C._pooled(learned, learned.rows(C.parts_of(block, words)), words.first))
    assert np.abs(got - [plain_logit(learned, t) for t in texts]).max() < 1e-4


def test_slopes_are_those_of_the_loss(learned):
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, len(learned.owners), (n, C._PARTS)) for n in (9, 4)] + [np.zeros((0, C._PARTS), np.int64)]
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        z = learned.logits(C._pooled(learned, np.concatenate(rows), first)).astype(float)
        return -np.log(C._sigmoid(np.where(labels == 1, z, -z))).mean()

    for part, (at, slope) in zip([learned.vectors, *learned.dense()], C.slopes(learned, rows, labels), strict=True):
        whole = np.zeros_like(part)
        whole[at] = slope
        i = np.unravel_index(int(np.abs(whole).argmax()), whole.shape)
        old = part[i]
        part[i] = old + 1e-2
        up = loss()
        part[i] = old - 1e-2
        down = loss()
        part[i] = old
        assert abs((up - down) / 2e-2 - whole[i]) < 2e-2 + 0.05 * abs(whole[i])


def test_threshold():
    y = np.array([0, 0, 1, 0, 1, 1.0])
    z = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 9.0])
    assert C.best_threshold(z, y, np.ones(6)) == 1.5  # one wrong against all three found
    assert C.best_threshold(z, y, np.where(y == 1, 1.0, 50.0)) == 3.5  # where clean texts abound, leave them alone
    assert C.best_threshold(z, np.ones(6), np.ones(6)) == 0.0


def test_odd_rows_and_missing_labels(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    labels = spark.createDataFrame([(1, 1), (9, 0), (4, 0), (5, None), (None, 1), (77, 1)], "doc_id long, label int")
    out = C.score(rows, C.learn(labels, rows)).collect()
    assert len(out) == rows.count() and all(0 <= r["score"] <= 1 for r in out)
    texts = rows.select("doc_id", "text")
    assert C.learn(labels.where("label = 1"), texts) == 1.0
    assert C.learn(labels.where("doc_id = 77 or doc_id = 9"), texts) == 0.0  # document 77 has no text
    assert C.learn(labels.where("doc_id = 77"), texts) == 0.5 and C.learn(labels.limit(0), texts) == 0.5
    assert C.score(rows.limit(0), 0.5).count() == 0
    assert {r["score"] for r in C.score(rows, 0.5).collect()} == {0.5}


def test_training_reads_long_texts_whole():
    """Every place of a drawn text comes to the driver, however long the text."""
    words = [f"w{i % 700}q" for i in range(9_001)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 0], pa.int32()), pa.array([0.1, 0.2]), pa.array(["en", None]), pa.array([" ".join(words), ""])], names=["label", "u", "lang", "text"])
    rows = [r for out in C._sampled(iter([batch])) for r in out.to_pylist()]
    distinct = np.frombuffer(rows[0]["words"], np.uint32).reshape(-1, C._PARTS)
    turns = np.frombuffer(rows[0]["turns"], C._turn_type(len(distinct)))
    texts = next(text_blocks(pa.array([" ".join(words)])))
    assert (distinct[turns] == C.parts_of(texts, words_of(texts, lower=True, breaks=SEPARATORS))).all() and len(turns) == 9_001
    assert len(distinct) == 700 and rows[1]["turns"] == b""


def test_slopes_in_groups_are_those_of_the_batch(learned, monkeypatch):
    rng = np.random.default_rng(3)
    coded = [(rng.integers(0, len(learned.vectors), (20, C._PARTS)), rng.integers(0, 20, n).astype(np.uint16)) for n in (30, 0, 7, 90, 12)]
    labels = np.array([1.0, 0, 0, 1, 0])
    whole = C._mean_slopes(learned, coded, labels)
    monkeypatch.setattr(C, "GROUP_WORDS", 40)
    parts = C._mean_slopes(learned, coded, labels)
    for (at, g), (some, h) in zip(whole, parts, strict=True):
        assert isinstance(at, slice) or (at == some).all()
        assert np.allclose(g, h, atol=1e-6)


@pytest.fixture
def many(spark, monkeypatch):
    """Tables of which the driver may take a tenth only."""
    for name, n in (("SAMPLE_ROWS", 60), ("WORKER_ROWS", 150), ("BLOCK_ROWS", 64)):
        monkeypatch.setattr(C, name, n)
    rows = made(900, 5)
    return rows, spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(5), \
        spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, label int")


def test_every_labelled_row_is_learned_from(spark, many, monkeypatch):
    """Each row beyond what the driver takes either trains the network or sets its thresholds."""
    rows, docs, labels = many
    dealt, read = [], []
    cut, rest = C.cut_lineage, C._calibrate_to_all
    monkeypatch.setattr(C, "cut_lineage", lambda df: dealt.append(cut(df)) or dealt[-1])
    monkeypatch.setattr(C, "_calibrate_to_all", lambda net, some, *a: read.append(some.count()) or rest(net, some, *a))
    net = C.learn(labels, docs)
    trained = [df for df in dealt if "worker" in df.columns]
    assert len(trained) == 1 and trained[0].count() + read[0] == len(rows) and trained[0].count() > 2 * 2 * C.SAMPLE_ROWS
    fresh = made(400, 6)
    out = {r["doc_id"]: r for r in C.score(spark.createDataFrame([r[:2] for r in fresh], "doc_id long, text string"), net).collect()}
    assert sum((out[i]["score"] >= 0.5) == bool(label) for i, _, _, label in fresh) > 0.95 * len(fresh)
    assert all(out[i]["lang_guess"] == lang for i, _, lang, _ in fresh)


def test_parts_are_counted_in_all_rows(spark, many):
    """Known parts and first weights are those that the driver would find in all rows."""
    rows, docs, labels = many
    known = docs.join(labels, "doc_id").select("label", F.lit(0.5).alias("u"), "lang", "text")
    sizes = {y: sum(r[3] == y for r in rows) for y in (0, 1)}
    net = C._started_from_all(known, sizes, np.random.default_rng(1))
    batch = pa.RecordBatch.from_arrays([pa.array([r[3] for r in rows], pa.int32()), pa.array([0.5] * len(rows)), pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])],
                                       names=["label", "u", "lang", "text"])
    drawn = []
    for r in [r for out in C._sampled(iter([batch])) for r in out.to_pylist()]:
        words = np.frombuffer(r["words"], np.uint32).reshape(-1, C._PARTS)
        drawn.append((C.Drawn(words, np.frombuffer(r["turns"], C._turn_type(len(words))), r["lang"]), float(r["label"])))
    want = C._started(drawn, np.random.default_rng(1))
    assert (net.owners == want.owners).all() and (net.places == want.places).all() and net.languages == want.languages
    assert np.allclose(net.vectors, want.vectors) and np.allclose(net.tongues, want.tongues) and np.allclose(net.prior, want.prior)
