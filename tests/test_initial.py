import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions.hashing import uniform
from gleaner.operators import greedy, initial, vectors
from gleaner.operators.tfidf import Vectorizer, tfidf

STOPS = ["the", "of"]
ONE = Vectorizer(ngrams=(1, 1), stop_words=STOPS)
UNIT = Vectorizer(ngrams=(1, 1), stop_words=STOPS, norm="l2")


def corpus(n, seed=5, vocabulary=40):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(vocabulary)] + STOPS
    rows = [(i, " ".join(rng.choice(names[: rng.randint(2, len(names))]) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    rows[3] = (3, "x")  # No terms at all.
    rows[5] = (5, rows[4][1])  # A copy.
    return rows


def weights(rows, stops=STOPS, unit=False):
    bags = {i: Counter(w for w in t.lower().split() if len(w) > 1 and w not in stops) for i, t in rows}
    df = Counter(w for b in bags.values() for w in b)
    out = {i: {w: c * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, c in b.items()} for i, b in bags.items()}
    if unit:
        for b in out.values():
            length = math.sqrt(sum(v * v for v in b.values()))
            for w in b:
                b[w] /= length
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus(60)


@pytest.fixture(scope="module")
def texts(spark, rows):
    return spark.createDataFrame(rows, "sid long, text string").repartition(3).cache()


def test_tfidf(texts, rows):
    found = {(r["sid"], r["term"]): r["w"] for r in tfidf(texts, Vectorizer((1, 1), STOPS, None)).collect()}
    expected = {(i, w): v for i, b in weights(rows).items() for w, v in b.items()}
    assert found == pytest.approx(expected)


def test_bigrams_bridge_stop_words(spark):
    df = spark.createDataFrame([(0, "Ab of cd. Ef")], "sid long, text string")
    terms = {r["term"] for r in tfidf(df, Vectorizer((1, 2), STOPS)).collect()}
    assert terms == {"ab", "cd", "ef", "ab cd", "cd ef"}


def mean_of_top(values, k):
    best = sorted(values, reverse=True)[:k]
    return round(sum(best) / len(best), 9) if sum(values) >= 1e-6 else 0.0


@pytest.mark.parametrize("batch", [2, 100])
def test_without_repeats_equals_full_rescan(texts, rows, batch):
    left, picks = weights(rows), []
    while len(picks) < 12:
        best = min((i for i in left if i not in picks), key=lambda i: (-mean_of_top(list(left[i].values()), 3), i))
        picks.append(best)
        gone = set(left[best])
        for b in left.values():
            for w in gone & set(b):
                b[w] /= 2
    found = greedy.without_repeats(texts, 12, 3, ONE, batch).orderBy("step").collect()
    assert [r["sid"] for r in found] == picks


@pytest.mark.parametrize("batch", [2, 100])
def test_cover_equals_full_rescan(spark, batch):
    rng = random.Random(9)
    sents = {i: [(f"w{rng.randrange(30)}", rng.choice(["O", "B-PER"])) for _ in range(rng.randint(1, 9))] for i in range(50)}
    tokens = spark.createDataFrame(
        [(i, t, w, tag) for i, s in sents.items() for t, (w, tag) in enumerate(s)], "sid long, tid long, token string, tag string")
    from gleaner.functions.hashing import uniform
    tie = {r["sid"]: r["u"] for r in spark.range(50).select(F.col("id").alias("sid"), uniform(1, "id").alias("u")).collect()}
    seen, picks = set(), []
    while len(picks) < 15:
        worth = lambda i: sum(1 for w, tag in sents[i] if tag != "O" and w not in seen)
        best = min((i for i in sents if i not in picks), key=lambda i: (-worth(i), tie[i]))
        picks.append(best)
        seen |= {w for w, tag in sents[best] if tag != "O"}
    found = greedy.cover(tokens, 15, batch=batch).orderBy("step").collect()
    assert [r["sid"] for r in found] == picks


def test_greedy_spreads_out_terms_of_few_rows(texts, rows, monkeypatch):
    """The corpus is stored as one row per text; only the rows looked at are spread out to their terms."""
    stored = []

    def kept(df, cut=greedy.cut_lineage):
        stored.append(cut(df))
        return stored[-1]
    monkeypatch.setattr(greedy, "cut_lineage", kept)
    greedy.without_repeats(texts, 2, how=ONE, batch=1).collect()
    every = sum(map(len, weights(rows).values()))
    spread = [df.count() for df in stored if {"sid", "term"} <= set(df.columns)]
    assert spread and max(spread) < every / 2


@pytest.mark.parametrize("block, hot", [(4, 10**6), (64, 2)])
def test_most_dissimilar_equals_all_pairs(texts, rows, block, hot):
    w = weights(rows, unit=True)
    dot = lambda a, b: sum(v * b.get(t, 0.0) for t, v in a.items())
    score = {i: round(1 - max(dot(w[i], w[j]) for j in w if j != i), 9) + 0.0 for i in w}
    expected = sorted(score.items(), key=lambda p: (-p[1], p[0]))[:10]
    found = vectors.most_dissimilar(texts, 10, UNIT, block, hot).collect()
    assert [(r["sid"], pytest.approx(r["score"], abs=2e-9)) for r in found] == expected


def test_most_dissimilar_settles_few_rows(spark, caplog):
    """Copies of everything, and words shared by all: neither has every row compared with the table."""
    once = [(i, f"common shared own{i} own{i} other{i % 7}") for i in range(1, 400)]
    rows = [(-1, "of the"), (-2, "lonely")] + once + [(1000 + i, t) for i, t in once]
    df = spark.createDataFrame(rows, "sid long, text string").repartition(3)
    with caplog.at_level("INFO", "gleaner.operators.vectors"):
        found = [tuple(r) for r in vectors.most_dissimilar(df, 8, UNIT, block=4).collect()]
    assert sorted(found, key=lambda p: (-p[1], p[0])) == [(-2, 1.0), (-1, 1.0)] + [(i, 0.0) for i in range(1, 7)]
    passes = [r.args[1] for r in caplog.records if "to settle" in r.msg]
    assert passes and sum(passes) <= 12

    # Each row is near one that weighs their common word more: all but a few are settled by that.
    df = spark.createDataFrame([(i, f"topic{i % 5} topic{i % 5} x{i} y{i}") for i in range(300)] + [(300 + i, f"topic{i}") for i in range(5)]
                               + [(900, "far away"), (901, "quite odd away")], "sid long, text string")
    caplog.clear()
    with caplog.at_level("INFO", "gleaner.operators.vectors"):
        found = [r["sid"] for r in vectors.most_dissimilar(df, 2, UNIT, block=4).orderBy(F.desc("score"), "sid").collect()]
    w = weights([tuple(r) for r in df.collect()], unit=True)
    score = {i: round(1 - max(sum(v * w[j].get(t, 0.0) for t, v in w[i].items()) for j in w if j != i), 9) for i in w}
    assert found == sorted(score, key=lambda i: (-score[i], i))[:2]
    assert sum(r.args[1] for r in caplog.records if "to settle" in r.msg) <= 12


@pytest.mark.parametrize("pick", ["farthest", "nearest"])
def test_kmeans_does_not_depend_on_layout(texts, pick):
    """Depth, blocks and partitions are no part of the answer, and every cluster gives a row."""
    runs = [sorted(map(tuple, vectors.kmeans(texts.repartition(p), 8, UNIT, pick=pick, depth=d, block_entries=b, rounds=2).collect()))
            for d, b, p in ((1, 7, 2), (64, 10**6, 7))]
    assert runs[0] == runs[1]
    assert len({r[1] for r in runs[0]}) == len(runs[0]) == 8
    with pytest.raises(ValueError, match="unknown pick"):
        vectors.kmeans(texts, 2, UNIT, pick="other")


def test_kmeans_adds_up_rows_where_they_are(spark):
    """The rows' terms aren't joined with their centers: a task gives one row for each center and term."""
    df = spark.createDataFrame([(i, f"aa bb cc{i % 3} cc{i % 3}") for i in range(300)], "sid long, text string")
    rows = vectors.tfidf_rows(df, Vectorizer((1, 1), None, "l2")).repartition(3).cache()
    wide = F.inline(F.arrays_zip("ids", "ws")).alias("id", "w")
    centers = rows.where("sid in (0, 1, 2)").select(F.col("sid").alias("cluster"), wide).cache()
    found = vectors._sums(rows, centers, 3, 10**6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("InMemoryRelation")[0]
    assert found.count() <= 3 * 3 * 3
    expected = rows.select(F.pmod("sid", F.lit(3)).alias("cluster"), wide).groupBy("cluster", "id").agg(F.round(F.sum("w"), 6).alias("w"))
    added = lambda entries: vectors._sums(rows, centers, 3, entries).groupBy("cluster", "id").agg(F.round(F.sum("w"), 6).alias("w"))
    for entries in (10**6, 3):
        assert sorted(map(tuple, added(entries).collect())) == sorted(map(tuple, expected.collect()))


def test_kmeans_takes_the_extreme_row(spark):
    df = spark.createDataFrame([(0, "aa aa bb"), (1, "aa bb"), (2, "bb bb bb"), (3, "aa")], "sid long, text string")
    how = Vectorizer((1, 1), None, "l2")
    far = vectors.kmeans(df, 1, how).first()
    near = vectors.kmeans(df, 1, how, pick="nearest").first()
    assert far["sid"] in (2, 3) and near["sid"] in (0, 1) and far["distance"] > near["distance"]
    assert vectors.kmeans(df, 9, how, rounds=1).count() == 4
    assert vectors.kmeans(df.limit(0), 3, how).count() == 0


def test_products_match_numpy():
    import numpy as np
    rng = np.random.default_rng(0)
    lengths = np.array([0, 3, 0, 5, 1, 0, 2])
    flat = rng.integers(-1, 6, lengths.sum())
    ws = rng.random(lengths.sum())
    matrix = rng.random((6, 4))
    dense = np.zeros((len(lengths), 4))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for o, f, w in zip(owner, flat, ws):
        if f >= 0:
            dense[o] += matrix[f] * w
    for cells in (1, 12, 10**6):
        vectors._MAX_CELLS, old = cells, vectors._MAX_CELLS
        got = np.zeros_like(dense)
        for first, part in vectors._products(flat, ws, lengths, matrix):
            got[first:first + len(part)] = part
        vectors._MAX_CELLS = old
        assert np.allclose(got, dense)


def test_supervised_quota(spark):
    tags = {0: ["B-PER"] * 3, 1: ["B-PER", "B-ORG", "B-ORG"], 2: ["B-ORG"], 3: ["O"], 4: ["B-PER", "I-PER"], 5: ["B-LOC"]}
    tokens = spark.createDataFrame([(i, t, g) for i, s in tags.items() for t, g in enumerate(s)], "sid long, tid long, tag string")
    found = {r["sid"]: r["reason"] for r in initial.by_type_quota(tokens, 5).collect()}
    assert found == {5: "LOC", 1: "ORG", 0: "PER", 4: "any", 2: "any"}
    assert initial.by_type_quota(tokens, 6).count() == 6


def test_nnp_frequency(spark):
    sents = {0: [("x", "NNP"), ("y", "NN")], 1: [("x", "NN"), ("z", "NNPS")], 2: [("x", "NNP"), ("z", "NNP")], 3: [("q", "DT")]}
    tokens = spark.createDataFrame(
        [(i, t, w, p) for i, s in sents.items() for t, (w, p) in enumerate(s)], "sid long, tid long, token string, pos string")
    found = {r["sid"]: r["score"] for r in initial.nnp_frequency(tokens, 4).collect()}
    assert found == pytest.approx({0: 2 / 3, 1: 0.5, 2: (2 / 3 + 0.5) / 2, 3: 0.0})


def test_nnp_filter_and_longest(spark):
    s = spark.createDataFrame(
        [(0, ["a"], ["NN"]), (1, ["a", "b", "c"], ["NNP", "NNPS", "NNP"]), (2, [], []), (3, ["a", "b", "c"], ["NNP", "NN", "NN"])],
        "sid long, tokens array<string>, pos_tags_text array<string>")
    # One word: ln(1) is 0 and no proper noun is not more than 0. Empty: passes.
    assert {r["sid"] for r in initial.nnp_filter(s, 10, 2.0).collect()} == {1, 2}
    t = spark.createDataFrame([(0, "a b"), (1, "a  b c"), (2, "a b")], "sid long, text string")
    assert [(r["sid"], r["score"]) for r in initial.longest(t, 2).collect()] == [(1, 4), (0, 2)]


def test_static_and_exact_random(spark):
    rows = spark.range(50).select(F.col("id").alias("sid"))
    ids = spark.createDataFrame([(3,), (3,), (70,)], "sid long")
    assert [r["sid"] for r in initial.static(rows, ids).collect()] == [3]
    assert initial.random(rows, 17).distinct().count() == 17
    assert initial.random(rows, 170).count() == 50


def test_greedy_turns_are_far_fewer_than_picks(spark, caplog):
    """Rows that share little are picked many at a time, in the order of one at a time."""
    rows = [(i, t, f"w{i}x{t}" if t else f"shared{i % 40}", "B-PER") for i in range(160) for t in range(1 + i % 5)]
    tokens = spark.createDataFrame(rows, "sid long, tid long, token string, tag string")
    with caplog.at_level("INFO", "gleaner.operators.greedy"):
        found = greedy.cover(tokens, 90, batch=4).orderBy("step").collect()
    turns = [r.getMessage() for r in caplog.records if "greedy turn" in r.getMessage()]
    assert len(turns) <= 12 and any("all at once" in t for t in turns)
    words = {}
    for sid, _, w, _ in rows:
        words.setdefault(sid, []).append(w)
    tie = {r["sid"]: r["u"] for r in tokens.select("sid", uniform(1, "sid").alias("u")).distinct().collect()}
    seen, left, want = set(), set(words), []
    for step in range(1, 91):
        gain = {s: sum(w not in seen for w in words[s]) for s in left}
        sid = min(left, key=lambda s: (-gain[s], tie[s], s))
        want.append((step, sid, float(gain[sid])))
        left.remove(sid)
        seen |= set(words[sid])
    assert [tuple(r) for r in found] == want


@pytest.mark.parametrize("driver_terms", [0, 60, 10**6])
def test_greedy_rows_in_each_others_way(spark, caplog, monkeypatch, driver_terms):
    """Rows that all share terms, in fronts of few rows: the same picks by either way, and few turns where the driver has room."""
    monkeypatch.setattr(greedy, "FRONT", 2)
    rng = random.Random(4)
    sents = {i: {f"w{int(rng.random() ** 2 * 400)}" for _ in range(rng.randint(1, 9))} for i in range(300)}
    tokens = spark.createDataFrame([(i, t, w, "B-PER") for i, s in sents.items() for t, w in enumerate(sorted(s))], "sid long, tid long, token string, tag string").cache()
    tie = {r["sid"]: r["u"] for r in spark.range(300).select(F.col("id").alias("sid"), uniform(1, "id").alias("u")).collect()}
    seen, picks = set(), []
    for _ in range(120):
        best = min((i for i in sents if i not in picks), key=lambda i: (-len(sents[i] - seen), tie[i]))
        picks.append(best)
        seen |= sents[best]
    with caplog.at_level("INFO", "gleaner.operators.greedy"):
        found = greedy.cover(tokens, 120, batch=2, driver_terms=driver_terms).orderBy("step").collect()
    assert [r["sid"] for r in found] == picks
    turns = [r.getMessage() for r in caplog.records if "greedy turn" in r.getMessage()]
    assert driver_terms < 10**6 or len(turns) < 12, turns


@pytest.mark.parametrize("ids", [True, False])
@pytest.mark.parametrize("norm", [None, "l2"])
def test_tfidf_shuffles_texts_and_not_their_terms(spark, monkeypatch, ids, norm):
    """Many blocks, texts without terms, null and equal texts; rows that share an id; no window or join of terms in the plan."""
    from gleaner.operators import tfidf as module
    monkeypatch.setattr(module, "BLOCK_CHARS", 200)
    rows = [*corpus(60, seed=8), (60, None), (61, ""), (62, "of the")]
    how = Vectorizer((1, 2), STOPS, norm)
    df = spark.createDataFrame(rows, "sid long, text string")
    for made in (df, df.unionByName(spark.createDataFrame([(7, "t1 t2 t1")], df.schema))):
        found, n = tfidf(made, how, with_df=True, ids=ids), made.count()
        plain = module._joined(made, how, n, True, ids)
        key = "id" if ids else "term"
        got, want = ({(r["sid"], r[key]): (r["w"], r["df"]) for r in x.collect()} for x in (found, plain))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = tfidf(df, how, ids=ids)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    scores = {r["sid"]: r["score"] for r in module.text_scores(df, 3, how).collect()}
    top = {r["sid"]: r["score"] for r in module.top_mean(plain.sparkSession.createDataFrame(tfidf(df, how, ids=True).collect()), 3).collect()}
    assert scores == pytest.approx({i: round(top.get(i, 0.0), 9) for i, _ in rows})


def test_cover_reads_the_tokens_once(spark):
    """Ids without entities, with null tags or null tokens stay, and the tokens are made once; the size may follow from the number of ids."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch
    rows = [(1, 0, "a", "B-X"), (1, 1, "b", "O"), (1, 2, "a", "B-X"), (2, 0, "c", "O"), (2, 1, "d", "O"), (3, 0, None, "B-X"), (4, 0, "e", None), (5, 0, "a", "B-X"), (5, 1, "f", "I-X")]
    schema = "sid long, tid long, token string, tag string"
    tokens = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    picks = greedy.cover(tokens, lambda n: n - 1, batch=1).collect()
    assert seen.value == len(rows) and len(picks) == 4
    ahead = {r["sid"]: r["score"] for r in picks}
    assert ahead[3] == 1.0 and {ahead[1], ahead[5]} in ({2.0, 1.0}, {2.0, 0.0}) and len(ahead.keys() & {2, 4}) == 1


def test_a_turn_looks_at_no_more_rows_than_it_can_settle():
    """A table that was looked at whole isn't whole again in each turn, where the driver settles a small part of it."""
    assert greedy._next_rows(2_500_000, 2_500_000, 20_000, 10_000, 2_490_000, True) == 80_000
    assert greedy._next_rows(1_000_000, 250_000, 20_000, 10_000, 2_500_000, True) == 320_000
    assert greedy._next_rows(2_500_000, 2_500_000, 20_000, 10_000, 2_490_000, False) == 2_500_000  # all at once
    assert greedy._next_rows(64, 3, 3, 100, 1_000, True) == 256 and greedy._next_rows(64, 20, 20, 100, 1_000, True) == 256
    assert greedy._next_rows(64, 64, 16, 10, 1_000, True) == 64
