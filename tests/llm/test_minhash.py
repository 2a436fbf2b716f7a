import itertools

from gleaner.llm import minhash
from gleaner.llm.components import components, parts_by_hubs
from tests.llm.helpers import SCHEMA, component_of, documents, odd_rows, shingles, similar


def expected(rows):
    sets = {}
    for i, text in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(text))
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if any(similar(x, y) for x in sets[a] for y in sets[b])]
    return component_of(list(sets), links), links


def test_odd_rows(spark):
    rows = odd_rows()
    out = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    component, links = expected([(r[0], r[1]) for r in rows])
    assert links and len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == component[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted(r["n_shingles"] for r in out) == sorted(len(shingles(r[1])) for r in rows)


def test_equals_all_pairs(spark):
    docs = documents()
    out = minhash.near_duplicates(spark.createDataFrame(docs[["doc_id", "text"]])).collect()
    component, links = expected(zip(docs["doc_id"], docs["text"], strict=True))
    assert links and {r["doc_id"]: r["component_id"] for r in out} == component


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_group_of_near_copies_with_borderline_members(spark):
    """A chain of edits: neighbours are linked, the ends are not; hubs alone would miss links."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(24):
        copy = list(base)
        for j in range(0, k, 1):
            copy[(j * 5) % 60] = f"new{j}"
        texts.append((k, " ".join(copy)))
    out = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    component, _ = expected(texts)
    assert {r["doc_id"]: r["component_id"] for r in out} == component


def test_leftover_comparison_finds_what_hubs_miss(spark):
    """One list; 1 is no one's neighbour, 2 and 3 are linked; without hub rounds the blocks must find it."""
    keys = spark.createDataFrame([(9, i, 4) for i in (1, 2, 3, 4)], "v long, id long, n long")
    sets = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [5, 6, 7, 8]), (3, [5, 6, 7, 8, 9]), (4, [6, 7, 8, 9, 10])], "id long, full array<long>")
    found = parts_by_hubs(keys, lambda pairs: pairs.limit(0), sets, 75, rounds=1).collect()
    assert {(r["node"], r["component"]) for r in found} == {(2, 2), (3, 2)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 200), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["component"]) for r in found} == {(i, 0) for i in range(41)} | {(i, 90) for i in (90, 95, 100)}
    assert len(found) == 44
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
