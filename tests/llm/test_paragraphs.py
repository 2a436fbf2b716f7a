import itertools

from gleaner.llm import paragraphs as P
from tests.llm.helpers import SCHEMA, component_of, documents, lower, odd_rows, shingles, similar, words


def plain(rows):
    items = {}
    for i, t in rows:
        if i is not None:
            for k, line in enumerate((t or "").split("\n")):
                if len(words(line)) >= P.LEAST_WORDS:
                    items[i, k] = line
    sets = {x: shingles(t) for x, t in items.items()}
    holders = {}
    for x, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(x)
    pairs = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    links = [(a, b) for a, b in pairs if similar(sets[a], sets[b])]
    links += [(a, b) for a, b in pairs if words(lower(items[a])) == words(lower(items[b]))]
    component = component_of(list(items), links)
    size = {}
    for c in component.values():
        size[c] = size.get(c, 0) + 1
    return {(x[0], x[1], c[0], c[1], x != c) for x, c in component.items() if size[c] > 1}


def found(spark, rows):
    out = P.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(set(out))
    return {(r["doc_id"], r["line"], r["first_doc_id"], r["first_line"], r["removed"]) for r in out}


def test_equals_all_pairs(spark):
    docs = documents()
    rows = list(zip(docs["doc_id"].tolist(), docs["text"], strict=True))
    expected = plain(rows)
    assert expected and found(spark, rows) == expected


def test_passage_in_many_documents(spark):
    passage = " ".join(f"Common{i}" for i in range(60))
    edited = passage.replace("Common30", "changed")
    rows = [(i, f"own words of {i}\n{(passage, edited, passage.lower())[i % 3]}\nend {i}") for i in range(-3, 30)]
    out = found(spark, rows)
    assert {(x[0], x[1]) for x in out if x[4]} == {(i, 1) for i in range(-2, 30)}
    assert {x[2:4] for x in out} == {(-3, 1)}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in P.without_repeats(table, P.repeats(table)).collect()}
    assert left[5] == "own words of 5\nend 5" and left[-3] == rows[0][1]


def test_odd_rows(spark):
    rows = odd_rows()
    out = P.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r["doc_id"], r["line"], r["first_doc_id"], r["first_line"], r["removed"]) for r in out}
    assert got == plain([(r[0], r[1]) for r in rows])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.without_repeats(empty, P.repeats(empty)).count() == 0


def plain_passages(rows, removed):
    """``doc_id`` and place, in words of the text, of all words in windows that stand earlier, among lines that stay."""
    first, again = {}, set()
    for i, t in sorted(rows):
        tokens = [(w, k) for k, line in enumerate(t.split("\n")) for w in words(lower(line))]
        for p in range(len(tokens) - P.PASSAGE + 1):
            if any((i, k) in removed for _, k in tokens[p: p + P.PASSAGE]):
                continue
            d, q = first.setdefault(tuple(w for w, _ in tokens[p: p + P.PASSAGE]), (i, p))
            if d != i or p >= q + P.PASSAGE:
                again |= {(i, p + x) for x in range(P.PASSAGE)}
    return again


def test_passage_inside_longer_lines(spark, tmp_path):
    from gleaner.llm import queries
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    passage = [f"Shared{k}" for k in range(52)]
    wrapped = "\n".join(" ".join(passage[k: k + 10]) for k in range(0, 52, 10))
    rows = [(1, f"{own(1, 60)} {' '.join(passage)} {own(2, 36)}"), (2, f"head\n\n{own(3, 30)} {' '.join(passage)} {own(4, 250)}\nend"),
            (3, f"{own(5, 30)} {' '.join(passage[:49])} {own(6, 30)}"), (4, f"start\n{wrapped}\nend"), (5, f"{own(7, 30)} {' '.join(passage).lower()}"),
            (6, "a " * 200), (7, "b " * 60), (8, None), (9, f"{' '.join(passage)} {own(8, 99)} {' '.join(passage)}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op6_paragraph_dedup(spark, str(tmp_path)).collect()
    got = {(r["doc_id"], r["line"], r["word"], r["n_words"], r["end_line"], r["first_doc_id"], r["first_line"], r["first_word"], r["removed"]) for r in out}
    first = (1, 0, 60, True)
    assert got == {(2, 2, 30, 52, 2, *first), (4, 1, 0, 52, 6, *first), (5, 0, 30, 52, 0, *first), (6, 0, 50, 150, 0, 6, 0, 0, True),
                   (9, 0, 0, 52, 0, *first), (9, 0, 151, 52, 0, *first)}
    left = {r["doc_id"]: r["text"] for r in P.without_all(table, spark.createDataFrame(out)).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1] and left[4] == "start\nend" and left[8] is None
    assert left[2] == f"head\n\n{own(3, 30)} {own(4, 250)}\nend" and left[5] == own(7, 30) and left[6].split() == ["a"] * 50 and left[9] == " " + own(8, 99)


def test_passages_equal_plain_windows(spark):
    docs = documents()
    rows = [(i, t) for i, t in zip(docs["doc_id"].tolist(), docs["text"], strict=True)]
    tokens = rows[3][1].split()
    rows += [(10 ** 6 + k, f"{' '.join(t.split()[:70])} {' '.join(rows[k][1].split()[5: 90])}") for k, (_, t) in enumerate(rows[100:130])] + [(2 * 10 ** 6, " ".join(tokens[::-1] + tokens))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = P.repeats(table).localCheckpoint()
    removed = {(r["doc_id"], r["line"]) for r in found.where("removed").collect()}
    got = set()
    for r in P.passages(table, found).collect():
        text = dict(rows)[r["doc_id"]].split("\n")
        at = sum(len(words(x)) for x in text[: r["line"]]) + r["word"]
        got |= {(r["doc_id"], at + x) for x in range(r["n_words"])}
    assert got and got == plain_passages(rows, removed)


def scanned(run, columns):
    import pyarrow as pa
    return pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=list("abcdefg")[: len(columns)])]))))


def test_windows_only_where_their_own_mark_is_shared():
    import pyarrow as pa

    from gleaner.llm.words import text_blocks, words_of
    own = lambda i, n: " ".join(f"own{i}x{k}" for k in range(n))
    shared = " ".join(f"Shared{k}" for k in range(45))
    texts = [f"{own(2 * i, 80)} {shared}\n{own(2 * i + 1, 80)}" for i in range(2)] + ["", " \n "]
    held = [P._winnowed(words_of(next(text_blocks(pa.array([t]))), lower=True), P.PASSAGE) for t in texts[:2]]
    common = {int(x) for x in held[0][0][held[0][-1]]} & {int(x) for x in held[1][0][held[1][-1]]}
    width = P.PASSAGE - P.PASSAGE // 2 + 1
    expected = [(i, at) for i, h in enumerate(held) for at in range(len(h[0]) - width + 1) if int(min(h[0][at: at + width])) in common]
    assert expected
    wanted = [sorted(common)] * 2 + [[]] * 2

    def windows(cut):
        out = scanned(P._windows(P.PASSAGE), [([7, 8, 9, 10], pa.int64()), ([1, 2, 3, 4], pa.int64()), (texts, pa.string()),
                                              (wanted, pa.list_(pa.int64())), (cut, pa.list_(pa.int32()))])
        return [(d - 7, at) for d, at in zip(out["doc_id"].to_pylist(), out["at"].to_pylist(), strict=True)]
    assert windows([[]] * 4) == expected
    # Lines that are gone, and such that another text of the same id has.
    assert windows([[9], [1, 2], [0], [0, 1]]) == [(i, at) for i, at in expected if i == 0 or at + P.PASSAGE <= 125]


def test_sets_only_of_wanted_paragraphs():
    import pyarrow as pa
    line = [" ".join(f"w{i}x{k % 7}" for k in range(30)) for i in range(3)]
    out = scanned(P._sets(P.LEAST_WORDS), [(["\n".join(line), "", line[2]], pa.string()), ([[2, 0, 5], [0], [0]], pa.list_(pa.int32())),
                                           ([[52, 50, 55], [60], [70]], pa.list_(pa.int64()))])
    got = dict(zip(out["id"].to_pylist(), out["full"].to_pylist(), strict=True))
    assert set(got) == {52, 50, 70} and got[52] == got[70] != got[50] and len(got[50]) == 7


def test_marks_of_words_that_go_round():
    import pyarrow as pa
    texts = ["a " * 900 + "\n" + "a " * 300, "", "b c d " * 300, " ".join(f"w{k}" for k in range(50))]
    out = scanned(P._marks(P.PASSAGE), [([1, 2, 3, 4], pa.int64()), (texts, pa.string())])
    assert out["doc_id"].to_pylist() == [1, 2, 3, 4]
    assert out["lines"].to_pylist() == [[0, 0, 1, 1], [], [0, 0], [0]]
    assert [len(set(x)) for x in out["marks"].to_pylist()] == [1, 0, 1, 1]


def test_texts_without_words(spark):
    table = spark.createDataFrame([(1, " \n "), (2, ""), (3, None), (4, "\n\t")], "doc_id long, text string").coalesce(1)
    assert P.all_repeats(table).count() == 0
