import random

from gleaner.llm import line_dedup as L
from tests.llm.helpers import SCHEMA, documents, odd_rows


def plain_blocks(later, earlier, least):
    """Patience diff as a recursion over slices, then runs of enough characters."""
    def match(a, b, i, j):
        if not a or not b:
            return []
        if a[0] == b[0]:
            return [(i, j)] + match(a[1:], b[1:], i + 1, j + 1)
        if a[-1] == b[-1]:
            return match(a[:-1], b[:-1], i, j) + [(i + len(a) - 1, j + len(b) - 1)]
        once = [(x, b.index(v)) for x, v in enumerate(a) if a.count(v) == 1 and b.count(v) == 1]
        best = []  # longest chain that ends in each pair; of equal ones the one whose pairs come latest
        for k in range(len(once)):
            before = [best[m] for m in range(k) if once[m][1] < once[k][1]]
            longest = max(map(len, before), default=0)
            best.append(next((c for c in reversed(best) if len(c) == longest), []) + [once[k]])
        longest = max(map(len, best), default=0)
        chain = next((c for c in reversed(best) if len(c) == longest), [])
        out, x0, y0 = [], 0, 0
        for x, y in chain:
            out += match(a[x0:x], b[y0:y], i + x0, j + y0) + [(i + x, j + y)]
            x0, y0 = x + 1, y + 1
        return out + match(a[x0:], b[y0:], i + x0, j + y0) if chain else []
    pairs = match(later, earlier, 0, 0)
    removed, run = set(), []
    for k, (i, j) in enumerate(pairs):
        run.append(i)
        if k + 1 == len(pairs) or pairs[k + 1] != (i + 1, j + 1):
            if sum(len(later[x]) for x in run) >= least:
                removed |= set(run)
            run = []
    return removed


def runs(lines, least):
    """Seeds as text: as many non-blank lines from each on as reach the length."""
    full = [x for x in lines if x]
    out = set()
    for i in range(len(full)):
        for j in range(i + 1, len(full) + 1):
            if sum(map(len, full[i:j])) >= least:
                out.add(tuple(full[i:j]))
                break
    return out


def plain(rows, least):
    """Removed lines by document; ids must differ."""
    lines = {i: (t.split("\n") if t else []) for i, t in rows}
    first = {}
    for i in sorted(lines):
        for seed in runs(lines[i], least):
            first.setdefault(seed, i)
    out = {}
    for i in lines:
        partners = {first[s] for s in runs(lines[i], least)} - {i}
        out[i] = sorted(set().union(*[plain_blocks(lines[i], lines[p], least) for p in partners])) if partners else []
    return out


def found(spark, rows, least=L.LEAST_CHARS):
    out = L.shared_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least).collect()
    return {r["doc_id"]: r["removed"] for r in out}


def test_random_documents(spark):
    random.seed(1)
    pool = ["a" * 30, "b" * 25, "c" * 70, "dd", "e" * 10, "", "f" * 61, "é" * 20]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 14)))) for i in range(60)]
    assert found(spark, rows) == plain(rows, L.LEAST_CHARS)
    assert any(plain(rows, L.LEAST_CHARS).values())


def test_whole_small_table(spark):
    docs = documents()
    rows = list(zip(docs["doc_id"].tolist(), docs["text"], strict=True))
    expected = plain(rows, L.LEAST_CHARS)
    assert found(spark, rows) == expected and any(expected.values())
    table = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: (r["text"], r[L.REMOVED]) for r in L.without_shared(table, L.shared_lines(table)).collect()}
    for i, t in rows:
        assert left[i] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(expected[i])), len(expected[i]))


def test_anchors_cross_and_repeat():
    assert L.patience([1, 2, 3, 4, 9, 5], [4, 1, 2, 3, 8, 5]) == [(0, 1), (1, 2), (2, 3), (5, 5)]
    assert L.patience([7, 7, 7], [7, 7]) == [(0, 0), (1, 1)]
    assert L.patience([], [1]) == L.patience([1], [2]) == []


def test_short_common_lines_stay(spark):
    rows = [(i, f"Les.\n{'unique text %d ' % i * 9}\nOk.") for i in range(5)]
    assert not any(found(spark, rows).values())


def test_odd_rows(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    out = L.shared_lines(rows)
    left = L.without_shared(rows, out).collect()
    assert out.count() == len(left) == len(odd_rows())
    texts = {}
    for r in left:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert texts[2] == ["", ""] and texts[4] == [None] and texts[5] == [""] and len(texts[1][0]) and texts[None][0] is not None
    assert left[0]["v"] == "v" and left[0]["id"] == 7
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.without_shared(empty, L.shared_lines(empty)).count() == 0


def plain_runs(rows, least):
    """Lines, and blank lines between them, of all runs of enough characters that an earlier document holds; ids must differ."""
    def all_runs(text):
        full = [(k, x) for k, x in enumerate(text.split("\n")) if x]
        for i in range(len(full)):
            for j in range(i + 1, len(full) + 1):
                if sum(len(x) for _, x in full[i:j]) >= least:
                    yield tuple(x for _, x in full[i:j]), range(full[i][0], full[j - 1][0] + 1)
    first = {}
    for i, t in sorted(rows):
        for run, _ in all_runs(t):
            first.setdefault(run, i)
    return {i: sorted({k for run, places in all_runs(t) if first[run] < i for k in places}) for i, t in rows}


def of_query(spark, folder, rows):
    """What the registered query removes: number of lines and what is left, by document."""
    import hashlib

    from gleaner.llm import queries
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in queries.op1_line_dedup(spark, folder).collect()}
    return kept, lambda text: hashlib.sha256(text.encode()).hexdigest()


def test_no_shared_run_stays(spark, tmp_path):
    a, b, c, tail = "a" * 71, "b" * 53, "c" * 65, "t" * 10
    rows = [(1, f"{a}\n{b}\nx\n{c}\ny"), (2, f"{b}\nother\n{a}"), (3, f"p\n{c}\nq\n{c}\nr\n{c}\ns"), (4, "z" * 60), (5, "z" * 60 + f"\n{tail}"),
            (6, "k\n" + "z" * 60 + f"\n{tail}\nm")]
    kept, digest = of_query(spark, str(tmp_path), rows)
    assert kept == {1: (0, digest(rows[0][1])), 2: (1, digest(f"{b}\nother")), 3: (3, digest("p\nq\nr\ns")), 4: (0, digest(rows[3][1])),
                    5: (1, digest(tail)), 6: (2, digest("k\nm"))}


def test_every_shared_equals_all_runs(spark):
    random.seed(5)
    pool = ["a" * 30, "b" * 25, "c" * 70, "dd", "e" * 10, "", "f" * 61, "é" * 20, "g" * 40]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(random.randint(0, 14)))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: set(r["removed"]) for r in L.every_shared(table).collect()}
    aligned, runs_ = plain(rows, L.LEAST_CHARS), plain_runs(rows, L.LEAST_CHARS)
    more = 0
    for i, t in rows:
        full = {k for k, x in enumerate(t.split("\n")) if x}
        expected = set(aligned[i]) | set(runs_[i])
        assert got[i] & full == expected & full and got[i] <= expected  # a blank line between two runs may stay
        more += len(expected & full - set(aligned[i]))
    assert more
