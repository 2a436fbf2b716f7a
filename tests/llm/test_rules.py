import re
from collections import Counter

from gleaner.llm import rules
from tests.llm.helpers import SCHEMA, documents, odd_rows, words


def measured(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text)))


def bits(m):
    n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat, n_capitals = m
    tests = [n_words < 50, 100 * n_repeat > 50 * n_words, 100 * n_symbols > 10 * n_words, n_dup > 3 and 100 * n_dup > 30 * n_lines,
             word_chars < 2 * n_words, word_chars > 20 * n_words, 100 * n_capitals > 50 * word_chars]
    return sum(1 << i for i, t in enumerate(tests) if t)


def test_equals_plain_version(spark):
    texts = [r[1] for r in odd_rows()] + documents()["text"].tolist() + ["a\na\n\na\nb", "a b c a b c a b", "\n", "x\n", "\nx", "a b c\nd a b c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in rules.ledger(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        assert tuple(out[i][m] for m in rules.MEASURES) == measured(t), (i, t and t[:50])
        assert out[i]["fail_bits"] == bits(measured(t))


def test_odd_rows_and_empty_table(spark):
    rows = spark.createDataFrame(odd_rows(), SCHEMA)
    assert rules.ledger(rows).count() == rows.count()
    empty = rules.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and rules.ablations(empty).count() == 0


def test_ablations_from_bits(spark):
    patterns = [0, 0, 1, 2, 3, 4, 4, 12, 64, 65]
    table = spark.createDataFrame([(b,) for b in patterns], "fail_bits long")
    out = {(r["policy"], r["rule"]): r for r in rules.ablations(table).collect()}
    assert len(out) == sum(map(len, rules.POLICIES.values()))
    for (policy, rule), r in out.items():
        mask, bit = rules.mask(policy), 1 << list(rules.RULES).index(rule)
        hits = [b & mask for b in patterns]
        assert (r["n_docs"], r["n_rejected"]) == (10, sum(h != 0 for h in hits))
        assert r["n_failed"] == sum(b & bit != 0 for b in patterns)
        assert r["n_alone"] == sum(h == bit for h in hits)
        assert r["n_rejected_without"] == sum(h & ~bit != 0 for h in hits)
