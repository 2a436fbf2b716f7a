import hashlib

from pyspark.sql import functions as F

from gleaner.llm import chat, queries
from tests.llm.helpers import SMALL

MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double"
NASTY = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\<|", "<\\|im_end|>", "a\\\nb", "", "\n", "<|", "\\\\<||>", None, "café \U0001f600"]


def read(out):
    return out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, ["user", "assistant", "as\nsi\\stant<|"][i % 3], t) for i, t in enumerate(NASTY)]
    [r] = read(chat.formatted(chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3] or "") for x in rows]
    assert r["loss"] == "".join(x[3] or "" for x in rows if x[2] == "assistant")
    assert r["formatted"].count(chat.END) == len(rows) and r["n_turns"] == len(rows)


def test_tree_paths_and_ranks(spark):
    tree = [(1, 1, None, "user", "root", 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "high", 0.9),
            (1, 4, 3, "user", "more", None), (1, 5, 3, "user", "best", 1.0), (1, 6, 99, "user", "orphan", 0.2),
            (1, 7, 8, "user", "circle", 5.0), (1, 8, 7, "user", "circle", 5.0), (1, 9, 8, "user", "below", 5.0), (1, 10, 10, "user", "self", 1.0),
            (2, 1, None, "user", "tie", 0.0), (2, 2, 1, "assistant", "a", 0.5), (2, 3, 1, "assistant", "b", 0.5), (2, 3, 1, "assistant", "b", 0.5)]
    out = read(chat.formatted(spark.createDataFrame(tree, MESSAGES), branches=None))
    got = {(r["conv_id"], r["branch"]): [t["text"] for t in r["turns"]] for r in out}
    assert got == {(1, 1): ["root", "high", "best"], (1, 2): ["root", "high", "more"], (1, 3): ["orphan"], (1, 4): ["root", "low"],
                   (2, 1): ["tie", "a"], (2, 2): ["tie", "b"]}
    best = read(chat.formatted(spark.createDataFrame(tree, MESSAGES)))
    assert {r["conv_id"]: r["leaf_id"] for r in best} == {1: 5, 2: 2}


def test_depths_around_powers_of_two(spark):
    depths = [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33]
    rows = [(n, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for n in depths for i in range(n)]
    out = read(chat.formatted(chat.from_turns(spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string"))))
    assert {r["conv_id"]: [t["text"] for t in r["turns"]] for r in out} == {n: [f"t{i}" for i in range(n)] for n in depths}


def test_nulls_ties_and_empty_table(spark):
    kind = "conv_id long, turn long, role string, text string, node long, score string"
    rows = [(1, None, None, None, 5, "x"), (1, 0, "user", "a", 5, "x"), (1, 0, "user", "a", 5, "x"), (1, 0, "assistant", "b", 5, "x"), (None, 0, "user", "lost", 5, "x")]
    [r] = read(chat.formatted(chat.from_turns(spark.createDataFrame(rows, kind))))
    assert [(t["role"], t["text"]) for t in r["turns"]] == [("", ""), ("assistant", "b"), ("user", "a"), ("user", "a")]
    assert chat.formatted(chat.from_turns(spark.createDataFrame([], kind))).count() == 0


def test_query_reads_back_every_conversation(spark):
    import pyarrow.parquet as pq
    table = pq.read_table(f"{SMALL}/conversations.parquet").to_pandas().sort_values(["conv_id", "turn"])
    out = {r["conv_id"]: r for r in queries.op2_chat_formatting(spark, SMALL).collect()}
    assert set(out) == set(table["conv_id"]) | {-1}
    for i, rows in table.groupby("conv_id"):
        text = "".join(f"{a}\n{b or ''}\n" for a, b in zip(rows["role"], rows["text"], strict=True))
        loss = "".join(b or "" for a, b in zip(rows["role"], rows["text"], strict=True) if a == "assistant")
        assert out[i]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (out[i]["loss_chars"], out[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
