"""Rows that every operator must bear, and plain versions to compare with."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, v string, id long, n long, part string"


def documents() -> pd.DataFrame:
    return pq.read_table(f"{SMALL}/documents.parquet").to_pandas()


def odd_rows() -> list[tuple]:
    """Nulls, empty, blank, tiny and very long texts, ties, repeated rows, an id twice, and columns with names used inside."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " extra", "en", None), (4, None, "en", "b"),
        (5, "", None, "b"), (6, " \n\t ", "de", "b"), (7, "word", "en", "b"), (8, "one two three", None, "b"), (None, base, "en", "b"),
        (9, long, "en", "a"), (10, long + " tail", "de", "a"), (11, "two\n\nlines\n", "de", "a"), (12, "café \U0001f600 " + base, "fr", "a"),
        (13, base.upper(), "en", "a"), (14, None, None, None), (15, "x" * 400_000, "en", "a"),
    ]
    return [(i, t, g, s, None if t is None else len(t), "v", 7, 8, "p") for i, t, g, s in rows]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(lower(text))
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def similar(a: frozenset, b: frozenset) -> bool:
    i = len(a & b)
    return bool(a) and bool(b) and 100 * i >= 75 * (len(a) + len(b) - i)


def component_of(nodes: list, links: list[tuple]) -> dict:
    """The smallest node that each can reach."""
    parent = {x: x for x in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}
