"""Language of a text by compression.

Each language has a dictionary of raw text. A text is compressed with every
dictionary, in pieces so that a long text doesn't drown the dictionary in its
own history, and the language whose pieces come out smallest is chosen. When the
two smallest totals are nearly equal, the decision is marked as rejected.

What is learned is bounded by parameters: from each language at most
``SAMPLE_ROWS`` rows, of each row one passage of at most ``PASSAGE`` characters,
and ``DICTIONARY_BYTES`` in all. Predictions read the whole of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.hashing import uniform

SAMPLE_ROWS = 128
PASSAGE = 2000
DICTIONARY_BYTES = 112 << 10
PIECE_BYTES = 4096
LEVEL = 3
MIN_MARGIN = 0.004
"""A text is rejected if the smallest total is not below the next by this share."""
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")


def learn(labelled: DataFrame, seed: int = 5) -> dict[str, bytes]:
    """A dictionary for each language of ``labelled`` (``doc_id, text, lang``).

    Rows with a null text or language teach nothing. Rows are drawn by a hash of
    their id, at a rate that follows from the language's number of rows, so the
    draw needs no sort of a large language; equal passages count once. Only the
    drawn passages reach the driver, at most about four times ``SAMPLE_ROWS`` for each language.
    """
    usable = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    draw = uniform(seed, "doc_id")
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * SAMPLE_ROWS / n))])
    passage = F.expr(f"substring(text, 1 + cast(floor(u * greatest(0, length(text) - {PASSAGE})) as int), {PASSAGE})")
    drawn = (usable.withColumn("u", draw).where(F.col("u") < rates[F.col("lang")])
             .select("lang", "u", passage.alias("passage")).collect())
    learned: dict[str, dict[str, None]] = {}
    for r in sorted(drawn, key=lambda r: (r["u"], r["passage"]), reverse=True):
        learned.setdefault(r["lang"], {})[_normal(r["passage"])] = None
    return {lang: " ".join(list(p)[-SAMPLE_ROWS:]).encode()[-DICTIONARY_BYTES:] for lang, p in sorted(learned.items())}


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` of each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, and
    repeated rows are answered each. A text that is null or has no letter, and
    any text where nothing was learned, is ``und`` with score 0 and rejected.
    Equal totals go to the first language by name. ``score`` is the probability
    of the chosen language if total lengths were code lengths at a quarter of a
    bit for each bit; ``margin`` is by what share the smallest total is below the next.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _predictor(dictionaries), f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with ``lang`` as predicted and all other columns as they are.

    Where nothing was learned, ``docs`` itself.
    """
    if not dictionaries:
        return docs
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tools = _tools(dictionaries)
        for batch in batches:
            found = [_judged(text.as_py(), names, tools) for text in batch.column(at)]
            columns = [c for c in batch.columns]
            columns[lang] = pa.array([f[0] for f in found], pa.string())
            whole = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield whole.filter(pa.array([not f[3] for f in found], pa.bool_()))
    return docs.mapInArrow(run, docs.withColumn("lang", F.col("lang").cast("string")).schema)


def _tools(dictionaries: dict[str, bytes]) -> tuple[list[str], list]:
    tools = []
    for raw in dictionaries.values():
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        tools.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
    return list(dictionaries), tools


def _normal(text: str) -> str:
    return _NO_LETTERS.sub(" ", text.lower())


def _predictor(dictionaries: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, tools = _tools(dictionaries)
        for batch in batches:
            found = [_judged(text.as_py(), names, tools) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"])
    return run


def _judged(text: str | None, names: list[str], tools: list) -> tuple[str, float, float, bool]:
    plain = _normal(text or "")
    if not names or not any(map(str.isalpha, plain)):
        return UNKNOWN, 0.0, 0.0, True
    raw = plain.encode()
    totals = np.zeros(len(tools))
    for at in range(0, len(raw), PIECE_BYTES):
        piece = raw[at: at + PIECE_BYTES]
        totals += [len(t.compress(piece)) for t in tools]
    best = int(totals.argmin())
    others = np.delete(totals, best)
    margin = float(1 - totals[best] / others.min()) if len(others) else 1.0
    score = 1 / np.exp2(np.maximum(-60, -2 * (totals - totals[best]))).sum()
    return names[best], float(score), margin, margin < MIN_MARGIN
