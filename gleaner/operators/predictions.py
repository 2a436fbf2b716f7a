"""From raw model output to one score row per token."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions import scores as S
from gleaner.functions.tags import decode
from gleaner.operators.skew import cut_lineage

# The functions that run inside tasks are shipped whole, so that executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def valid_softmax(raw: DataFrame, classes: int | None = None) -> DataFrame:
    """``raw(sid, logits, label_ids)`` to ``(sid, tid, scores)``.

    Where most vectors have so many ``classes``, theirs are written out class by
    class, which Spark compiles; the result is the same for vectors of any length.

    Special tokens, padding and word continuations carry the label -100; they
    are dropped inside the row, which also makes the word positions dense
    without a window or a shuffle.
    """
    pairs = F.arrays_zip(F.col("logits").alias("l"), F.col("label_ids").alias("y"))
    kept = F.filter(pairs, lambda p: p["y"] != UNKNOWN)
    rows = raw.select("sid", F.posexplode(kept).alias("tid", "p")).select("sid", F.col("tid").cast("long").alias("tid"), F.col("p.l").alias("l"))
    if not classes:
        return rows.select("sid", "tid", S.softmax("l").alias("scores"))
    rows = rows.withColumns({"_top": F.array_max(F.col("l").cast("array<double>")), "_usual": F.size("l") == classes})
    # Steps of their own, or Spark would work out each power once for every score.
    powers = {f"_p{c}": F.exp(F.get("l", F.lit(c)).cast("double") - F.col("_top")) for c in range(classes)}
    rows = rows.withColumns(powers)
    rows = rows.withColumn("_total", sum((F.col(p) for p in powers), F.lit(0.0)))
    usual = F.array(*[F.col(p) / F.col("_total") for p in powers])
    return rows.select("sid", "tid", F.when(F.col("_usual"), usual).otherwise(S.softmax("l")).alias("scores"))


def argmax_tags(raw: DataFrame, names: list[str]) -> DataFrame:
    """``raw`` to ``(sid, tid, pred, gold)`` tag names, masked positions removed."""
    pairs = F.arrays_zip(F.col("logits").alias("l"), F.col("label_ids").alias("y"))
    kept = F.filter(pairs, lambda p: p["y"] != UNKNOWN)
    return raw.select("sid", F.posexplode(kept).alias("tid", "p")).select(
        "sid",
        F.col("tid").cast("long").alias("tid"),
        decode(S.argmax(F.col("p.l")), names).alias("pred"),
        decode(F.col("p.y"), names).alias("gold"),
    )


def unroll(nested: DataFrame) -> DataFrame:
    """``(sid, scores ARRAY<ARRAY<DOUBLE>>)`` to one row per token."""
    return nested.select("sid", F.posexplode("scores").alias("tid", "scores")).withColumn(
        "tid", F.col("tid").cast("long"))


def without_labelled_tokens(pool: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pool rows whose ``(sid, tid)`` carries no annotation yet."""
    return pool.join(labelled.select("sid", "tid"), ["sid", "tid"], "left_anti")


def without_labelled_sentences(pool: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pool rows of sentences that carry no annotation at all."""
    return pool.join(labelled.select("sid").distinct(), "sid", "left_anti")


def collapse(tokens: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Token picks as ``(sid, block_no, tids)`` with sorted, distinct positions.

    An ordinary sentence gives one row with block 0. A group is cut every
    ``block`` positions so that no single array grows with a hot sentence.
    """
    return (
        tokens.withColumn("block_no", F.floor(F.col("tid") / block).cast("long"))
        .groupBy("sid", "block_no")
        .agg(F.array_sort(F.collect_set("tid")).alias("tids"))
    )


def length_mismatches(nested: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences whose number of predictions and of tags differ.

    A sentence missing on either side counts as zero tokens there.
    """
    p = nested.select("sid", F.size("scores").alias("n_predictions"))
    s = sentences.select("sid", F.size("ner_tags").alias("n_tags"))
    both = p.join(s, "sid", "full_outer")
    return both.select(
        "sid",
        F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"),
        F.coalesce("n_tags", F.lit(0)).alias("n_tags"),
    ).where(F.col("n_predictions") != F.col("n_tags"))


def require_same_lengths(nested: DataFrame, sentences: DataFrame) -> None:
    bad = length_mismatches(nested, sentences).limit(5).collect()
    if bad:
        raise ValueError(f"predictions and tags differ in length, for example {bad}")


def key_sum(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and sum of the hashes of their ``(sid, tid)``: equal for equal sets of keys, and unequal else but for one chance in 2 ** 64."""
    found = rows.agg(*_key_sum()).first()
    return found["n"], int(found["h"] or 0)


def _key_sum() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("sid", "tid").cast("decimal(38,0)")).alias("h")]


def watched(pool: DataFrame) -> tuple[DataFrame, Observation]:
    """``pool`` with its ``key_sum`` observed in the job that reads it anyway."""
    seen = Observation()
    return pool.observe(seen, *_key_sum()), seen


def require_same_tokens(seen: Observation, pred: DataFrame, tokens: DataFrame, expected: tuple[int, int]) -> None:
    """An error, with examples, if predictions and tokens differ in their positions.

    What was observed may count a task twice that was run again, so only the
    join of both decides; it runs only where the sums differ.
    """
    if (seen.get["n"], int(seen.get["h"] or 0)) == expected:
        return
    p = pred.groupBy("sid", "tid").agg(F.count(F.lit(1)).alias("n_predictions"))
    t = tokens.groupBy("sid", "tid").agg(F.count(F.lit(1)).alias("n_tokens"))
    both = p.join(t, ["sid", "tid"], "full_outer").na.fill(0, ["n_predictions", "n_tokens"])
    bad = both.where(F.col("n_predictions") != F.col("n_tokens")).limit(5).collect()
    if bad:
        raise ValueError(f"predictions and tokens differ, for example {bad}")


def pairs_of_sentences(sentences: DataFrame, guessed: DataFrame, tags: list[str]) -> DataFrame:
    """``(sid, tid, gold, pred)``: the tokens of ``sentences(sid, tokens, ner_tags)`` joined with ``guessed(sid, tid, tag_id)``.

    Gold tags are shuffled by sentence and guesses by stretch, a run of tokens
    that lie one after another, so neither token by token; the rows lie dealt
    out by ``sid``. A position that is not on both sides is left out.
    """
    spark = sentences.sparkSession
    # A given number of partitions: these rows are small until they are spelled out, and would be put together by their size.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kind = guessed.schema["sid"].dataType.simpleString()
    rows = guessed.where(F.col("sid").isNotNull() & F.col("tid").between(0, (1 << 31) - 2)).select(
        "sid", F.col("tid").cast("int").alias("tid"), F.col("tag_id").cast("int").alias("tag_id"))
    # Stored, as whoever reads the pairs several times would score the tokens as often.
    stretches = cut_lineage(rows.mapInArrow(_stretches, f"sid {kind}, first int, guesses array<int>")).repartition(parts, "sid")
    gold = F.arrays_zip("tokens", "ner_tags").getField("ner_tags").alias("gold")
    both = sentences.select("sid", gold).repartition(parts, "sid").join(stretches, "sid")
    here = F.slice("gold", F.col("first") + 1, F.size("guesses"))
    there = F.slice("guesses", F.lit(1), F.greatest(F.lit(0), F.size("gold") - F.col("first")))
    zipped = F.arrays_zip(here.alias("g"), there.alias("p"))
    out = both.select("sid", "first", F.posexplode(zipped).alias("at", "z"))
    return out.select("sid", (F.col("first") + F.col("at")).cast("long").alias("tid"),
                      decode(F.col("z.g"), tags).alias("gold"), decode(F.col("z.p"), tags).alias("pred"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``sid, tid, tag_id`` to a row for each run of rows of one ``sid`` with ``tid`` rising by one."""
    for batch in batches:
        if not len(batch):
            continue
        sid, tid = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        starts = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (tid[1:] != tid[:-1] + 1)])
        ends = pa.array(np.r_[starts, len(sid)].astype(np.int32))
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.ListArray.from_arrays(ends, batch.column(2))], names=["sid", "first", "guesses"])
