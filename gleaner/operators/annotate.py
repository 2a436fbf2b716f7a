"""Revealing gold tags and reading what has been revealed.

``labelled(sid, tid, tag)`` has one row per annotated token. A token without a
row is not annotated, so adding annotations is a join and a union and no
sentence is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions.arrays import before, computed
from gleaner.operators.skew import at_most


def sentences(gold: DataFrame, labelled: DataFrame, picks: DataFrame, k: int) -> DataFrame:
    """Reveal every tag of the picked sentences; earlier partial tags give way."""
    chosen = picks.select("sid").distinct()
    new = gold.join(at_most(chosen, k), "sid", "left_semi").select("sid", "tid", "tag")
    kept = labelled.join(at_most(chosen, k), "sid", "left_anti").select("sid", "tid", "tag")
    return kept.unionByName(new)


def tokens(gold: DataFrame, labelled: DataFrame, picks: DataFrame) -> DataFrame:
    """Reveal the tags at the picked positions and keep all earlier ones."""
    chosen = picks.select("sid", "tid").distinct()
    new = gold.join(chosen, ["sid", "tid"], "left_semi").select("sid", "tid", "tag")
    kept = labelled.join(chosen, ["sid", "tid"], "left_anti").select("sid", "tid", "tag")
    return kept.unionByName(new)


def additions(gold: DataFrame, labelled: DataFrame, picks: DataFrame) -> DataFrame:
    """What revealing the picks, ``(sid)`` or ``(sid, tid)``, adds to ``labelled``: ``(sid, tid, tag)``."""
    on = [c for c in ("sid", "tid") if c in picks.columns]
    new = gold.join(picks.select(*on).distinct(), on, "left_semi").select("sid", "tid", "tag")
    return new.join(labelled.select("sid", "tid"), ["sid", "tid"], "left_anti")


def repeated(gold: DataFrame, labelled: DataFrame, picks: DataFrame) -> DataFrame:
    """Picked tokens that already carry their gold tag."""
    return (
        picks.select("sid", "tid")
        .join(labelled.select("sid", "tid", "tag"), ["sid", "tid"])
        .join(gold.select("sid", "tid", F.col("tag").alias("gold")), ["sid", "tid"])
        .where(F.col("tag") == F.col("gold"))
        .select("sid", "tid", "tag")
    )


def require_fresh(gold: DataFrame, labelled: DataFrame, picks: DataFrame) -> None:
    bad = repeated(gold, labelled, picks).limit(5).collect()
    if bad:
        raise ValueError(f"tokens picked again although annotated, for example {bad}")


def to_arrays(sentence_rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Sentences that carry annotations, with an ``al_tags`` array beside ``tokens``.

    Unannotated positions hold -100. What is gathered per sentence is at most
    as long as the token array its row already has.
    """
    entry = F.struct(F.col("tid").cast("int").alias("i"), F.lit(0).alias("unknown"), F.col("tag_id").alias("t"))
    # Arrays of labels take far more memory than a file of labels does on disk, so they are never broadcast for its size.
    known = labelled.groupBy("sid").agg(F.collect_set(entry).alias("_known")).hint("merge")
    # Known tags and one filler per position, sorted together: of the entries
    # of one position a known tag comes first and the filler is dropped.
    filler = F.transform("tokens", lambda _, i: F.struct(i.alias("i"), F.lit(1).alias("unknown"), F.lit(UNKNOWN).alias("t")))
    merged = computed(sentence_rows.join(known, "sid"), _all=F.sort_array(F.concat("_known", filler)))
    entries = F.col("_all")
    nothing = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("unknown"), F.lit(0).alias("t"))
    zipped = F.arrays_zip(entries.alias("here"), before(entries, nothing).alias("before"))
    first = F.filter(zipped, lambda z: z["here"]["i"] != z["before"]["i"])
    return merged.withColumn("al_tags", F.transform(first, lambda z: z["here"]["t"])).drop("_known", "_all")


def from_arrays(labelled_rows: DataFrame) -> DataFrame:
    """``(sid, al_tags)`` to one row per annotated token: ``(sid, tid, tag_id)``."""
    return (
        labelled_rows.select("sid", F.posexplode("al_tags").alias("tid", "tag_id"))
        .where(F.col("tag_id") != UNKNOWN)
        .withColumn("tid", F.col("tid").cast("long"))
    )


def annotated_per_sentence(labelled: DataFrame) -> DataFrame:
    """Number of annotated tokens of each sentence that has any."""
    return labelled.groupBy("sid").agg(F.count(F.lit(1)).alias("n_annotated"))
