"""Runs of tags inside a sentence, and the run around a given token.

``tokens(sid, tid, tag)`` is a long table whose positions are dense from 0.
Windows run over ``(sid, tid div CHUNK)``: a sentence of ordinary length is one
chunk, and a sentence that holds a third of the table is many. A run that
crosses a chunk border is stitched from its two ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import tags as G
from gleaner.operators.skew import CHUNK_ROWS, at_most

# A scheme says whether a token opens a new run although the one before it is
# an entity token too. `before` and `here` are both entity tags.
Scheme = Callable[[Column, Column], Column]


def io_break(before: Column, here: Column) -> Column:
    """One run is a stretch of one identical tag."""
    return before != here


def bio_break(before: Column, here: Column) -> Column:
    """A begin tag or another type opens a run; an orphan inside tag does too."""
    return G.has_prefix(here, "B") | (G.entity_type(before) != G.entity_type(here))


def any_entity_break(before: Column, here: Column) -> Column:
    """One run is a maximal stretch of entity tokens of any type."""
    return F.lit(False)


def runs(
    tokens: DataFrame, scheme: Scheme, chunk_rows: int = CHUNK_ROWS, keys: tuple[str, ...] = ("sid",)
) -> DataFrame:
    """Entity runs as ``(*keys, start, end, tag)`` with ``end`` past the last token.

    ``keys`` identify a sequence and ``tag`` is the tag of the run's first
    token. ``chunk_rows`` is at least 2. The tokens are read once; only the
    first and last token of each run go on after the first window.
    """
    chunk = F.floor(F.col("tid") / chunk_rows).cast("long")
    # The tokens at both rims of a chunk also go to its neighbour, where they
    # serve as the token before the first and after the last.
    homes = (
        F.when(F.col("tid") % chunk_rows == chunk_rows - 1, F.array(chunk, chunk + 1))
        .when((F.col("tid") % chunk_rows == 0) & (F.col("tid") > 0), F.array(chunk, chunk - 1))
        .otherwise(F.array(chunk))
    )
    placed = tokens.select(*keys, "tid", "tag", F.explode(homes).alias("chunk"))
    w = Window.partitionBy(*keys, "chunk").orderBy("tid")
    before, here, after = F.lag("tag").over(w), F.col("tag"), F.lead("tag").over(w)
    opens = before.isNull() | (before == "O") | scheme(before, here)
    closes = after.isNull() | (after == "O") | scheme(here, after)
    edges = (
        placed.select(*keys, "tid", "tag", "chunk", opens.alias("opens"), closes.alias("closes"))
        .where(G.is_entity(F.col("tag")) & (F.col("chunk") == chunk) & (F.col("opens") | F.col("closes")))
    )
    # Opening and closing tokens alternate, so the next edge closes a run. An
    # edge without its partner in the chunk is loose; there are at most two per
    # chunk of a million tokens, and they are lined up over the whole sequence.
    paired = edges.select(
        "*",
        F.when(F.col("closes"), F.col("tid")).otherwise(F.lead("tid").over(w)).alias("last"),
        F.lag("tid").over(w).alias("earlier"),
    )
    starts = F.col("opens") & F.col("last").isNotNull()
    loose = (F.col("opens") & F.col("last").isNull()) | (~F.col("opens") & F.col("earlier").isNull())
    lined = paired.where(starts | loose).withColumn("line", F.when(loose, F.lit(-1)).otherwise(F.col("chunk")))
    across = Window.partitionBy(*keys, "line").orderBy("tid")
    joined = lined.withColumn(
        "last", F.when(F.col("line") == -1, F.lead("tid").over(across)).otherwise(F.col("last")))
    return joined.where("opens").select(
        *keys, F.col("tid").alias("start"), (F.col("last") + 1).alias("end"), "tag")


def io_runs(tokens: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Runs of one identical tag: ``(sid, start, end, type)``."""
    return runs(tokens, io_break, chunk_rows).withColumnRenamed("tag", "type")


def bio_entities(tokens: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """BIO entities: ``(sid, start, end, type, invalid)``.

    ``invalid`` marks an entity that opens with an inside tag.
    """
    found = runs(tokens, bio_break, chunk_rows)
    return found.select(
        "sid", "start", "end",
        G.entity_type(F.col("tag")).alias("type"),
        G.has_prefix(F.col("tag"), "I").alias("invalid"),
    )


def _around(seeds: DataFrame, entities: DataFrame, extra: list[str], bucket: int = 16) -> DataFrame:
    """Every seed with the ``start`` and ``end`` of the run that covers it.

    Point in interval by equi-join: a run is listed once per 16 positions, so
    a bucket holds at most 16 runs whatever the length of its sentence. A seed
    outside all runs stands for itself.
    """
    steps = CHUNK_ROWS // bucket
    first, last = F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)
    # Two steps, so that the list of buckets of an endless run stays short.
    blocks = entities.withColumn("_first", first).withColumn("_last", last).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_first") / steps), F.floor(F.col("_last") / steps))))
    pieces = blocks.withColumn(
        "bucket",
        F.explode(F.sequence(
            F.greatest(F.col("_first"), F.col("_block") * steps),
            F.least(F.col("_last"), F.col("_block") * steps + (steps - 1)),
        )),
    ).select("sid", "bucket", "start", "end", *extra)
    s = seeds.withColumn("bucket", F.floor(F.col("tid") / bucket)).alias("s")
    p = pieces.alias("p")
    inside = (
        (F.col("s.sid") == F.col("p.sid")) & (F.col("s.bucket") == F.col("p.bucket"))
        & (F.col("s.tid") >= F.col("p.start")) & (F.col("s.tid") < F.col("p.end"))
    )
    return s.join(p, inside, "left").select(
        "s.sid", "s.tid",
        F.coalesce("p.start", "s.tid").alias("start"),
        F.coalesce("p.end", F.col("s.tid") + 1).alias("end"),
        *[F.col(f"p.{c}") for c in extra],
    )


def _positions_of(spans: DataFrame) -> DataFrame:
    """One row per position of each span, listed a block at a time."""
    blocks = spans.withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("start") / CHUNK_ROWS), F.floor((F.col("end") - 1) / CHUNK_ROWS))),
    )
    return blocks.withColumn(
        "tid",
        F.explode(F.sequence(
            F.greatest(F.col("start"), F.col("_block") * CHUNK_ROWS),
            F.least(F.col("end") - 1, F.col("_block") * CHUNK_ROWS + (CHUNK_ROWS - 1)),
        )),
    ).drop("_block")


def _sentences_of(tokens: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """Tokens of the seeds' sentences; ``k`` bounds the number of seeds."""
    return tokens.join(at_most(seeds.select("sid").distinct(), k), "sid", "left_semi")


def expand_runs(seeds: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """Seeds widened to the maximal run of entity tokens: distinct ``(sid, tid)``."""
    entities = runs(_sentences_of(tokens, seeds, k), any_entity_break)
    covered = _around(seeds, entities, []).select("sid", "start", "end").distinct()
    return _positions_of(covered).select("sid", "tid")


def expand_entities(seeds: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """Seeds widened to their BIO entity: ``(sid, seed, tid, invalid)``.

    ``invalid`` marks a seed whose entity opens with an inside tag.
    """
    entities = bio_entities(_sentences_of(tokens, seeds, k))
    covered = _around(seeds, entities, ["invalid"]).withColumnRenamed("tid", "seed")
    return _positions_of(covered).select(
        "sid", "seed", "tid", F.coalesce("invalid", F.lit(False)).alias("invalid"))
