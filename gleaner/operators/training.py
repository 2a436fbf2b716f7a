"""Training rows from partly annotated sentences.

Input rows have ``sid``, ``tokens``, ``al_tags`` (-100 where not annotated) and,
for the styles that look at candidates, ``pos_tags_text``. Output rows are
``(sid, window_no, tokens, ner_tags)``. All styles work inside the row: no
shuffle, no Python. A fully annotated sentence is one row in every style.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions.arrays import computed
from gleaner.functions.tags import required_pos

MASK_ALL = "mask_all_unknown"
DROP_ALL = "drop_all_unknown"
MASK_ENTITY = "mask_entity_looking_unknowns"
DROP_ENTITY = "drop_entity_looking_unknowns"
DYNAMIC_WINDOW = "dynamic_window"
STYLES = [MASK_ALL, DROP_ALL, MASK_ENTITY, DROP_ENTITY, DYNAMIC_WINDOW]


def with_candidates(rows: DataFrame) -> DataFrame:
    """Add ``inside``, a flag per token, and ``cands``, the candidate spans.

    A candidate is one or more proper nouns, optionally followed by a
    preposition and one or more proper nouns. With one letter per tag, the
    joining prepositions are marked by one regex replacement; candidates are
    then the maximal runs of marked letters, because a match always ends where
    its proper nouns end. Spans are ``(start, end, full)``, ``full`` meaning
    that every token of the span is annotated.
    """
    if "pos_tags_text" not in rows.columns:
        raise ValueError("this training style needs part-of-speech tags (column pos_tags_text)")
    letter = lambda p: F.when(p == "NNP", "N").when(p == "IN", "I").otherwise("O")
    letters = F.array_join(F.transform(required_pos(), letter), "")
    marked = F.regexp_replace(letters, "(N+)I(N+)", "$1X$2")
    rows = computed(rows, _marked=F.translate(marked, "XI", "NO"))
    chars = F.when(F.col("_marked") == "", F.array().cast("array<string>")).otherwise(F.split("_marked", ""))
    # Each candidate with the gap before it, so that what follows goes by candidates and not by tokens.
    pieces = F.regexp_extract_all("_marked", F.lit("O*N+"), F.lit(0))

    def place(acc: Column, piece: Column) -> Column:
        end = acc["last"] + F.length(piece)
        bounds = F.struct((end - F.length(F.replace(piece, F.lit("O"), F.lit("")))).alias("start"), end.alias("end"))
        return F.struct(F.array_append(acc["seen"], bounds).alias("seen"), end.alias("last"))
    nothing = F.struct(F.array().cast("array<struct<start: int, end: int>>").alias("seen"), F.lit(0).alias("last"))
    span = F.transform(
        F.aggregate(pieces, nothing, place, lambda acc: acc["seen"]),
        lambda z: F.struct(
            z["start"].alias("start"),
            z["end"].alias("end"),
            (~F.array_contains(F.slice("al_tags", z["start"] + 1, z["end"] - z["start"]), UNKNOWN)).alias("full"),
        ),
    )
    # Plain columns: a style that reads one of them doesn't work out the other.
    return rows.withColumns({"inside": F.transform(chars, lambda c: c == "N"), "cands": span}).drop("_marked")


def _row(tokens: Column | str, tags: Column | str, window_no: Column | None = None) -> list[Column]:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return [
        F.col("sid"),
        (F.lit(0) if window_no is None else window_no).cast("int").alias("window_no"),
        as_col(tokens).alias("tokens"),
        as_col(tags).alias("ner_tags"),
    ]


def _is_full() -> Column:
    return ~F.array_contains("al_tags", UNKNOWN)


def _zero_unknown(tags: Column | str) -> Column:
    return F.transform(tags, lambda t: F.when(t == UNKNOWN, 0).otherwise(t))


def mask_all_unknown(rows: DataFrame) -> DataFrame:
    """Tags as they are; unannotated tokens stay -100."""
    return rows.select(*_row("tokens", "al_tags"))


def drop_all_unknown(rows: DataFrame) -> DataFrame:
    """Annotated tokens only. Sentences with none are left to ``without_annotation``."""
    known = F.filter(
        F.arrays_zip(F.col("tokens").alias("w"), F.col("al_tags").alias("t")), lambda z: z["t"] != UNKNOWN)
    return (
        rows.select("sid", known.alias("z"))
        .where(F.size("z") > 0)
        .select(*_row(F.col("z.w"), F.col("z.t")))
    )


def without_annotation(rows: DataFrame) -> DataFrame:
    """Rows that ``drop_all_unknown`` cannot use: nothing in them is annotated."""
    return rows.where(~F.exists("al_tags", lambda t: t != UNKNOWN))


def mask_entity_looking_unknowns(rows: DataFrame) -> DataFrame:
    """Unannotated tokens: -100 inside candidates, 0 elsewhere."""
    found = with_candidates(rows)
    tags = F.zip_with(
        "al_tags", "inside", lambda t, inside: F.when((t == UNKNOWN) & ~inside, 0).otherwise(t))
    return found.select(*_row("tokens", tags))


def drop_entity_looking_unknowns(rows: DataFrame) -> DataFrame:
    """Unannotated tokens: dropped inside candidates, 0 elsewhere."""
    found = with_candidates(rows)
    zipped = F.arrays_zip(
        F.col("tokens").alias("w"), F.col("al_tags").alias("t"), F.col("inside").alias("inside"))
    kept = F.filter(zipped, lambda z: (z["t"] != UNKNOWN) | ~z["inside"])
    return found.select("sid", kept.alias("z")).select(*_row(F.col("z.w"), _zero_unknown(F.col("z.t"))))


def dynamic_window(rows: DataFrame) -> DataFrame:
    """One row per candidate, reaching to the nearest candidates not fully annotated.

    Without a candidate the sentence keeps its -100. With one candidate, or
    with all candidates annotated, it is one row whose unknown tokens become 0.
    Otherwise the row of a candidate keeps -100 in that candidate alone.
    """
    found = computed(with_candidates(rows).drop("inside"), cands=F.col("cands"))
    single = _is_full() | (F.size("cands") == 0)
    closed = ~single & ((F.size("cands") == 1) | ~F.exists("cands", lambda c: ~c["full"]))
    kind = F.when(single, "keep").when(closed, "close").otherwise("split")
    found = found.withColumn("_kind", kind)

    # Windows are numbers until the end: a candidate's window ends where the
    # nearest candidate with a gap before or after it ends or starts.
    cells = F.size("al_tags")
    edge = lambda c, side: F.when(~c["full"], c[side])
    none = F.array().cast("array<int>")
    running = lambda cands, side, start: F.aggregate(
        cands, F.struct(none.alias("seen"), start.alias("last")),
        lambda acc, c: F.struct(F.array_append(acc["seen"], acc["last"]).alias("seen"), F.coalesce(edge(c, side), acc["last"]).alias("last")),
        lambda acc: acc["seen"])
    found = computed(found, _left=running(F.col("cands"), "end", F.lit(0)),
                     _right=F.reverse(running(F.reverse("cands"), "start", cells)))
    split = F.transform(F.arrays_zip(F.col("cands").alias("c"), F.col("_left").alias("l"), F.col("_right").alias("r")), lambda z: F.struct(
        z["l"].alias("left"), z["r"].alias("right"), z["c"]["start"].alias("start"), z["c"]["end"].alias("end")))
    whole = F.array(F.struct(F.lit(0).alias("left"), cells.alias("right"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    windows = found.select("sid", "tokens", "al_tags", "_kind", F.when(F.col("_kind") == "split", split).otherwise(whole).alias("_w"))

    def row(w: Column) -> Column:
        cut = lambda c: F.slice(c, w["left"] + 1, w["right"] - w["left"])
        inside = lambda i: (i + w["left"] >= w["start"]) & (i + w["left"] < w["end"])
        closed = lambda i: (F.col("_kind") == "close") | ((F.col("_kind") == "split") & ~inside(i))
        tags = F.transform(cut(F.col("al_tags")), lambda t, i: F.when((t == UNKNOWN) & closed(i), 0).otherwise(t))
        return F.struct(cut(F.col("tokens")).alias("tokens"), tags.alias("ner_tags"))

    rows_of = windows.select("sid", F.posexplode(F.transform("_w", row)).alias("window_no", "r"))
    return rows_of.select(*_row("r.tokens", "r.ner_tags", F.col("window_no")))


_BY_STYLE = {
    MASK_ALL: mask_all_unknown,
    DROP_ALL: drop_all_unknown,
    MASK_ENTITY: mask_entity_looking_unknowns,
    DROP_ENTITY: drop_entity_looking_unknowns,
    DYNAMIC_WINDOW: dynamic_window,
}


def materialize(rows: DataFrame, style: str) -> DataFrame:
    """Training rows in the named style."""
    if style not in _BY_STYLE:
        raise ValueError(f"unknown training style {style!r}; choose from {STYLES}")
    return _BY_STYLE[style](rows)
