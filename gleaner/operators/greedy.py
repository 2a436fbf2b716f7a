"""Initial sets where every pick changes the scores of what is left.

Both rules share two properties. A row's score only falls as picks are made, so
an old score is an upper bound. And a pick changes a row only through terms that
the row's score rests on at the time: its heaviest terms, or those not covered
yet. So picks need not be made one after another:

* A turn takes the ``head``, the best rows by their old scores, and scores them
  afresh. Rows that still beat whatever is outside the head are live.
* A live row that no better live row shares such a term with is picked with the
  score it has: whatever is picked before it leaves it alone. All such rows are
  picked in one turn, by a minimum for each term and a join.
* Where rows stand in each other's way, as at the start, when all texts share
  their frequent terms, few are picked so. Then the best live rows are settled
  on the driver instead, pick by pick: ``batch`` of them, or more as long as
  they have no more than ``driver_terms`` terms in all.

No more rows are live at a time than picks are left, so every pick is one of the
wanted set, and their order is that of their scores. The result equals
rescoring everything after every single pick. Old scores, counts and picks stay
tables, and only the rows ahead of the others are written anew in a turn; the
driver sees ``driver_terms`` terms, or those of ``batch`` rows.
"""

from __future__ import annotations

import heapq
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.hashing import uniform
from gleaner.functions.tags import is_entity
from gleaner.operators.skew import at_most, cut_lineage, join_hot, positions
from gleaner.operators.tfidf import Vectorizer, tfidf_rows
from gleaner.operators.topk import By, first_k

log = logging.getLogger(__name__)

# Terms of one row as (term, weight, times the term was picked so far).
RowTerms = list[tuple[str | int, float, int]]

FEW = 4
"""Where fewer rows are picked at once than one in so many of those that can be settled one by one, these are settled."""

FRONT = 16
"""Heads of rows that are set apart from the table at a time."""

DRIVER_TERMS = 200_000
"""Most terms of rows that are settled on the driver in a turn."""

DRIVER_ROWS = 20_000
"""Most rows that are."""


def without_repeats(
    texts: DataFrame, size: int, top_k: int = 5, how: Vectorizer = Vectorizer(ngrams=(1, 1), stop_words="english"),
    batch: int = 128, driver_terms: int = DRIVER_TERMS,
) -> DataFrame:
    """Best TF-IDF mean first; a pick halves the weights of its terms everywhere: ``(step, sid, score)``."""

    def judged(weights: DataFrame) -> DataFrame:
        of_row = Window.partitionBy("sid")
        faded = weights.withColumn("f", F.col("w") * F.pow(F.lit(2.0), -F.col("c")))
        ranked = faded.withColumn("r", F.row_number().over(of_row.orderBy(F.col("f").desc(), "term")))
        ranked = ranked.withColumns({"s": F.sum("f").over(of_row), "top": F.avg(F.when(F.col("r") <= top_k, F.col("f"))).over(of_row)})
        # A row of almost nothing rests on all of its terms, as their sum decides whether it counts.
        return ranked.select("sid", "term", "w", "c", F.when(F.col("s") < 1e-6, 0.0).otherwise(F.col("top")).alias("score"),
                             ((F.col("r") <= top_k) | (F.col("top") < 2e-6)).alias("rests"))

    def score(terms: RowTerms) -> float:
        faded = sorted((w * 0.5**c for _, w, c in terms), reverse=True)
        if sum(faded) < 1e-6:
            return 0.0
        best = faded[:top_k]
        return round(sum(best) / len(best), 9)

    added = lambda values: F.aggregate(values, F.lit(0.0), lambda a, w: a + w)
    top = F.slice(F.sort_array("ws", asc=False), 1, top_k)
    start = F.when(added("ws") < 1e-6, 0.0).otherwise(added(top) / F.size(top))
    # Nobody reads the terms, so they are numbers.
    listed = tfidf_rows(texts, how).withColumnRenamed("ids", "terms")
    return _pick(texts.select("sid"), listed, start, size, judged, score, F.col("sid"), batch, driver_terms)


def cover(
    tokens: DataFrame, size: int | Callable[[int], int], seed: int = 1, batch: int = 128, driver_terms: int = DRIVER_TERMS,
) -> DataFrame:
    """``tokens(sid, tid, token, tag)``: most entity tokens with a text not seen yet: ``(step, sid, score)``.

    Equal counts are ordered by a seeded hash of the id. ``size`` may be a
    function of the number of ids. The tokens are read once.
    """

    def judged(weights: DataFrame) -> DataFrame:
        fresh, of_row = F.col("c") == 0, Window.partitionBy("sid")
        # What is covered never counts again.
        return weights.where(fresh).select("sid", "term", "w", "c", F.sum("w").over(of_row).alias("score"), F.lit(True).alias("rests"))

    def score(terms: RowTerms) -> float:
        return sum(w for _, w, c in terms if c == 0)

    # All tokens of an id that count for nothing are one row, which keeps the id without another look at the tokens.
    counts = F.coalesce(is_entity(F.col("tag")), F.lit(False))
    weights = (
        tokens.groupBy("sid", counts.alias("counts"), F.when(counts, F.col("token")).alias("term"))
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    packed = weights.groupBy("sid").agg(F.collect_list(F.when(F.col("counts"), F.struct("term", "w"))).alias("e"))
    listed = packed.select("sid", F.col("e.term").alias("terms"), F.col("e.w").alias("ws"))
    start = F.aggregate("ws", F.lit(0.0), lambda a, w: a + w)
    return _pick(None, listed, start, size, judged, score, uniform(seed, "sid"), batch, driver_terms)


def _pick(
    ids: DataFrame | None,
    listed: DataFrame,
    start: Column,
    size: int | Callable[[int], int],
    judged: Callable[[DataFrame], DataFrame],
    score: Callable[[RowTerms], float],
    tie: Column,
    batch: int,
    driver_terms: int,
) -> DataFrame:
    """``listed(sid, terms, ws)``, a row of a text each, with the score ``start`` before any pick.

    ``ids`` are those of all texts, or None where all of them are listed.
    ``judged`` adds to rows ``(sid, term, w)`` with counts ``c`` the row's ``score`` and whether it ``rests`` on the term.
    """
    spark = listed.sparkSession
    # A turn passes over texts, not over all of their terms; the first scores need no more than a text either.
    listed = cut_lineage(listed)
    scored = listed.select("sid", start.alias("score"))
    whole = scored if ids is None else ids.join(scored, "sid", "left")
    pool = cut_lineage(whole.select("sid", tie.alias("tie"), _rounded("score")))
    left = pool.count()
    size = size(left) if callable(size) else size
    # How often each term has been picked; terms never picked have no row.
    counts = spark.createDataFrame([], f"term {listed.schema['terms'].dataType.elementType.simpleString()}, c int")
    picks: list[DataFrame] = []
    done, turn, rows = 0, 0, 4 * batch
    front, rest, edge, n_front, n_rest = pool, None, None, left, 0
    while done < size and left:
        turn += 1
        if n_rest == 0 and FRONT * rows < n_front:  # set the best rows apart, so that a turn doesn't write all others anew
            whole, n_front = front, FRONT * rows
            front = cut_lineage(first_k(whole, _ORDER, n_front))
            rest, n_rest = cut_lineage(whole.join(at_most(front.select("sid"), n_front), "sid", "left_anti")), left - n_front
            edge = front.agg(F.max(_key()).alias("k")).first()["k"]
        part = rows < n_front
        head = cut_lineage(first_k(front, _ORDER, rows)) if part else front
        own = listed.join(at_most(head.select("sid"), min(rows, n_front)), "sid", "left_semi").select("sid", F.inline(F.arrays_zip("terms", "ws")).alias("term", "w"))
        near = cut_lineage(judged(own.join(counts, "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))))
        scored = near.groupBy("sid").agg(F.first("score").alias("score"), F.count(F.lit(1)).alias("m"))
        fresh = cut_lineage(head.select("sid", "tie").join(scored, "sid", "left").select(
            "sid", "tie", _rounded("score"), F.coalesce("m", F.lit(0)).alias("m"), _key().alias("k")))
        bound = edge
        if part:
            last = head.agg(F.max(_key()).alias("k")).first()["k"]
            bound = last if edge is None else min(last, edge)
        live = fresh if bound is None else fresh.where(F.col("k") <= _literal(fresh, bound))
        n_live = live.count()
        taken, how, few = 0, "nothing live", 0
        if n_live:
            best, following = _best_few(live, batch, driver_terms)
            few = len(best)
            own_live = cut_lineage(first_k(live, _ORDER, size - done)) if n_live > size - done else live
            new, how = cut_lineage(_dominant(own_live, near)), "all at once"
            taken = new.count()
            if FEW * taken < few:
                new, how = _settled(live, near, score, size - done, best, following or bound), "one by one"
                taken = new.count()
            picks.append(new)
        log.info("greedy turn %d: %d of %d rows looked at, %d live, %d picked %s", turn, min(rows, n_front), left, n_live, taken, how)
        if taken:
            gone = at_most(new.select("sid"), taken)
            added = near.join(gone, "sid", "left_semi").groupBy("term").agg(F.count(F.lit(1)).cast("int").alias("c"))
            counts = cut_lineage(counts.unionByName(added).groupBy("term").agg(F.sum("c").cast("int").alias("c")))
            fresh = fresh.join(gone, "sid", "left_anti")
        behind = front.join(at_most(head.select("sid"), rows), "sid", "left_anti") if part else None
        fresh = fresh.select("sid", "tie", "score")
        front = fresh if behind is None else behind.unionByName(fresh)
        done, left, n_front = done + taken, left - taken, n_front - taken
        if n_rest and 4 * n_live < rows and bound == edge:  # the others come up to the best
            front, n_front, rest, edge, n_rest = front.unionByName(rest), left, None, None, 0
        front = cut_lineage(front)
        rows = _next_rows(rows, n_live, few, size - done, max(left, batch), how == "one by one")
        if len(picks) > 16:  # keep plans short
            picks = [cut_lineage(_union(picks))]
    if not picks:
        return spark.createDataFrame([], "step int, sid long, score double")
    return _numbered(_union(picks))


def _next_rows(rows: int, n_live: int, few: int, wanted: int, most: int, one_by_one: bool) -> int:
    """How many rows the next turn looks at.

    More where old scores are far off, or where there is room for more at once.
    Where far more rows are live than can be settled one by one, looking at them
    all again in each turn gains nothing: then so many that enough stay live.
    """
    if 4 * n_live < rows or n_live < wanted and n_live <= few:
        return min(rows * 4, most)
    if one_by_one and n_live > 8 * few:
        return min(max(4 * few, rows * 4 * few // n_live), most)
    return rows


_ORDER = [By("score", True), By("tie"), By("sid")]


def _rounded(c: str) -> Column:
    return F.round(F.coalesce(F.col(c), F.lit(0.0)), 9).alias(c)


def _key() -> Column:
    """Smaller is picked earlier."""
    score = F.round(F.coalesce(F.col("score"), F.lit(0.0)), 9)
    return F.struct((-score).alias("down"), F.col("tie").alias("tie"), F.col("sid").alias("sid"))


def _literal(fresh: DataFrame, key) -> Column:
    kind = fresh.schema["k"].dataType
    return F.struct(*[F.lit(key[name]).cast(kind[name].dataType).alias(name) for name in ("down", "tie", "sid")])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _numbered(picks: DataFrame) -> DataFrame:
    """Steps by score; picks are dealt to ranges where they are many."""
    ordered = picks.select("sid", "score", "tie", (-F.col("score")).alias("_down"), F.lit(0).alias("_all"))
    placed = positions(ordered, ["_all"], ["_down", "tie", "sid"], "step")
    return placed.select((F.col("step") + 1).cast("int").alias("step"), "sid", "score")


def _dominant(live: DataFrame, near: DataFrame) -> DataFrame:
    """Live rows that no better live row shares a term with that their score rests on: ``(sid, tie, score)``."""
    terms = near.select("sid", "term", "rests").join(live.select("sid", "k"), "sid")
    best = terms.groupBy("term").agg(F.min("k").alias("best"))
    # A frequent term's rows are many on one side only and are split by Spark (AQE, skewed joins).
    blocked = join_hot(terms.where("rests"), best, "term").where(F.col("k") > F.col("best")).select("sid").distinct()
    return live.join(blocked, "sid", "left_anti").select("sid", "tie", "score")


def _best_few(live: DataFrame, batch: int, driver_terms: int) -> tuple[list[tuple], tuple | None]:
    """Keys of the best live rows, ``batch`` or as many as have ``driver_terms`` terms in all, and the key that follows."""
    most = max(batch, min(driver_terms, DRIVER_ROWS))
    found = first_k(live, _ORDER, most + 1).select("sid", "tie", "score", "m").toArrow().to_pylist()
    found = sorted((-r["score"], r["tie"], r["sid"], r["m"]) for r in found)
    few, terms = 0, 0
    for *_, m in found[:most]:
        terms += m
        if few >= batch and terms > driver_terms:
            break
        few += 1
    keys = [key[:3] for key in found[:few + 1]]
    return keys[:few], keys[few] if len(keys) > few else None


def _settled(live: DataFrame, near: DataFrame, score, wanted: int, inside: list[tuple], outside: tuple | None) -> DataFrame:
    """Picks that are certain from the best live rows ``inside``, at least one: ``(sid, tie, score)``.

    ``outside`` is the key that the best row elsewhere has at least.
    """
    spark = live.sparkSession
    wide = F.broadcast(spark.createDataFrame([(sid,) for _, _, sid in inside], live.select("sid").schema))
    terms: dict[int, list[tuple]] = {sid: [] for _, _, sid in inside}
    for part in near.join(wide, "sid", "left_semi").select("sid", "term", "w", "c").toArrow().to_batches():
        for sid, *entry in zip(*(column.to_pylist() for column in part.columns)):
            terms[sid].append(tuple(entry))
    extra: dict[str | int, int] = {}
    heapq.heapify(inside)
    picks = []
    while inside and len(picks) < wanted:
        down, tie, sid = heapq.heappop(inside)
        # The first one has its score from Spark already; sums in another order could differ in the last digit.
        entry = (-float(score([(t, w, c + extra.get(t, 0)) for t, w, c in terms[sid]])), tie, sid) if picks else (down, tie, sid)
        if inside and entry > inside[0]:
            heapq.heappush(inside, entry)
            continue
        if picks and outside is not None and entry > outside:
            break
        picks.append(entry)
        for t, _, _ in terms[sid]:
            extra[t] = extra.get(t, 0) + 1
    return spark.createDataFrame([(sid, tie, -down + 0.0) for down, tie, sid in picks], live.select("sid", "tie", "score").schema)
