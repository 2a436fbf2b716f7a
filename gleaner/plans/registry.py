"""Registered queries: one per operator, over the whole benchmark tables.

Results are emitted in long form or as joined strings, doubles rounded to six
decimals, so that they can be compared row by row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import scores as S
from gleaner.functions.tags import decode
from gleaner.operators import (
    annotate, dictionary, greedy, initial, metrics, predictions, query, spans, tfidf, training, vectors,
)
from gleaner.operators.lookup import join_counted
from gleaner.operators.skew import checkpoint_dir, cut_lineage
from gleaner.plans import fixtures as X
from gleaner.plans import loop
from gleaner.sources import checked, corpus, results, views

Query = Callable[[SparkSession, str], DataFrame]

K = 500
PICKS = 10
TOP = 5
PLAIN = tfidf.Vectorizer(ngrams=(1, 2), stop_words=None)
NO_STOPS = tfidf.Vectorizer(ngrams=(1, 2), stop_words=X.STOP_WORDS)
SINGLE = tfidf.Vectorizer(ngrams=(1, 1), stop_words=X.STOP_WORDS)
UNIT = tfidf.Vectorizer(ngrams=(1, 1), stop_words=X.STOP_WORDS, norm="l2")


def _six(c: str) -> Column:
    return F.round(c, 6).alias(c)


def _joined(c: str) -> Column:
    return F.array_join(F.col(c).cast("array<string>"), " ").alias(c)


# --- predictions and scores -------------------------------------------------


def softmax_mask(spark, d):
    rows = predictions.valid_softmax(X.raw_predictions(spark, d), len(X.TEXT_TAGS))
    return rows.select("sid", "tid", *[F.round(F.col("scores")[i], 6).alias(f"p{i}") for i in range(len(X.TEXT_TAGS))])


def argmax_decode(spark, d):
    return predictions.argmax_tags(X.raw_predictions(spark, d), X.TEXT_TAGS)


def unroll_scores(spark, d):
    nested = X.raw_predictions(spark, d).select("sid", F.col("logits").alias("scores"))
    return predictions.unroll(nested).select("sid", "tid", _sum_of("scores").alias("total"))


def _sum_of(c: str) -> Column:
    return F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)


def _scored(measure: Callable[[str], Column]) -> Query:
    def run(spark, d):
        return X.line_predictions(spark, d).select("sid", "tid", F.round(measure("scores"), 6).alias("score"))
    return run


def inverse_margin(spark, d):
    rows = X.line_predictions(spark, d)
    weight = S.inverse_margin_log_weight(F.round(S.margin("scores"), 12))
    return rows.select("sid", "tid", F.round(weight, 6).alias("log_weight"))


def sentence_scores(spark, d):
    rows = X.line_predictions(spark, d)
    return rows.select("sid", S.entropy("scores").alias("e"), S.margin("scores").alias("m"), S.confidence("scores").alias("c")).groupBy(
        "sid").agg(
        F.round(F.max("e"), 6).alias("max_entropy"),
        F.round(F.min("m"), 6).alias("min_margin"),
        F.round(F.min("c"), 6).alias("min_confidence"),
        F.round(F.avg("e"), 6).alias("mean_entropy"),
        F.round(F.sum("m"), 6).alias("sum_margin"),
    )


def exclude_tokens(spark, d):
    tokens = X.line_tokens(spark, d)
    return predictions.without_labelled_tokens(tokens, X.labelled_tokens(tokens))


def exclude_sentences(spark, d):
    tokens = X.line_tokens(spark, d)
    pool = tokens.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    return predictions.without_labelled_sentences(pool, X.labelled_sentences(tokens))


def collapse_tokens(spark, d):
    picked = X.labelled_tokens(X.line_tokens(spark, d))
    return predictions.collapse(picked).select("sid", "block_no", _joined("tids"))


def length_check(spark, d):
    nested = X.raw_predictions(spark, d).select("sid", F.col("logits").alias("scores"))
    # Every third sentence lacks the prediction of its last word.
    short = F.slice("scores", 1, F.size("scores") - F.when(F.col("sid") % 3 == 0, 1).otherwise(0))
    sentences = X.sentences(spark, d)
    return predictions.length_mismatches(nested.withColumn("scores", short), sentences)


# --- query strategies -------------------------------------------------------


def _token_query(strategy: str) -> Query:
    def run(spark, d):
        pred = X.line_predictions(spark, d)
        picked = query.rank_tokens(pred, X.labelled_tokens(pred), strategy, K)
        return picked.select("sid", "tid", _six("score"))
    return run


def _sentence_query(strategy: str) -> Query:
    def run(spark, d):
        pred = X.line_predictions(spark, d)
        picked = query.rank_sentences(pred, X.labelled_sentences(pred), strategy, K)
        return picked.select("sid", _six("score"))
    return run


def _entity_query(strategy: str) -> Query:
    def run(spark, d):
        pred = X.line_predictions(spark, d)
        out = query.query(query.ENTITY, strategy, pred, pred, X.labelled_tokens(pred), K, guard=False)
        return out.selections
    return run


def _row_query(strategy: str, lowest_class: bool = True) -> Query:
    def run(spark, d):
        picked = query.rank_rows(X.class_scores(spark, d), strategy, 100, lowest_class=lowest_class)
        return picked.select("id", _six("score"))
    return run


# --- entities and annotation ------------------------------------------------


def typed_entity(spark, d):
    tokens = X.line_tokens(spark, d)
    seeds = X.seeds(tokens)
    return spans.expand_entities(seeds, tokens, seeds.count())


def run_entity(spark, d):
    tokens = X.line_tokens(spark, d)
    seeds = X.seeds(tokens)
    return spans.expand_runs(seeds, tokens, seeds.count())


def annotate_sentences(spark, d):
    tokens = X.line_tokens(spark, d)
    picks = X.seeds(tokens).select("sid").distinct()
    return annotate.sentences(tokens, X.labelled_tokens(tokens), picks, picks.count())


def annotate_tokens(spark, d):
    tokens = X.line_tokens(spark, d)
    return annotate.tokens(tokens, X.labelled_tokens(tokens), X.seeds(tokens))


def annotated_guard(spark, d):
    tokens = X.line_tokens(spark, d)
    return annotate.repeated(tokens, X.labelled_tokens(tokens), X.seeds(tokens))


def annotated_count(spark, d):
    return annotate.annotated_per_sentence(X.labelled_tokens(X.line_tokens(spark, d)))


def annotated_values(spark, d):
    return annotate.from_arrays(X.partly_annotated(spark, d))


def annotated_arrays(spark, d):
    known = annotate.from_arrays(X.partly_annotated(spark, d, 0.3))
    return annotate.to_arrays(X.sentences(spark, d), known).select("sid", _joined("al_tags"))


# --- training rows ----------------------------------------------------------


def candidates(spark, d):
    found = training.with_candidates(X.partly_annotated(spark, d))
    return found.select("sid", F.explode("cands").alias("c")).select(
        "sid", F.col("c.start").cast("long").alias("start"), F.col("c.end").cast("long").alias("end"),
        F.col("c.full").alias("full_span"))


def _style(style: str) -> Query:
    def run(spark, d):
        rows = training.materialize(X.partly_annotated(spark, d), style)
        return rows.select("sid", "window_no", _joined("tokens"), _joined("ner_tags"))
    return run


def train_rejects(spark, d):
    return training.without_annotation(X.partly_annotated(spark, d)).select("sid", _joined("tokens"))


def training_stats(spark, d):
    return metrics.training_stats(training.dynamic_window(X.partly_annotated(spark, d)))


# --- metrics ----------------------------------------------------------------


def io_spans(spark, d):
    return spans.io_runs(metrics.side(X.event_pairs(spark, d), "gold"))


def io_counts(spark, d):
    return metrics.io_counts(X.event_pairs(spark, d))


def io_prf(spark, d):
    return metrics.io_scores(X.event_pairs(spark, d)).select(
        "n_pred", "n_gold", "n_correct", _six("precision"), _six("recall"), _six("f1"))


def type_errors(spark, d):
    return metrics.type_errors(X.event_pairs(spark, d)).select("within", "outer", _six("same_span"))


def bio_entities(spark, d):
    return spans.bio_entities(X.line_tokens(spark, d))


def bio_prf(spark, d):
    pairs = X.line_predictions(spark, d).select(
        "sid", "tid", F.col("tag").alias("gold"), decode(S.argmax("scores"), X.LINE_TAGS).alias("pred"))
    return metrics.bio_scores(pairs).select(
        "type", _six("precision"), _six("recall"), _six("f1"), "number", _six("accuracy"))


def bio_prf_splits(spark, d):
    """Three splits in one scan."""
    pairs = X.line_predictions(spark, d).select(
        F.concat(F.lit("part"), (F.col("sid") % 3).cast("string")).alias("split"),
        "sid", "tid", F.col("tag").alias("gold"), decode(S.argmax("scores"), X.LINE_TAGS).alias("pred"))
    return metrics.bio_scores(pairs, ("split",)).select(
        "split", "type", _six("precision"), _six("recall"), _six("f1"), "number", _six("accuracy"))


def tag_distribution(spark, d):
    return metrics.tag_distribution(X.labelled_tokens(X.line_tokens(spark, d)))


def annotation_stats(spark, d):
    tokens = X.line_tokens(spark, d)
    return metrics.annotation_stats(tokens, X.labelled_tokens(tokens)).withColumn("percentage", F.round("percentage", 6))


# --- sources ----------------------------------------------------------------


def _as_corpus_rows(spark, d) -> DataFrame:
    rows = X.sentences(spark, d)
    return rows.withColumnRenamed("sid", "id").withColumn(
        "fine_ner_tags", F.transform("tokens", lambda w: F.length(w) % 5)).withColumn("split", _split_of("id"))


def _split_of(c: str) -> Column:
    return F.when(F.col(c) % 10 < 8, "train").when(F.col(c) % 10 == 8, "validation").otherwise("test")


def flat_corpus(spark, d):
    made = corpus.conll2003(_as_corpus_rows(spark, d), full=True)
    return made.sentences.select("id", "split", _joined("tokens"), _joined("pos_tags_text"), _joined("ner_tags"))


def flatten_documents(spark, d):
    rows = corpus.flatten_documents(X.nested_documents(spark, d))
    return rows.select(
        "document_id", F.col("position").cast("long").alias("position"),
        _joined("tokens"), _joined("pos_tags"), _joined("ner_tags"))


def nested_corpus(spark, d):
    docs = X.nested_documents(spark, d)
    made = corpus.ontonotes(docs)
    return made.sentences.groupBy("document_id", "split").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum(F.size("tokens")).alias("n_tokens"))


def _faulty_corpus(spark, d) -> checked.Checked:
    """The sentences as JSON lines, some of them spoilt, read back."""
    rows = _as_corpus_rows(spark, d).select("id", "tokens", "pos_tags", "ner_tags", "split")
    nth = lambda n: F.col("id") % n == 0
    spoilt = rows.withColumns({
        "tokens": F.when(~nth(17), F.col("tokens")), "split": F.when(nth(23), "dev").otherwise(F.col("split")),
        "ner_tags": F.slice(F.transform("ner_tags", lambda t: F.when(nth(13), t + 100).otherwise(t)), 1, F.size("ner_tags") - F.when(nth(11), 1).otherwise(0))})
    line = F.to_json(F.struct(F.col("id").cast("string").alias("id"), "tokens", "pos_tags", "ner_tags", "split"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/lines/{uuid.uuid4().hex}"
    spoilt.select(F.when(nth(19), F.substring(line, 1, 25)).otherwise(line).alias("value")).write.text(path)
    return checked.read_flat(spark, path, "json", len(X.TEXT_TAGS), len(X.POS_NAMES))


def flat_accepted(spark, d):
    """What is left of a corpus with faults."""
    return _faulty_corpus(spark, d).accepted.select("id", "split", F.size("tokens").alias("n_tokens"), _joined("ner_tags"))


def flat_rejects(spark, d):
    """What is not, and why."""
    return _faulty_corpus(spark, d).rejects.select("id", "split", F.array_join("reasons", ", ").alias("reasons"))


IO_NAMES = ["o", "page-click", "page-error", "shop-buy", "shop-join", "art-film", "art-song"]


def _io_corpus(fine: bool) -> Query:
    def run(spark, d):
        made = corpus.fewnerd(_as_corpus_rows(spark, d), IO_NAMES, fine=fine)
        tags = F.transform("ner_tags", lambda t: decode(t, made.tags))
        return made.sentences.select("id", "split", _joined("tokens"), F.array_join(tags, " ").alias("tags"))
    return run


def holdout_split(spark, d):
    orders = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("train").alias("split"))
    return corpus.holdout(orders, "id")


def full_split(spark, d):
    orders = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), _split_of("o_orderkey").alias("split"))
    return corpus.split_train(orders, "id", full=True)


def text_view_io(spark, d):
    """A corpus without part-of-speech tags, by way of its reader."""
    made = corpus.fewnerd(_as_corpus_rows(spark, d), IO_NAMES)
    kept = made.sentences.where("split <> 'val_train'").withColumnRenamed("id", "sid")
    return views.text_view(kept, made.tags)


def init_longest_io(spark, d):
    return initial.longest(text_view_io(spark, d), 100).select("sid", _six("score"))


def dense_ids_text(spark, d):
    """Ids that are text, numbered in ranges."""
    orders = X.table(spark, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), _split_of("o_orderkey").alias("split"))
    return corpus.dense_ids(orders, ["id"], chunk_rows=1000)


def dense_ids(spark, d):
    orders = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), _split_of("o_orderkey").alias("split"))
    return corpus.dense_ids(orders, ["id"])


def token_table(spark, d):
    return corpus.to_tokens(X.sentences(spark, d), X.TEXT_TAGS)


def _text_view(nouns: bool) -> Query:
    def run(spark, d):
        return views.text_view(X.sentences(spark, d), X.TEXT_TAGS, proper_nouns_only=nouns)
    return run


def align_labels(spark, d):
    # Words of more than six letters come in two pieces, between two special tokens.
    pieces = F.flatten(F.transform("tokens", lambda w, i: F.when(F.length(w) > 6, F.array(i, i)).otherwise(F.array(i))))
    special = F.array(F.lit(None).cast("int"))
    rows = X.sentences(spark, d).withColumn("word_ids", F.concat(special, pieces, special))
    return views.align_labels(rows).select("sid", _joined("labels"))


# --- vectors and initial sets -----------------------------------------------


def _weights(how: tfidf.Vectorizer) -> Query:
    def run(spark, d):
        return tfidf.tfidf(X.texts(spark, d), how).select("sid", "term", _six("w"))
    return run


def _fitted(spark, d) -> dictionary.Dictionary:
    """A dictionary of the even texts."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/dictionaries/{uuid.uuid4().hex}"
    return dictionary.fit(X.texts(spark, d).where("sid % 2 = 0"), path, UNIT)


def tfidf_transform(spark, d):
    """The odd texts by what was learned from the even ones."""
    return _fitted(spark, d).transform(X.texts(spark, d).where("sid % 2 = 1")).select("sid", "term", _six("w"))


def tfidf_updated(spark, d):
    """The odd texts added to the even ones, twice by mistake: the dictionary of all texts."""
    known = _fitted(spark, d)
    for _ in range(2):
        known.update(X.texts(spark, d).where("sid % 2 = 1"), "odd")
    return known.table().select("term", "df", F.lit(known.n()).cast("long").alias("n"))


def cosine_distance(spark, d):
    weights = tfidf.tfidf(X.texts(spark, d), UNIT, ids=True).withColumnRenamed("id", "term")
    left = weights.withColumnRenamed("sid", "pair")
    right = weights.select((F.col("sid") - 1).alias("pair"), "term", "w")
    return tfidf.cosine(left, right).select("pair", _six("distance"))


def _picked(choose: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark, d):
        return choose(spark, d).select("sid", _six("score"))
    return run


def init_supervised(spark, d):
    return initial.by_type_quota(X.line_tokens(spark, d), K).select("sid", "reason")


def init_static(spark, d):
    ids = X.table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("sid"))
    return initial.static(X.texts(spark, d), ids)


def init_tfidf_nodup(spark, d):
    return greedy.without_repeats(X.texts(spark, d), PICKS, TOP, SINGLE).select("step", "sid", _six("score"))


def init_cover(spark, d):
    tokens = corpus.to_tokens(X.sentences(spark, d), X.TEXT_TAGS)
    return greedy.cover(tokens, PICKS).select("step", "sid", _six("score"))


def init_cover_share(spark, d):
    """A hundredth of the sentences."""
    tokens = corpus.to_tokens(X.sentences(spark, d), X.TEXT_TAGS)
    return greedy.cover(tokens, lambda n: n // 100, batch=16).select("step", "sid", _six("score"))


def init_kmeans(spark, d):
    return vectors.kmeans(X.texts(spark, d), PICKS, UNIT).select("cluster", "sid", _six("distance"))


def init_kmeans_nearest(spark, d):
    return vectors.kmeans(X.texts(spark, d), PICKS, UNIT, pick="nearest").select("cluster", "sid", _six("distance"))


# --- one round --------------------------------------------------------------


def _round(spark, d) -> tuple[DataFrame, query.QueryOutput]:
    pred = X.line_predictions(spark, d)
    return pred, query.query(query.ENTITY, query.BREAKING_TIES, pred, pred, X.labelled_tokens(pred), K, guard=False)


def al_round(spark, d):
    """Score the pool, pick by margin at entity level, reveal, count per tag."""
    return metrics.tag_distribution(_round(spark, d)[1].labelled)


def _frequency_model(rows: DataFrame, tags: list[str], config: loop.RunConfig) -> loop.Predict:
    """Smoothed tag frequencies of each token text: a model that SQL can repeat."""
    pairs = rows.select(F.explode(F.arrays_zip("tokens", "ner_tags")).alias("z")).select("z.tokens", "z.ner_tags").where(F.col("ner_tags") >= 0)
    seen = pairs.groupBy(F.col("tokens").alias("token")).agg(F.array(*[F.count_if(F.col("ner_tags") == i) for i in range(len(tags))]).alias("n"))
    # The scores of a text are worked out once, not for each of its tokens.
    seen = seen.withColumn("total", F.aggregate("n", F.lit(float(len(tags))), lambda acc, c: acc + c))
    seen = cut_lineage(seen.select("token", "total", F.transform("n", lambda c: (c + 1) / F.col("total")).alias("scores")))
    n_seen = seen.count()
    unknown = F.array(*[F.lit(1 / float(len(tags)))] * len(tags))

    def predict(sentences: DataFrame) -> DataFrame:
        tokens = sentences.select("sid", F.posexplode("tokens").alias("tid", "token")).withColumn("tid", F.col("tid").cast("long"))
        found = join_counted(tokens, seen, n_seen, "token", "total")
        return found.select("sid", "tid", F.coalesce("scores", unknown).alias("scores"))
    return predict


def _loop(spark, d, rounds: int = 2, fit: loop.Fit = _frequency_model, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    rows = X.sentences(spark, d).select("sid", "tokens", "ner_tags", _split_of("sid").alias("split"))
    config = loop.RunConfig(level=query.TOKEN, strategy=query.BREAKING_TIES, rounds=rounds, starting_ratio=0.05, new_examples=[K])
    return loop.run(spark, corpus.Corpus(rows, X.TEXT_TAGS), config, fit, path=path)


def al_loop(spark, d):
    """Two rounds of the loop: what is labelled in the end."""
    return _loop(spark, d)[1].select("sid", "tid", "tag")


def al_loop_resumed(spark, d):
    """Three rounds, broken off while the second trains and then taken up again: what each round added."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"
    trained = []

    def breaks(rows: DataFrame, tags: list[str], config: loop.RunConfig) -> loop.Predict:
        trained.append(1)
        if len(trained) == 2:
            raise InterruptedError("the run is broken off here")
        return _frequency_model(rows, tags, config)
    try:
        _loop(spark, d, 3, breaks, path)
    except InterruptedError:
        pass
    return _loop(spark, d, 3, path=path)[1].select("sid", "tid", "tag", "round")


def results_log(spark, d):
    """The log of the loop, appended three times and read back."""
    made, _ = _loop(spark, d)
    path = f"{checkpoint_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}"
    for _ in range(3):
        results.append(made, path)
    log = results.read(spark, path, loop.RESULT_SCHEMA)
    return log.select("round", "level", "strategy", "n_annotated", "n_non_o", "n_sentences", F.round("percentage", 6).alias("percentage"))


def al_round_stats(spark, d):
    pred, out = _round(spark, d)
    return metrics.annotation_stats(pred, out.labelled).withColumn("percentage", F.round("percentage", 6))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        f.__name__: f for f in (
            softmax_mask, argmax_decode, unroll_scores, inverse_margin, sentence_scores, exclude_tokens,
            exclude_sentences, collapse_tokens, length_check, typed_entity, run_entity, annotate_sentences,
            annotate_tokens, annotated_guard, annotated_count, annotated_values, annotated_arrays, candidates,
            train_rejects, training_stats, tfidf_transform, tfidf_updated, io_spans, io_counts, io_prf, type_errors, bio_entities, bio_prf, bio_prf_splits,
            tag_distribution, annotation_stats, flat_corpus, flat_accepted, flat_rejects, flatten_documents, nested_corpus, holdout_split,
            full_split, dense_ids, token_table, align_labels, cosine_distance, init_supervised, init_static,
            init_tfidf_nodup, init_cover, init_cover_share, init_kmeans, init_kmeans_nearest, al_round, al_round_stats,
            text_view_io, init_longest_io, dense_ids_text, al_loop, al_loop_resumed, results_log,
        )
    }
    for name, measure in {"entropy": S.entropy, "margin": S.margin, "confidence": S.confidence, "lowest": S.lowest}.items():
        found[f"score_{name}"] = _scored(measure)
    for s in query.STRATEGIES:
        found[f"tl_{s}"] = _token_query(s)
        found[f"sl_{s}"] = _sentence_query(s)
        found[f"el_{s}"] = _entity_query(s)
        if s != query.STOCHASTIC_BREAKING_TIES:
            found[f"sc_{s}"] = _row_query(s)
    found["sc_least_confidence_top"] = _row_query(query.LEAST_CONFIDENCE, lowest_class=False)
    for name, style in {
        "mask_all": training.MASK_ALL, "drop_all": training.DROP_ALL, "mask_entity": training.MASK_ENTITY,
        "drop_entity": training.DROP_ENTITY, "dynamic_window": training.DYNAMIC_WINDOW,
    }.items():
        found[f"train_{name}"] = _style(style)
    found["io_corpus_coarse"] = _io_corpus(False)
    found["io_corpus_fine"] = _io_corpus(True)
    found["text_view"] = _text_view(False)
    found["text_view_nouns"] = _text_view(True)
    found["tfidf"] = _weights(PLAIN)
    found["tfidf_unit"] = _weights(UNIT)
    found["init_random"] = _picked(lambda s, d: initial.random(X.texts(s, d), 100))
    found["init_longest"] = _picked(lambda s, d: initial.longest(X.texts(s, d), 100))
    found["init_tfidf"] = _picked(lambda s, d: initial.tfidf_top_mean(X.texts(s, d), 100, TOP, PLAIN))
    found["init_tfidf_prob"] = _picked(lambda s, d: initial.tfidf_sampled(X.texts(s, d), 100, TOP, NO_STOPS))
    found["init_dissimilar"] = _picked(lambda s, d: vectors.most_dissimilar(X.texts(s, d), 100, UNIT))
    found["init_nnp_freq"] = _picked(
        lambda s, d: initial.nnp_frequency(corpus.to_tokens(X.sentences(s, d), X.TEXT_TAGS), 100))
    found["init_nnp_filter"] = _picked(lambda s, d: initial.nnp_filter(X.sentences(s, d), 100, 0.5))
    found["init_lm_ties"] = _picked(lambda s, d: initial.lm_breaking_ties(X.lm_scores(s, d), 50))
    return found
