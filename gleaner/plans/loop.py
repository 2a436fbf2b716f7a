"""Active-learning rounds: annotate, train, score, pick, repeat.

The driver decides what runs next; all rows stay in Spark. Each round leaves
what it added and its record in shared storage (``rounds.RunStore``) before the
next begins. So a plan never grows with the number of rounds, a lost executor
costs one step at most, and a run that was ended goes on behind its last whole
step, by the same call.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import UNKNOWN
from gleaner.functions import scores as S
from gleaner.functions.arrays import after, before
from gleaner.functions.tags import decode, encode, required_pos
from gleaner.operators import annotate, greedy, initial, metrics, query, training, vectors
from gleaner.operators import predictions as P
from gleaner.operators.skew import at_most, checkpoint_dir, cut_lineage, scratch
from gleaner.operators.tfidf import Vectorizer
from gleaner.plans.rounds import BEGUN, LABELLED_STEP, REACHED, SCORED, RunStore
from gleaner.sources.corpus import Corpus, dense_ids, to_tokens
from gleaner.sources.views import text_view

Predict = Callable[[DataFrame], DataFrame]
"""Sentences ``(sid, tokens, ...)`` to ``(sid, tid, scores)``."""

Fit = Callable[[DataFrame, list[str], "RunConfig"], Predict]
"""Training rows ``(sid, window_no, tokens, ner_tags)`` to a model."""

INITIAL = [
    "random", "longest", "tfidf", "tfidf_sampled", "kmeans", "dissimilar", "supervised", "without_repeats",
    "cover", "static", "nnp_frequency", "nnp_filter", "lm_breaking_ties",
]


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run. Lists give one value per round; the last one repeats."""

    dataset: str = "corpus"
    level: str = query.SENTENCE
    strategy: str = query.RANDOM
    style: str = training.MASK_ALL
    initial: str = "random"
    metric: str = "bio"
    rounds: int = 10
    starting_ratio: float = 0.01
    new_examples: list[int] = field(default_factory=lambda: [20])
    top_k: int = 5
    ngrams: tuple[int, int] = (1, 2)
    stop_words: list[str] | str | None = None
    alpha: float = 2.0
    proper_nouns_only: bool = False
    full: bool = False
    seed: int = 1
    features: int = 1 << 14
    iterations: int = 20

    def __post_init__(self) -> None:
        if not self.full:
            if not 0 < self.starting_ratio <= 1:
                raise ValueError(f"starting_ratio must be above 0 and at most 1, not {self.starting_ratio}")
            if not self.new_examples or min(self.new_examples) < 0:
                raise ValueError(f"new_examples must be numbers from 0, one at least, not {self.new_examples}")
        for name in ("rounds", "top_k", "features", "iterations"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1, not {getattr(self, name)}")
        for name, known in (("level", query.LEVELS), ("strategy", query.STRATEGIES), ("style", training.STYLES),
                            ("initial", INITIAL), ("metric", ["bio", "io"])):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}; choose from {known}")

    def examples(self, round_no: int) -> int:
        return self.new_examples[min(round_no, len(self.new_examples) - 1)]


RESULT_SCHEMA = (
    "run string, round int, dataset string, level string, strategy string, style string, initial string, seed int, "
    "starting_ratio double, new_examples int, n_rounds int, n_annotated long, n_non_o long, n_sentences long, "
    "n_tokens long, percentage double, n_training_rows long, n_unmasked long, "
    "distribution array<struct<tag: string, n: long>>, "
    "scores array<struct<split: string, type: string, precision: double, recall: double, f1: double, "
    "number: long, accuracy: double>>, config string"
)


# --- the default model ------------------------------------------------------


def token_features(sentences: DataFrame, *keep: str) -> DataFrame:
    """``(sid, tid, words, *keep)``: a token, its shape and its two neighbours."""
    w = F.col("tokens")
    zipped = F.arrays_zip(
        w.alias("w"), before(w, F.lit("<s>")).alias("l"), after(w, F.lit("</s>")).alias("r"),
        *[F.col(k).alias(k) for k in keep])
    rows = sentences.select("sid", F.posexplode(zipped).alias("tid", "z"))
    word = F.col("z.w")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}+", "X"), r"\p{Ll}+", "x"), r"\p{Nd}+", "9")
    words = F.array(
        F.concat(F.lit("w="), F.lower(word)), F.concat(F.lit("s="), shape),
        F.concat(F.lit("l="), F.lower("z.l")), F.concat(F.lit("r="), F.lower("z.r")),
        F.concat(F.lit("e="), F.right(F.lower(word), F.lit(3))),
    )
    return rows.select("sid", F.col("tid").cast("long").alias("tid"), words.alias("words"), *[F.col(f"z.{k}").alias(k) for k in keep])


def fit_logistic(rows: DataFrame, tags: list[str], config: RunConfig) -> Predict:
    """Multinomial logistic regression over hashed token features."""
    examples = token_features(rows, "ner_tags").where(F.col("ner_tags") != UNKNOWN).select(
        "words", F.col("ner_tags").cast("double").alias("label"))
    model = Pipeline(stages=[
        HashingTF(inputCol="words", outputCol="features", numFeatures=config.features, binary=True),
        LogisticRegression(maxIter=config.iterations, regParam=1e-4, family="multinomial"),
    ]).fit(examples)
    missing = F.array_repeat(F.lit(0.0), len(tags))

    def predict(sentences: DataFrame) -> DataFrame:
        scored = model.transform(token_features(sentences))
        # The model knows the classes up to the largest id it has seen.
        padded = F.slice(F.concat(vector_to_array("probability"), missing), 1, len(tags))
        return scored.select("sid", "tid", padded.alias("scores"))

    return predict


# --- the rounds -------------------------------------------------------------


def choose_initial(
    train: DataFrame, tags: list[str], config: RunConfig, ids: DataFrame | None = None, lm_scores: DataFrame | None = None
) -> DataFrame:
    """The initial ids ``(sid)`` by the configured strategy."""
    if config.proper_nouns_only:
        train = proper_nouns(train)
    n = train.count()
    size = min(n, int(n * config.starting_ratio))
    name = config.initial
    tokens = to_tokens(train, tags)
    view = text_view(train, tags).select("sid", "text")
    how = Vectorizer(config.ngrams, config.stop_words)
    choices: dict[str, Callable[[], DataFrame]] = {
        "random": lambda: initial.random(train, size, config.seed),
        "longest": lambda: initial.longest(view, size),
        "tfidf": lambda: initial.tfidf_top_mean(view, size, config.top_k, how),
        "tfidf_sampled": lambda: initial.tfidf_sampled(view, size, config.top_k, seed=config.seed),
        "kmeans": lambda: vectors.kmeans(view, size, seed=config.seed),
        "dissimilar": lambda: vectors.most_dissimilar(view, size),
        "supervised": lambda: initial.by_type_quota(tokens, size),
        "without_repeats": lambda: greedy.without_repeats(view, size, config.top_k),
        "cover": lambda: greedy.cover(tokens, size, config.seed),
        "static": lambda: initial.static(train, ids),
        "nnp_frequency": lambda: initial.nnp_frequency(tokens, size),
        "nnp_filter": lambda: initial.nnp_filter(train, size, config.alpha, config.seed),
        "lm_breaking_ties": lambda: initial.lm_breaking_ties(lm_scores, size),
    }
    if name not in choices:
        raise ValueError(f"unknown initial strategy {name!r}; choose from {INITIAL}")
    return choices[name]().select("sid")


def proper_nouns(sentences: DataFrame) -> DataFrame:
    """Sentences cut to the tokens whose part of speech contains ``NNP``, in text, tags and parts of speech alike."""
    if "pos_tags_text" not in sentences.columns:
        raise ValueError("choosing proper nouns needs part-of-speech tags (column pos_tags_text)")
    zipped = F.arrays_zip(F.col("tokens").alias("w"), F.col("ner_tags").alias("t"), required_pos().alias("p"))
    kept = sentences.withColumn("_z", F.filter(zipped, lambda z: z["p"].contains("NNP")))
    return kept.withColumns({"tokens": F.col("_z.w"), "ner_tags": F.col("_z.t"), "pos_tags_text": F.col("_z.p")}).drop("_z")


def with_ids(sentences: DataFrame) -> DataFrame:
    """Sentences with ``sid``, numbered within each split by the ids that their corpus has, unless they have one."""
    if "sid" in sentences.columns:
        return sentences
    return dense_ids(sentences, [c for c in ("id", "document_id", "position") if c in sentences.columns])


def evaluate(pred: DataFrame, gold_tokens: DataFrame, tags: list[str], metric: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Span scores of predictions against gold tokens ``(*by, sid, tid, tag)``; a ``sid`` is in one value of ``by``."""
    guessed = pred.select("sid", "tid", decode(S.argmax("scores"), tags).alias("pred"))
    return _span_scores(gold_tokens.select(*by, "sid", "tid", F.col("tag").alias("gold")).join(guessed, ["sid", "tid"]), metric, by)


def _span_scores(pairs: DataFrame, metric: str, by: tuple[str, ...]) -> DataFrame:
    if metric == "bio":
        return metrics.bio_scores(pairs, by)
    if metric == "io":
        return metrics.io_scores(pairs, by).select(
            *by, F.lit("overall").alias("type"), "precision", "recall", "f1",
            F.col("n_gold").cast("long").alias("number"), F.lit(None).cast("double").alias("accuracy"))
    raise ValueError(f"unknown metric {metric!r}")


HELD = ("validation", "val_train", "test")

SPARE = 8
"""So many times the tokens to pick are looked at before the pool is shuffled to leave out what is labelled."""


def evaluate_splits(sentences: DataFrame, predict: Predict, tags: list[str], metric: str) -> DataFrame:
    """Span scores ``(split, type, ...)`` of all held-out splits in one job.

    Ids repeat between splits, so they are made distinct for the model.
    """
    number = F.coalesce(*[F.when(F.col("split") == s, F.lit(i)) for i, s in enumerate(HELD)])
    held = sentences.where(F.col("split").isin(*HELD)).withColumn("sid", F.col("sid") * len(HELD) + number)
    split = F.element_at(F.array(*[F.lit(s) for s in HELD]), (F.pmod("sid", F.lit(len(HELD))) + 1).cast("int"))
    guessed = predict(held).select("sid", "tid", S.argmax("scores").alias("tag_id"))
    return _span_scores(P.pairs_of_sentences(held, guessed, tags).withColumn("split", split), metric, ("split",))


def run(
    spark: SparkSession,
    corpus: Corpus,
    config: RunConfig,
    fit: Fit = fit_logistic,
    ids: DataFrame | None = None,
    lm_scores: DataFrame | None = None,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run all rounds; returns ``(results, labelled)``, the latter ``(sid, tid, tag, round)``.

    A ``sid`` of ``corpus.sentences`` must be unique within each split; without
    one, sentences are numbered by their corpus ids. Draws of later rounds use
    seeds of their own.
    ``results`` has one row per round (``RESULT_SCHEMA``) and is ready to be
    appended to a log.

    The run keeps its sentences, what each round added and its records in the
    folder ``path`` (by default a new one in the shared folder). Where ``path``
    holds a run of the same settings, it goes on from there; only ``rounds`` may
    have grown. What a round stores besides is deleted at its end.
    """
    if config.metric == "bio" and not any(t.startswith("B-") for t in corpus.tags):
        raise ValueError("tags without B- need metric='io'")
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"
    store = RunStore(spark, path)
    store.tidy()
    settings = {k: v for k, v in json.loads(json.dumps(asdict(config), sort_keys=True)).items() if k != "rounds"}
    begun = store.step(BEGUN)
    if begun and (begun["settings"], begun["tags"]) != (settings, corpus.tags):
        raise ValueError(f"{path} holds a run of other settings: {begun['settings']}")
    if not begun:
        with scratch(spark):
            store.keep(BEGUN, with_ids(corpus.sentences), settings=settings, tags=corpus.tags, run=uuid.uuid4().hex)
    sentences, tags = store.data(BEGUN), corpus.tags
    train = sentences.where(F.col("split") == "train")
    gold = to_tokens(train, tags)
    if not store.step(LABELLED_STEP):
        with scratch(spark):
            if not config.full and not store.step(REACHED):
                chosen = cut_lineage(choose_initial(train, tags, config, ids, lm_scores).distinct())
                store.keep(REACHED, train.join(at_most(chosen, chosen.count()), "sid", "left_semi"))
            store.keep(LABELLED_STEP, _typed(to_tokens(train if config.full else store.data(REACHED), tags)))

    expected = None
    for round_no in range(config.rounds):
        last = config.full or round_no + 1 == config.rounds
        scored, added = store.step(SCORED, round_no), store.step(LABELLED_STEP, round_no + 1)
        if scored and (last or added):
            continue
        labelled = store.labelled(round_no if not config.full else 0)
        with scratch(spark):
            known = labelled.drop("round").withColumn("tag_id", encode(F.col("tag"), tags))
            reached = train if config.full else _reached(store, train, round_no)
            rows = cut_lineage(training.materialize(annotate.to_arrays(reached, known), config.style))
            predict = fit(rows, tags, config)
            if not scored:
                store.commit(SCORED, round_no, record=_record(config, round_no, gold, labelled, rows, predict, sentences, tags))
            if not last:
                expected = expected or P.key_sum(gold)
                out = query.query(
                    config.level, config.strategy, predict(train), gold, labelled, config.examples(round_no),
                    config.seed + 1_000_003 * round_no, expected=expected, spare=SPARE * config.examples(round_no))
                store.keep(LABELLED_STEP, _typed(annotate.additions(gold, labelled, out.selections)), round_no + 1)
    return records(spark, store, config.rounds), store.labelled(0 if config.full else config.rounds - 1)


def _reached(store: RunStore, train: DataFrame, up_to: int) -> DataFrame:
    """The sentences that carry labels up to a round, so that rounds don't look through all others for them.

    They are kept as the labels are, one part for each round with the sentences that it reached first.
    """
    for n in range(up_to + 1):
        if store.step(REACHED, n):
            continue
        new = store.added(n).select("sid").distinct()
        if n:
            new = new.join(store.all_data(REACHED, n - 1).select("sid"), "sid", "left_anti")
        new = cut_lineage(new)
        store.keep(REACHED, train.join(at_most(new, new.count()), "sid", "left_semi"), n)
    return store.all_data(REACHED, up_to)


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("sid").cast("long").alias("sid"), F.col("tid").cast("long").alias("tid"), "tag")


def records(spark: SparkSession, store: RunStore, rounds: int) -> DataFrame:
    """The records of the rounds that are done, as ``RESULT_SCHEMA``; also of a run that is still going on."""
    run_id = store.step(BEGUN)["run"] if store.step(BEGUN) else None
    done = [{"run": run_id, **s["record"]} for n in range(rounds) if (s := store.step(SCORED, n))]
    return spark.createDataFrame(done, RESULT_SCHEMA)


def _record(config, round_no, gold, labelled, rows, predict, sentences, tags) -> dict:
    stats = metrics.annotation_stats(gold, labelled).first()
    made = metrics.training_stats(rows).first()
    found = sorted(evaluate_splits(sentences, predict, tags, config.metric).collect(), key=lambda r: (HELD.index(r["split"]), r["type"]))
    scores = [{k: r[k] for k in ("split", "type", "precision", "recall", "f1", "number", "accuracy")} for r in found]
    return {
        "round": round_no, "dataset": config.dataset, "level": config.level, "strategy": config.strategy, "style": config.style,
        "initial": config.initial, "seed": config.seed, "starting_ratio": config.starting_ratio,
        "new_examples": config.examples(round_no), "n_rounds": config.rounds, "n_annotated": stats["n_annotated"],
        "n_non_o": stats["n_non_o"], "n_sentences": stats["n_sentences"], "n_tokens": stats["n_tokens"],
        "percentage": stats["percentage"], "n_training_rows": made["n_rows"], "n_unmasked": made["n_unmasked"],
        "distribution": [{"tag": r["tag"], "n": r["n"]} for r in metrics.tag_distribution(labelled).collect()],
        "scores": scores, "config": json.dumps(asdict(config), sort_keys=True),
    }
