"""A fitted TF-IDF vectorizer: a dictionary of terms in shared storage.

``fit`` counts in how many texts each term is. Texts that come later are weighed
by the dictionary (``transform``), without the ones it was fitted to, or are
added to it (``update``): an update writes the counts of its texts alone, and the
dictionary is the sum of its parts. Each part goes by a name and is committed in
one step, so an update that is repeated, also after it broke, counts once.

Terms travel as 64-bit hashes; the texts' strings stay in the task that read
them, and only the dictionary, a row for each term, holds them. ``fit`` and
``update`` refuse a dictionary in which two terms share a hash.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.skew import join_hot
from gleaner.operators.tfidf import Vectorizer, term_counts, weighted
from gleaner.sources import files

SCHEMA = "id long, term string, df long"


class Dictionary:
    """The dictionary in the folder ``path``; of one that is there already, ``how`` may be left out."""

    def __init__(self, spark: SparkSession, path: str, how: Vectorizer | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        text = files.text_of(spark, f"{self.path}/settings.json")
        if text is None:
            if how is None:
                raise ValueError(f"there is no dictionary in {path}")
            files.put(spark, f"{self.path}/settings.json", json.dumps(asdict(how)))
            text = files.text_of(spark, f"{self.path}/settings.json")
        kept = json.loads(text)
        self.how = Vectorizer(tuple(kept["ngrams"]), kept["stop_words"], kept["norm"])
        if how is not None and how != self.how:
            raise ValueError(f"{path} was made with {self.how}, not {how}")

    def parts(self) -> list[dict]:
        return [json.loads(files.text_of(self.spark, f"{self.path}/parts/{name}")) for name in files.names(self.spark, f"{self.path}/parts")]

    def update(self, texts: DataFrame, name: str) -> bool:
        """Add ``texts(sid, text)``, each text once; False where a part of that name is there already."""
        marker = f"{self.path}/parts/{quote(name, safe='')}.json"
        if files.text_of(self.spark, marker) is not None:
            return False
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        _counted(texts, self.how).write.parquet(folder)
        clash = self._summed(self._data(folder)).where("terms > 1").limit(1).collect()
        if clash:
            files.delete(self.spark, folder)
            raise ValueError(f"two terms share the number {clash[0]['id']}, one of them {clash[0]['term']!r}")
        return files.put(self.spark, marker, json.dumps({"name": name, "n": texts.count(), "folder": folder}))

    def n(self) -> int:
        """Number of texts that were counted."""
        return sum(p["n"] for p in self.parts())

    def table(self) -> DataFrame:
        """``(id, term, df)``, a row for each term."""
        return self._summed(self._data()).select("id", "term", "df")

    def transform(self, texts: DataFrame) -> DataFrame:
        """``texts(sid, text)`` to ``(sid, id, term, w)``; terms that the dictionary doesn't know have no weight."""
        counts = term_counts(texts, self.how, ids=True)
        rows = weighted(join_hot(counts, self.table(), "id"), self.n()).select("sid", "id", "term", "w")
        if self.how.norm is None:
            return rows
        # A row of text bounds its number of terms, so this window is bounded too.
        return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("sid"))))

    def _data(self, *more: str) -> DataFrame:
        folders = [*[p["folder"] for p in self.parts()], *more]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*folders)

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        # Two numbers for one term come together before they are counted, so a frequent term is no hot spot.
        return rows.groupBy("id").agg(
            F.min("term").alias("term"), F.sum("df").alias("df"), F.when(F.min("term") == F.max("term"), 1).otherwise(2).alias("terms"))


def fit(texts: DataFrame, path: str, how: Vectorizer = Vectorizer(), name: str = "fit") -> Dictionary:
    """The dictionary of ``texts(sid, text)``, kept in ``path``."""
    made = Dictionary(texts.sparkSession, path, how)
    made.update(texts, name)
    return made


def _counted(texts: DataFrame, how: Vectorizer) -> DataFrame:
    """``(id, term, df)`` of these texts, combined in the tasks that read them; a number with two terms keeps both."""
    listed = texts.select(F.explode(F.array_distinct(how.terms(F.col("text")))).alias("term"))
    counted = listed.groupBy(F.xxhash64("term").alias("id"), "term").agg(F.count(F.lit(1)).alias("df"))
    return counted.select("id", "term", "df")
