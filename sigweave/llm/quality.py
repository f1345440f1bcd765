"""Quality classifier: supervised subword vectors of words, word pairs and character n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.llm.subword import Model, Settings, fit, predictor, sampled
from sigweave.llm.tables import added, text_of

RESULT = ("score", "predicted")
QUALITY = Settings(rows=1_500, grams=(2, 3), lower="no", pairs=True, epochs=8)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", s: Settings = QUALITY) -> Model | None:
    """The model of the labelled rows, ``labels`` (key, label of 0 and 1); None if there are none.

    Null labels are left out, of several labels of a key the largest counts.  The sample, bounded by
    the settings, is sent to the documents, so no text is shuffled.
    """
    once = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("string").alias("label"))
    some = F.broadcast(sampled(once, "label", "key", s))
    return fit(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(some, "key"), s, ["0", "1"])


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows with ``score``, the probability of label 1, and ``predicted``.

    Null and empty texts get what the model says of no feature; without a model all get 0.5.
    Columns of the input named like a result are replaced.
    """
    score = predictor(model, docs)(text_of(text))["p"][1] if model else F.lit(0.5)
    rows = docs.withColumn("__score", score)
    return rows.select(*added(docs, *RESULT), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
