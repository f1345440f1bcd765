"""Language identification with averaged subword vectors and calibrated rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.subword import Model, Settings, fit, predictor, sampled
from sigweave.llm.tables import added, text_of

UNKNOWN = "und"
RESULT = ("lang_pred", "score", "rejected")
LANGUAGES = Settings(rows=800, grams=(2, 3), epochs=5)


def learn(docs: DataFrame, learns: Column, key: str = "doc_id", lang: str = "lang", text: str = "text", s: Settings = LANGUAGES) -> Model | None:
    """The model of the rows where ``learns`` holds and ``lang`` is not null; None if there are none."""
    rows = docs.filter(learns & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("label"), F.col(text).alias("text"))
    return fit(sampled(rows, "label", "key", s), s)


def predicted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All rows with ``lang_pred``, ``score`` and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text without a
    model.  ``rejected`` marks scores below what 99 % of kept-back training rows reach: likely
    another or a mixed language.  Columns of the input named like a result are replaced.
    """
    rows = docs.withColumn("__lettered", text_of(text).rlike(r"\p{L}"))
    if model is None:
        rows = rows.withColumn("__said", F.lit(None).cast("struct<best:string,p:array<double>>"))
    else:
        rows = rows.withColumn("__said", predictor(model, docs)(text_of(text)))
    known = F.col("__lettered") & F.col("__said").isNotNull()
    score = F.when(known, F.array_max("__said.p")).otherwise(0.0)
    return rows.select(
        *added(docs, *RESULT), F.when(known, F.col("__said.best")).otherwise(UNKNOWN).alias("lang_pred"), score.alias("score"),
        (~known | (score < (model.threshold if model else 1.0))).alias("rejected"),
    )
