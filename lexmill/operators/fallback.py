"""Labels of documents: rules first, an injected model for those alone that the rules leave unknown."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import classify as C
from ..sources.scratch import written

#: Texts for one call of a scorer, and characters of a text that it sees.
BATCH, SEEN = 32, 2000
Scorer = Callable[[list[str]], list[tuple[str, float]]]


def model_labels(rows: DataFrame, id_col: str, text_col: str, scorer: Scorer, partitions: int = 64) -> DataFrame:
    """(id_col, label, confidence) of every row, by a table function that calls the scorer for BATCH texts of a partition at a time.

    Labels other than the two known ones are unknown.  A scorer that fails leaves its batch unknown with confidence 0.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    @udtf(returnType=f"id {kind}, label string, confidence double")
    class Labels:
        def __init__(self) -> None:
            self.ids, self.texts = [], []

        def eval(self, row) -> Iterator[tuple]:  # noqa: A003, ANN001
            self.ids.append(row["id"])
            self.texts.append(row["seen"])
            if len(self.ids) >= BATCH:
                yield from self.flush()

        def terminate(self) -> Iterator[tuple]:
            yield from self.flush()

        def flush(self) -> Iterator[tuple]:
            ids, texts, self.ids, self.texts = self.ids, self.texts, [], []
            try:
                said = scorer(texts) if ids else []
            except Exception:  # the model's failure isn't the job's
                said = [(C.UNKNOWN, 0.0)] * len(ids)
            for i, (label, confidence) in zip(ids, said, strict=True):
                label = (label or "").upper()
                yield i, label if label in (C.APPEAL, C.RULING) else C.UNKNOWN, float(confidence)

    spark, name = rows.sparkSession, f"lexmill_labels_{uuid.uuid4().hex}"
    spark.udtf.register(name, Labels)
    asked = rows.select(F.col(id_col).alias("id"), F.substring(F.coalesce(text_col, F.lit("")), 1, SEEN).alias("seen")).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(partitions)).cast("int"))
    out = spark.sql(f"SELECT id, label, confidence FROM {name}(TABLE({{asked}}) PARTITION BY part)", asked=asked)
    return out.withColumnRenamed("id", id_col)


def classify_documents(docs: DataFrame, id_col: str, text_col: str, scorer: Scorer, partitions: int = 64) -> DataFrame:
    """(id_col, label, confidence, appeal, ruling, margin, consistency, flags, reasons, asked) of every document; ids are distinct.

    A document whose label the rules know never reaches the model.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ruled = written(docs.select(F.col(id_col), F.substring(text, 1, SEEN).alias("seen"), C.heuristic(text).alias("h"), C.cheap_verifier(text).alias("v")))
    labels = model_labels(ruled.where(F.col("h.label") == C.UNKNOWN), id_col, "seen", scorer, partitions)
    both = ruled.join(labels.select(F.col(id_col).alias("_id"), F.struct("label", "confidence").alias("m")), F.col(id_col) == F.col("_id"), "left")
    judged = both.select(id_col, C.composite_with_model(F.col("h"), F.col("v"), F.col("m")).alias("c"), F.col("m").isNotNull().alias("asked"))
    return judged.select(id_col, "c.label", "c.confidence", "c.appeal", "c.ruling", "c.margin", "c.consistency", "c.flags", C.manual_review(F.col("c")).alias("reasons"), "asked")
