"""Linear relevance models as tables: fitted with Spark ML, applied by joins; artefacts that may be missing; recorded responses."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.sources.collections import _place


def fit_linear(labelled: DataFrame, label: str = "relevant", words: str = "words", least_texts: int = 2, strength: float = 0.01) -> tuple[DataFrame, float]:
    """`(term, idf, weight)` and the intercept of a logistic model over L2-normalised TF-IDF of `labelled(words array, relevant boolean)`.

    Idf is smooth, terms of fewer than `least_texts` texts are left out, classes weigh alike. Rows without a label or words
    drop out; the vocabulary is that of the labelled texts, so the driver sees as many weights as it has terms.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, Normalizer

    d = labelled.where(F.col(label).isNotNull() & (F.size(words) > 0)).select(F.col(words).alias("w"), F.col(label).cast("double").alias("y"))
    counts = {r.y: r["count"] for r in d.groupBy("y").count().collect()}  # two rows
    if len(counts) < 2:
        raise ValueError("both classes are needed")
    n = sum(counts.values())
    vector = CountVectorizer(inputCol="w", outputCol="tf", minDF=least_texts, vocabSize=1 << 20).fit(d)
    terms = d.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = terms.where(F.col("df") >= least_texts).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    known = {r.term: r.idf for r in idf.collect()}  # the vocabulary
    from pyspark.ml.feature import ElementwiseProduct
    from pyspark.ml.linalg import Vectors

    scaled = ElementwiseProduct(scalingVec=Vectors.dense([known.get(t, 0.0) for t in vector.vocabulary]), inputCol="tf", outputCol="x")
    data = Normalizer(inputCol="x", outputCol="u").transform(scaled.transform(vector.transform(d)))
    weight = F.when(F.col("y") == 1, n / (2 * counts.get(1.0, 1))).otherwise(n / (2 * counts.get(0.0, 1)))
    model = LogisticRegression(featuresCol="u", labelCol="y", weightCol="k", regParam=strength, maxIter=200, tol=1e-9).fit(data.withColumn("k", weight))
    rows = [(t, float(known.get(t, 0.0)), float(w)) for t, w in zip(vector.vocabulary, model.coefficients.toArray(), strict=True)]
    return labelled.sparkSession.createDataFrame(rows, "term string, idf double, weight double"), float(model.intercept)


def optional_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at `path`, or an empty one of that schema where there is none."""
    where, system = _place(spark, path)
    return spark.read.schema(schema).parquet(path) if system.exists(where) else spark.createDataFrame([], schema)


def fingerprint(parameters: Mapping[str, Any]) -> str:
    """Sixteen hexadecimal digits that change with any parameter of a method and with nothing else."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()[:16]


def with_recorded(requests: DataFrame, recorded: DataFrame, parts: list[Column], key: str = "request_hash") -> DataFrame:
    """`requests` with the `response` recorded for the same content, if any; `recorded(request_hash, at, response)`, the latest counts."""
    from strandwise.functions.text import canonical_hash

    last = recorded.groupBy(key).agg(F.max_by("response", "at").alias("response"))
    return requests.withColumn(key, canonical_hash(*parts)).join(last, key, "left")


def rescored(records: DataFrame, scores: DataFrame, method: str, at: Column, key: str = "id") -> DataFrame:
    """`records(id, score, method, log)` with new scores: a changed value or method is stamped and leaves an entry in the log.

    `scores(id, new_score)`; records without a new score stay as they are. Entries are (at, old, new, method).
    """
    j = records.join(scores, key, "left")
    changed = F.col("new_score").isNotNull() & (~F.col("score").eqNullSafe(F.col("new_score")) | ~F.col("method").eqNullSafe(F.lit(method)))
    entry = F.struct(at.alias("at"), F.col("score").alias("old"), F.col("new_score").alias("new"), F.lit(method).alias("method"))
    none = F.array().cast("array<struct<at:timestamp,old:double,new:double,method:string>>")
    log = F.coalesce("log", none)
    return j.withColumns({"log": F.when(changed, F.concat(log, F.array(entry))).otherwise(log), "method": F.when(changed, F.lit(method)).otherwise(F.col("method")), "score": F.when(changed, F.col("new_score")).otherwise(F.col("score"))}).drop("new_score")


def notification(title: Column, lines: Column, longest: int = 4096, secret: str | None = None) -> Column:
    """A message of a title and lines, cut to what a chat takes; a secret in it is blotted out."""
    text = F.concat_ws("\n", title, F.array_join(lines, "\n"))
    text = F.replace(text, F.lit(secret), F.lit("***")) if secret else text
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - 1), F.lit("…"))).otherwise(text)


def placeholder(value: Column, marks: tuple[str, ...] = ("TODO", "TBD", "N/A", "to be reviewed", "to be specified")) -> Column:
    """Whether a field still holds what an importer left there: nothing, a mark at its beginning, or a question mark at its end."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    hit = F.lit(False)
    for m in marks:
        hit = hit | v.startswith(m.lower())
    return (v == "") | hit | v.endswith("?")
