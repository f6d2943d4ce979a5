"""Classes of companies and texts from codes and words."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, NGram, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_labels(df: DataFrame, label: str, least: int = 100) -> DataFrame:
    """Rows whose label has more than ``least`` rows."""
    return df.join(df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") > least).select(label), label, "left_semi")


def code_pipeline(kind: str, codes: str, label: str, tfidf: bool = True) -> Pipeline:
    """Counts (or tf-idf) of codes with naive Bayes (``nb``), a random forest (``rf``) or support vector machines (``svc``)."""
    stages = [StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip"), CountVectorizer(inputCol=codes, outputCol="tf")]
    if tfidf:
        stages.append(IDF(inputCol="tf", outputCol="x"))
    x = "x" if tfidf else "tf"
    model = {
        "nb": lambda: NaiveBayes(featuresCol=x, labelCol="y"), "rf": lambda: RandomForestClassifier(featuresCol=x, labelCol="y", numTrees=20, seed=5),
        "svc": lambda: OneVsRest(classifier=LinearSVC(maxIter=10), featuresCol=x, labelCol="y"),
    }[kind]()
    return Pipeline(stages=[*stages, model])


def text_pipeline(words: str, label: str, least: float = 2, most: float = 0.9) -> Pipeline:
    """Words and pairs of words with bounds on document frequency, tf-idf side by side, naive Bayes."""
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="y", handleInvalid="skip"), Tokenizer(inputCol=words, outputCol="w"), NGram(n=2, inputCol="w", outputCol="w2"),
        CountVectorizer(inputCol="w", outputCol="t1", minDF=least, maxDF=most), CountVectorizer(inputCol="w2", outputCol="t2", minDF=least, maxDF=most),
        IDF(inputCol="t1", outputCol="i1"), IDF(inputCol="t2", outputCol="i2"), VectorAssembler(inputCols=["i1", "i2"], outputCol="x"), NaiveBayes(featuresCol="x", labelCol="y"),
    ])


def accuracy(pipeline: Pipeline, df: DataFrame, seed: int = 9) -> float:
    train, test = df.randomSplit([0.8, 0.2], seed)
    return MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy").evaluate(pipeline.fit(train).transform(test))


def cross_validated(pipeline: Pipeline, df: DataFrame, folds: int = 10) -> float:
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy"), numFolds=folds, seed=9)
    return cv.fit(df).avgMetrics[0]
