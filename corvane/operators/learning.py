"""Classical text models over pyspark.ml, and seams for encoders and scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def features(text: str, min_df: float = 2.0, max_df: float = float(1 << 62), ngrams: int = 1, stop_words: bool = False, tfidf: bool = True, size: int = 1 << 16) -> Pipeline:
    """Tokens, n-grams, counts of terms in enough and not too many documents, and inverse frequencies.

    min_df and max_df: documents from 1 on, or shares below 1.
    """
    stages = [RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[\p{L}\p{N}]+", gaps=False)]
    last = "_tokens"
    if stop_words:
        stages.append(StopWordsRemover(inputCol=last, outputCol="_kept"))
        last = "_kept"
    if ngrams > 1:
        stages.append(NGram(n=ngrams, inputCol=last, outputCol="_grams"))
        last = "_grams"
    stages.append(CountVectorizer(inputCol=last, outputCol="_counts" if tfidf else "features", minDF=min_df, maxDF=max_df, vocabSize=size))
    if tfidf:
        stages.append(IDF(inputCol="_counts", outputCol="features"))
    return Pipeline(stages=stages)


def classifier(df: DataFrame, text: str, label: str, kind: str = "logistic", **options: object) -> PipelineModel:
    model = {"logistic": LogisticRegression, "bayes": NaiveBayes, "svm": LinearSVC}[kind](labelCol=label, featuresCol="features")
    return Pipeline(stages=[*features(text, **options).getStages(), model]).fit(df)


def area_under_curve(predicted: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction").evaluate(predicted)


def topics(df: DataFrame, text: str, k: int, seed: int = 0, iterations: int = 20, **options: object) -> PipelineModel:
    """Latent topics; transform adds topicDistribution."""
    return Pipeline(stages=[*features(text, tfidf=False, **options).getStages(), LDA(k=k, seed=seed, maxIter=iterations, featuresCol="features")]).fit(df)


def encoder(make: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A Column function of a text encoder that each worker makes once."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for part in parts:
            yield pd.Series(list(np.asarray(run(part.fillna("").tolist()), np.float32)), dtype="object").map(lambda v: v.tolist())

    return encode


def hashing_encoder(dimensions: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A deterministic stand-in for a sentence encoder: signed hashed words, unit length."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import zlib

        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimensions))
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    h = zlib.crc32(word.encode())
                    out[i, h % dimensions] += 1 if h >> 31 else -1
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return run

    return make


def overlap_scorer(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a reranker: the share of the query's tokens in the text."""
    from corvane.functions.text import tokens

    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q))
