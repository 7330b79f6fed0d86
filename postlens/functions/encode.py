"""Text encoders: columns of text to unit vectors. Any ``DataFrame -> DataFrame`` that adds
an ``embedding`` array can take this one's place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import padded_tokens


def hashing_encoder(df: DataFrame, text: Column, dim: int = 384) -> DataFrame:
    """Hashed TF-IDF vectors of unit length (a zero vector stays zero)."""
    words = df.withColumn("_words", F.split(F.trim(padded_tokens(text)), " "))
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit"),
    ]
    fitted = Pipeline(stages=stages).fit(words)
    return (
        fitted.transform(words)
        .withColumn("embedding", vector_to_array("_unit", "float32"))
        .drop("_words", "_tf", "_idf", "_unit")
    )


def model_encoder(make_predict: Callable, text: Column, dim: int, batch_size: int = 256):
    """Encoder over a user's model: ``make_predict`` loads it once per Python worker."""
    encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return lambda df: df.withColumn("embedding", encode(text))
