"""Text -> vector hooks.

The reference encodes text and images with pretrained networks.  Those
networks are not part of this engine; two hooks stand in for them:

* ``hashing_embedding``: a JVM-side bag-of-words vector (``HashingTF`` then
  L2 ``Normalizer``) -- the default, no model files needed;
* ``model_embedding``: any batch model through ``predict_batch_udf``; the
  model is built once per executor process by ``make_predict_fn`` and fed
  Arrow batches.
"""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from convoscope.functions.text import tokens


def hashing_embedding(df: DataFrame, text: str = "text", dim: int = 64, out: str = "embedding") -> DataFrame:
    t = df.withColumn("__tok", tokens(text))
    tf = HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=dim).transform(t)
    nz = Normalizer(inputCol="__tf", outputCol="__nz", p=2.0).transform(tf)
    return nz.withColumn(out, vector_to_array("__nz", "float32")).drop("__tok", "__tf", "__nz")


def model_embedding(df: DataFrame, make_predict_fn, dim: int, text: str = "text", out: str = "embedding", batch_size: int = 256) -> DataFrame:
    """``make_predict_fn()`` returns ``f(np.ndarray[str]) -> np.ndarray[n, dim]``."""
    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=None)
    return df.withColumn(out, encode(F.coalesce(F.col(text), F.lit(""))))
