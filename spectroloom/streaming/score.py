"""Row-local operators on streams: each has no state, so a stream is scored like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spectroloom.operators.kmeans import CosineKMeans
from spectroloom.operators.preprocess import SNVScaler


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of Parquet files with the columns of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)


def score_stream(stream: DataFrame, model: CosineKMeans, row_id: str = "row_id", x: str = "x") -> DataFrame:
    """SNV, then the nearest centroid of each row as it arrives."""
    return model.predict(SNVScaler().transform(stream, x, "y"), row_id, "y")


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All rows there are, to Parquet, once."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
