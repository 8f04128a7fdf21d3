"""The dialect over streams: a filter and a projection keep no state, so a query runs on a streaming table unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Engine


def stream_table(engine: Engine, name: str, path: str, like: DataFrame, key_column: str | None = None) -> Engine:
    """Make the Parquet files that arrive in a folder a table; `like` has their schema."""
    return engine.register_df(name, engine.spark.readStream.schema(like.schema).parquet(path), key_column)


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append df's rows to a folder as Parquet, once each, until all that is there has been read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
