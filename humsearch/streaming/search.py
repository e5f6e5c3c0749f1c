"""A folder of incoming recordings, searched as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..plans.search import query_bins, search_many

AUDIO_SCHEMA = "audio_id long, sr int, samples array<double>"


def search_stream(spark: SparkSession, incoming: str, bins: DataFrame, catalogue: DataFrame, out: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Match each recording of Parquet files (audio_id, sr, samples) that arrive in
    ``incoming`` against a fixed catalogue and append the results to ``out``. A batch's
    recordings are searched together; one that is repeated after a failure
    overwrites its own folder."""
    def each(batch: DataFrame, number: int) -> None:
        found = search_many(query_bins(batch, config), bins, catalogue, config)
        found.withColumnRenamed("query_id", "audio_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(AUDIO_SCHEMA).option("maxFilesPerTrigger", 16).parquet(incoming)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
