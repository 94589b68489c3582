"""The same operators over a stream of files. Cleaning and chunking keep no state between rows, so the only
thing to resume is which files were read, and the checkpoint holds that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import ChunkConfig, CleanConfig
from ..operators.chunk import chunk_documents
from ..operators.clean import clean_articles, kept_articles
from ..sources.readers import ARTICLE


def article_stream(spark: SparkSession, folder: str, schema: str = ARTICLE, files_per_batch: int = 1000, fmt: str = "json") -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return reader.format(fmt).load(folder)


def clean_stream(articles: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    return kept_articles(clean_articles(articles, config))


def chunk_stream(articles: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    return chunk_documents(articles, config=config)


def run_available(rows: DataFrame, out: str, checkpoint: str, timeout_s: int | None = None) -> bool:
    """Write what is there now and stop; a later call goes on where this one ended. False on timeout."""
    query = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    ended = query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination() is None
    if not ended:
        query.stop()
    return ended
