"""Embedding of texts by an injected provider, with retries and resumption."""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import EmbedConfig
from ..functions.vectors import l2_normalize

#: Called once a partition; gives the function from a list of texts to a list of vectors.
Provider = Callable[[], Callable[[list[str]], list]]


def count_provider(dim: int) -> Provider:
    """A local embedder without a service: counts of code points modulo ``dim``."""

    def start():
        return lambda texts: [np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % dim, minlength=dim).astype(float) for t in texts]

    return start


def hash_provider(dim: int) -> Provider:
    """A deterministic local embedder: signed hashes of character pairs. No service is needed."""

    def start():
        def embed(texts: list[str]) -> list[np.ndarray]:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for a, b in zip(t, t[1:], strict=False):
                    h = zlib.crc32((a + b).encode("utf-8", "surrogatepass"))
                    v[h % dim] += 1.0 if h & 0x80000000 else -1.0
                out.append(v)
            return out

        return embed

    return start


def http_provider(url: str, config: EmbedConfig = EmbedConfig()) -> Provider:
    """Posts {"model", "input"} to an embedding service; the answer holds "embeddings"."""

    def start():
        from urllib.request import Request, urlopen

        def embed(texts: list[str]) -> list:
            body = json.dumps({"model": config.model, "input": texts}).encode()
            with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=config.timeout_s) as answer:
                return json.load(answer)["embeddings"]

        return embed

    return start


def with_retries(embed, texts: list[str], config: EmbedConfig, sleep=time.sleep) -> list:
    """One vector of the right width for each text, or an error: no row is ever skipped."""
    for attempt in range(config.retries + 1):
        try:
            vectors = list(embed(texts))
            if len(vectors) != len(texts) or any(len(v) != config.dim for v in vectors):
                raise ValueError("the provider's answer has another number or width of vectors")
            return vectors
        except Exception as error:
            if attempt == config.retries:
                raise RuntimeError(f"embedding failed after {attempt + 1} attempts") from error
            sleep(config.sleep_s * 2**attempt)
    raise AssertionError


def embed_chunks(chunks: DataFrame, provider: Provider, config: EmbedConfig = EmbedConfig(), id_col="chunk_id", text_col="text") -> DataFrame:
    """chunk_id and unit-length embedding, in batches of ``config.batch`` texts."""
    id_type = chunks.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = provider()
        for batch in batches:
            for start in range(0, batch.num_rows, config.batch):
                part = batch.slice(start, config.batch)
                vectors = with_retries(embed, [t or "" for t in part.column(1).to_pylist()], config)
                column = pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=[id_col, "embedding"])

    raw = chunks.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, embedding array<float>")
    return raw.select(id_col, l2_normalize(raw["embedding"], config.norm_floor).alias("embedding"))


def fingerprint(config: EmbedConfig) -> str:
    """What must agree for written vectors to be reused."""
    return json.dumps({"model": config.model, "dim": config.dim, "batch": config.batch}, sort_keys=True)


def missing(chunks: DataFrame, written: DataFrame, id_col="chunk_id") -> DataFrame:
    """Chunks without a written vector: resumption is an anti-join on keys, not a row count."""
    return chunks.join(written.select(id_col), id_col, "left_anti")


def resume_embedding(chunks: DataFrame, path: str, provider: Provider, config: EmbedConfig = EmbedConfig(), id_col="chunk_id") -> DataFrame:
    """Appends the missing vectors to the table below ``path`` and returns the table. Vectors of another
    model or width are in another folder, named by the fingerprint, so they are never mixed."""
    spark = chunks.sparkSession
    folder = f"{path.rstrip('/')}/{zlib.crc32(fingerprint(config).encode()):08x}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    todo = missing(chunks, spark.read.parquet(folder), id_col) if exists else chunks
    embed_chunks(todo, provider, config, id_col).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
