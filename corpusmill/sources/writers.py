"""Writers: JSON lines, ordered merges, the index table."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, characters unescaped, line feeds alone; all files or none."""
    rows.write.mode(mode).option("lineSep", "\n").option("ignoreNullFields", "false").json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """More files beside those that are there; a reader of the folder sees all rows."""
    write_jsonl(rows, path, "append")


def merge_shards(spark: SparkSession, paths: list[str], out: str, single_file: bool = False) -> int:
    """The non-empty lines of the shards, files in order of name and lines in order of place, below ``out``;
    their number. Missing shards and ``out`` itself are left out; nothing usable is an error before anything
    is written. Order is kept by a range sort; one file is made for export only."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    usable = []
    for p in sorted(set(paths) - {out}):
        at = hadoop.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            usable.append(p)
    if not usable:
        raise FileNotFoundError("no shard to merge")
    lines = spark.read.text(usable).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = lines.filter("value != ''").orderBy("f", "b", "i").select("value")
    (lines.coalesce(1) if single_file else lines).write.text(out)
    return spark.read.text(out).count()


def build_index(vectors: DataFrame, metadata: DataFrame, path: str, id_col: str = "chunk_id") -> None:
    """The index is a table: vectors beside the metadata of the same key. A vector without metadata is an error."""
    described = vectors.join(metadata.select(id_col, "title", "text", F.lit(True).alias("_known")), id_col, "left")
    text = F.when(F.col("_known"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no metadata for "), F.col(id_col).cast("string"))))
    described.withColumn("text", text).drop("_known").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_shard(rows: DataFrame, path: str, shard: str = "shard") -> None:
    """JSON lines in a folder for each shard; folders of other shards stay."""
    rows.write.mode("append").partitionBy(shard).option("ignoreNullFields", "false").json(path)


def written_shards(spark: SparkSession, path: str, shard: str = "shard") -> list[str]:
    """Names of the shards below ``path``, from folder names alone."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    names = (s.getPath().getName() for s in files.listStatus(at))
    return sorted(unquote(n.partition("=")[2]) for n in names if n.startswith(f"{shard}="))


def unwritten(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Rows whose key is not in the table at ``path`` yet; all of them if there is no table."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return rows
    return rows.join(spark.read.parquet(path).select(key), key, "left_anti")
