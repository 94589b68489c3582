"""Readers: JSON lines, shard folders, dumps, whole files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = "id string, url string, title string, text string"
CHUNK = "chunk_id string, doc_id string, title string, chunk_index int, text string"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = ARTICLE) -> DataFrame:
    """Strict: blank lines are skipped, a broken line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("allowSingleQuotes", "false").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str = ARTICLE, **options: str) -> DataFrame:
    """Broken lines are kept in ``_corrupt`` and the others' columns read; ``_file`` names the shard."""
    reader = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    return reader.option("allowSingleQuotes", "false").options(**options).json(path).withColumn("_file", F.col("_metadata.file_path"))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and error of lines that are not JSON objects: the slow path, for reports. Numbers
    need a file's lines in order, so each file is one task."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for n, raw in enumerate(bytes(content).split(b"\n"), 1):
                    if raw.strip():
                        try:
                            if not isinstance(json.loads(raw), dict):
                                rows.append((file, n, "not an object"))
                        except ValueError as error:
                            rows.append((file, n, str(error)))
            yield pd.DataFrame(rows, columns=["file", "line", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, line long, error string")


def iter_jsonl(path: str | Path) -> Iterator[dict]:
    """Driver-side, for small local files: rows up to the first broken line, then an error that names it."""
    with open(path, encoding="utf-8") as lines:
        for n, line in enumerate(lines, 1):
            if line.strip():
                try:
                    yield json.loads(line)
                except ValueError as error:
                    raise ValueError(f"{path}, line {n}: {error}") from error


def read_shards(spark: SparkSession, folder: str, pattern: str = "wiki_*", schema: str = ARTICLE) -> DataFrame:
    """All extractor shards below a folder, tolerantly, with ``_file``."""
    return read_jsonl_tolerant(spark, folder, schema, recursiveFileLookup="true", pathGlobFilter=pattern)


def in_file_order(rows: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``rows`` of a file reader with the columns that put them in the order of files and of lines in them."""
    marked = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"))
    return marked.withColumn("_i", F.monotonically_increasing_id()), ("_f", "_b", "_i")


def shard_names(shards: DataFrame, folder: str) -> DataFrame:
    """file and output name of each shard, sorted: its stem, or its path with ``/`` as ``_`` where stems
    repeat anywhere. No shards at all is an error."""
    files = shards.select("_file").distinct()
    relative = F.regexp_replace(F.regexp_replace("_file", "^[a-z]+:/*", "/"), f"^{re.escape('/' + folder.split('://')[-1].strip('/'))}/", "")
    named = files.select("_file", relative.alias("rel"), F.regexp_replace(F.element_at(F.split(relative, "/"), -1), r"\.[^.]*$", "").alias("stem"))
    counts = named.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stem").alias("d")).first()
    if not counts.n:
        raise FileNotFoundError(f"no shards below {folder}")
    name = F.col("stem") if counts.n == counts.d else F.replace("rel", F.lit("/"), F.lit("_"))
    return named.select("_file", F.concat(name, F.lit(".jsonl")).alias("out_name")).orderBy("_file")


def read_dump(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """Pages of an XML dump as articles: id, url (null), title, text of the revision."""
    text = T.StructType([T.StructField("_VALUE", T.StringType())])
    schema = T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("revision", T.StructType([T.StructField("text", text)])),
    ])
    pages = spark.read.format("xml").option("rowTag", row_tag).option("valueTag", "_VALUE").schema(schema).load(path)
    return pages.select("id", F.lit(None).cast("string").alias("url"), "title", F.col("revision.text._VALUE").alias("text"))


def count_rows(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and lower-case md5, sha1, sha256 of whole files. Files are loaded whole: for very large
    ones use :func:`hash_file`."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.md5("content").alias("md5"), F.sha1("content").alias("sha1"), F.sha2("content", 256).alias("sha256"))


def hash_file(path: str | Path, algorithm: str = "sha1") -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, algorithm).hexdigest()


def verify_file(path: str | Path, expected: str) -> bool:
    """Whether the file has the digest, whatever its case; its length tells md5, sha1 and sha256 apart."""
    algorithm = {32: "md5", 40: "sha1", 64: "sha256"}.get(len(expected.strip()))
    if algorithm is None:
        raise ValueError("expected an md5, sha1 or sha256 digest")
    return hash_file(path, algorithm) == expected.strip().lower()


def download(url: str, path: str | Path, block: int = 8192, timeout: float = 30.0) -> Path:
    """Fetch to ``path`` by way of ``path.part``. A part is continued with a range request; a server that
    sends the whole starts it anew, and one that has nothing more to send means it was complete."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    path = Path(path)
    part = path.with_name(path.name + ".part")
    path.parent.mkdir(parents=True, exist_ok=True)
    have = part.stat().st_size if part.exists() else 0
    try:
        with urlopen(Request(url, headers={"Range": f"bytes={have}-"} if have else {}), timeout=timeout) as answer:
            with part.open("ab" if have and answer.status == 206 else "wb") as out:
                while data := answer.read(block):
                    out.write(data)
    except HTTPError as error:
        if error.code != 416 or not have:
            raise
    return part.replace(path)
