"""What the training-data operators share: text rules, stored intermediates, table readers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, a local session
    gets a folder of its own; on a cluster that would be another folder on each machine, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = f"file://{tempfile.mkdtemp(prefix='corpusmill-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, so a lost
    executor costs no recomputation and several later steps read the same rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch sent to Python, and bytes from which a freed block goes back to the system at once.
BATCH_BYTES, MAPPED = 4 << 20, 4 << 20
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def _give_back(start: bool) -> None:
    """Keeps a worker's memory near what its task uses. The allocator of the C library otherwise raises its limit for
    blocks of their own with every large array and then holds what is freed, for as long as the worker lives.
    Other C libraries have no such calls."""
    libc = ctypes.CDLL(None)
    if start and hasattr(libc, "mallopt"):
        libc.mallopt(_M_MMAP_THRESHOLD, MAPPED)
        libc.mallopt(_M_TRIM_THRESHOLD, MAPPED)
    if not start:
        pa.default_memory_pool().release_unused()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` with bounded memory: batches of about BATCH_BYTES on both sides unless the
    session asks for smaller ones, and workers that hand back what a task has freed."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = rows.sparkSession.conf
    number, unit = re.match(r"(\d+)([kmgtp]?)", conf.get(name).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back(True)
        try:
            yield from run(batches)
        finally:
            _give_back(False)

    return rows.mapInArrow(lean, schema)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it often and inside inner
    lambdas while it is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``, whatever columns it brings."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, text_column: int, most_bytes: int = 1 << 20, most_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most_bytes`` of the column's text, one row at least: what Python holds beside
    a batch does not depend on the batch's size."""
    column = batch.column(text_column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def frequent(counts: DataFrame, most: int, order: str = "n") -> DataFrame:
    """The rows of ``counts`` whose ``n`` reaches a threshold that at most ``most`` rows reach: chosen from a
    histogram of the values, exact up to 64 and in steps of a 32nd above, so that no task sends its rows to the driver. Words
    of equal count come together or not at all."""
    cell = F.when(F.col(order) <= 64, F.col(order)).otherwise(F.floor(F.log2(F.col(order)) * 32) - 128).cast("long")
    cells = sorted(((r.c, r.k) for r in counts.groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    at, total = None, 0
    for c, k in cells:
        total += k
        if total > most:
            break
        at = c
    return counts.filter(F.lit(False)) if at is None else counts.filter(cell >= at)


#: Size limits, as powers of two, of a bitmap of keys that is broadcast: 8 KB to 64 MB.
LEAST_BITS, MOST_BITS = 16, 29


def key_bitmap(keys: DataFrame, column: Column, n: int) -> np.ndarray:
    """A bitmap with the bits of all hashes ``column`` (long) set. It has sixteen bits a key, 2**MOST_BITS bits
    at most, beyond which it lets more through that is not wanted but still misses nothing."""
    bits = max(LEAST_BITS, min(MOST_BITS, (16 * n).bit_length()))
    place = column.bitwiseAND((1 << bits) - 1) + 1
    parts = keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        found = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.part - 1) * 4096 : r.part * 4096] = found[: len(out) - (r.part - 1) * 4096]
    return out


def bitmap_table(keys: DataFrame, column: Column, n: int) -> tuple[DataFrame, int]:
    """The same as a table (part, bits), of the same bound, for :func:`maybe_among`, and its size as a power of two."""
    bits = max(LEAST_BITS, min(MOST_BITS, (16 * n).bit_length()))
    place = column.bitwiseAND((1 << bits) - 1) + 1
    parts = keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    return stored(parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")), "bitmap"), bits


def maybe_among(rows: DataFrame, column: Column, table: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false only if the hash ``column`` (long) is not among the keys."""
    part, held = fresh(rows, "bitmap_part", "bitmap_bits")
    place = column.bitwiseAND((1 << bits) - 1) + 1
    known = F.broadcast(table.select(F.col("part").alias(part), F.col("bits").alias(held)))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    joined = rows.join(known, F.bitmap_bucket_number(place) == F.col(part), "left")
    return joined.select(*rows.columns, F.coalesce(bit, F.lit(False)).alias(name))
