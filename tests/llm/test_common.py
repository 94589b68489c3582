"""The Arrow wrapper: bounded batches, the session's own smaller bound, empty tables."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm.common import BATCH_BYTES, in_arrow

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])


@pytest.mark.parametrize(("given", "bound"), [("64m", BATCH_BYTES), ("1m", 1 << 20), (str(BATCH_BYTES * 2), BATCH_BYTES)])
def test_batches_are_bounded_and_whole(spark, given, bound):
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, given)
        rows = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 2500).alias("t"))
        found = in_arrow(rows, sizes, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 4000
        assert max(r.bytes for r in found) < bound + (1 << 16)
    finally:
        spark.conf.set(NAME, before)


def test_empty_table(spark):
    assert in_arrow(spark.range(0), sizes, "n long, bytes long").agg(F.sum("n")).first()[0] in (None, 0)
