"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after each run of white space became one space. Only
(digest, id) pairs are moved. Misra-Gries sketches of every partition name the digests that may be
frequent; their winners are then computed exactly and broadcast, so the rows of large groups of
copies are settled where they lie. All other digests go through an ordinary shuffle, in which, by
the sketch's guarantee, no group holds more than about 2/``counters`` of the rows.

Cases: null text counts as empty, and all empty texts are one group. A null id sorts before every
other id. Of rows with equal id and equal text exactly one is kept. An empty table gives an empty
result. Extra input columns are ignored by :func:`exact_groups` and kept by :func:`exact_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, bitmap_table, fresh, in_arrow, maybe_among, stored, table, text_of

COUNTERS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, " ")


def misra_gries(digests: Iterator[bytes], counters: int) -> dict[bytes, int]:
    """Every digest that fills more than 1/(counters+1) of the stream is among the result; counts
    fall short of the true ones by at most that share."""
    held: dict[bytes, int] = {}
    for d in digests:
        if d in held:
            held[d] += 1
        elif len(held) < counters:
            held[d] = 1
        else:
            held = {k: v - 1 for k, v in held.items() if v > 1}
    return held


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates (at most ``counters`` rows): the digests with the largest summed sketch counts.

    Each digest above 2/counters of all rows has a summed count above 1/counters, and sketch counts
    never add up to more than the rows, so fewer than ``counters`` digests can stand before it."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((d for b in batches for d in b.column(0).to_pylist()), counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())}
        )

    partial = in_arrow(rows.select("digest"), sketch, "digest binary, n long")
    summed = partial.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    return summed.orderBy(F.desc("n"), "digest").limit(counters).select("digest")


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(F.encode(normalised(text_of(text_col)), "UTF-8"), 256))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (unique), id, digest. Stored: everything after it reads some 50 bytes a document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), digest_of(text_col).alias("digest"))
    return stored(rows, "digests")


def hot_winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, first (smallest id, row) and group_size of the frequent digests, computed exactly from
    all rows; at most ``counters`` rows, marked for broadcast."""
    candidates = stored(frequent_digests(rows, counters), "candidates")
    exact = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest")
    # Sorting by (id, row) gives ties a winner; nulls come first in structs as in orderings.
    winners = exact.agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return F.broadcast(stored(winners, "winners"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row for each input row: ``row`` (unique), ``id``, ``digest`` (SHA-256 of the normalised
    text), ``keep_id``, ``group_size`` and ``kept``."""
    rows = _digests(docs, id_col, text_col)
    winners = hot_winners(rows, counters)
    hot = rows.join(winners, "digest")
    rest = rows.join(winners, "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return hot.unionByName(rest.join(groups, "digest")).select(
        "row",
        "id",
        "digest",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("first.row") == F.col("row")).alias("kept"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the later copies, with its own columns. Texts without a copy, by a bitmap of the digests that have
    some, stay where they are, and the losers of frequent digests are dropped map-side; only the other texts are
    shuffled, once, by digest."""
    digest, turn, keep, flag = fresh(docs, "dedup_digest", "dedup_turn", "dedup_keep", "dedup_flag")
    rows = _digests(docs, id_col, text_col)
    winners = hot_winners(rows, counters)
    rest = rows.join(winners, "digest", "left_anti").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = stored(winners.select("digest").unionByName(rest.select("digest")), "several")
    bits, size = bitmap_table(several, F.xxhash64("digest"), several.count())
    winners = F.broadcast(winners.select(F.col("digest").alias(digest), F.col("first.id").alias(keep)))
    own = maybe_among(docs.withColumn(digest, digest_of(text_col)), F.xxhash64(digest), bits, size, flag)
    met = own.filter(flag)
    hot = met.join(winners, digest).filter(F.col(id_col).eqNullSafe(F.col(keep))).drop(keep)
    cold = met.join(winners, digest, "left_anti")
    first = Window.partitionBy(digest).orderBy(id_col)
    left = hot.unionByName(cold).withColumn(turn, F.row_number().over(first)).filter(F.col(turn) == 1)
    return own.filter(~F.col(flag)).select(*docs.columns).unionByName(left.select(*docs.columns))


def op6_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept,
       text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
