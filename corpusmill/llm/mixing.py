"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Every document of a source is expected ``target / source_size`` times. Documents are laid end to end
by that expectation, one random offset shifts the line, and a document is emitted once for each whole
number it covers. The running position is a prefix sum in three levels - size class within source,
hash cell within class, row within cell - so no window ever holds a whole source. Because the line
runs through size classes in order, the mix takes its share of every document length, which brings
the words taken near the target.

Cases: null text has size 0; a null source is a source of its own, ordered last; sources of size 0
have target 0 and give nothing. Rows of equal id and size are ordered by a hash of their texts, so which of
them is taken does not change between runs; rows equal in all three are alike. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, stored, table, text_of

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows (source, size).

    The weights repeat over the sources in code-point order. A source is held at ``most`` times its
    size when its weighted share would exceed that; the excess goes to the others by weight. Sorted
    by most*size/weight, the sources held are a prefix, so one running sum finds the level at which
    the rest share. All is whole-number arithmetic up to the last division, hence reproducible."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on: the windows below see that small table, never documents.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("k", rank).withColumn("weight", weight.cast("long"))
    order = [(F.lit(most) * F.col("source_size") / F.col("weight")).asc(), F.col("k").asc()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("held_before", F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(everything))
        # level_i = (total - held_before) / weight_left; source i is held if most*size/weight < level_i
        .withColumn(
            "held",
            most * F.col("source_size") * F.col("weight_left") < (F.col("total") - F.col("held_before")) * F.col("weight"),
        )
    )
    first_free = F.min_by(F.struct("held_before", "weight_left"), F.when(~F.col("held"), F.struct((most * F.col("source_size") / F.col("weight")), "k"))).over(everything)
    shared = level.withColumn("at", first_free)
    target = F.when(F.col("held"), (most * F.col("source_size")).cast("double")).otherwise(
        ((F.col("total") - F.col("at.held_before")) * F.col("weight")).cast("double") / F.col("at.weight_left")
    )
    return shared.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """The source's one random offset in [0, 1): 32 bits of a keyed MD5."""
    digest = F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(source, F.lit("\x01null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _classed(rows: DataFrame, id_col: str, size: str, klass: str, cell: str, seed: str) -> DataFrame:
    """Adds the size class (length and leading three bits of the size, so that classes order as sizes
    do) and one of 256 keyed cells: a third of all rows may share a size, and cells split such a class."""
    binary = F.bin(F.col(size))
    key = F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return rows.withColumn(
        klass, F.concat(F.lpad(F.length(binary).cast("string"), 2, "0"), F.substring(binary, 1, 3))
    ).withColumn(cell, F.substring(F.md5(key), 1, 2))


def _starts(sized: DataFrame, weights, most: int) -> DataFrame:
    """For each (source, class, cell): the documents before it in its source, and the source's target."""
    cells = stored(sized.groupBy("source", "class", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")), "cells")
    targets = source_targets(cells, weights, most).withColumnRenamed("source", "t")
    ahead = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n")).select(
        F.col("source").alias("s"),
        F.col("class").alias("c"),
        F.coalesce(F.sum("n").over(ahead("source", by="class")), F.lit(0)).alias("before_class"),
    )
    starts = cells.select(
        "source", "class", "cell", F.coalesce(F.sum("n").over(ahead("source", "class", by="cell")), F.lit(0)).alias("before_cell")
    )
    starts = starts.join(classes, starts["source"].eqNullSafe(classes["s"]) & (starts["class"] == classes["c"]))
    return stored(
        starts.join(targets, starts["source"].eqNullSafe(targets["t"])).select(
            "source", "class", "cell", (F.col("before_class") + F.col("before_cell")).alias("before"), "source_size", "target"
        ),
        "starts",
    )


def _placed(rows: DataFrame, starts: DataFrame, names: tuple[str, ...], most: int, seed: str) -> DataFrame:
    """``rows`` with their copies; names: id, source, size, text hash, class, cell, place, and a prefix for the
    columns of ``starts``. One shuffle of the rows, by cell."""
    id_col, source, size, tie, klass, cell, place, p = names
    starts = starts.toDF(*[f"{p}{c}" for c in starts.columns])
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(source, klass, cell).orderBy(size, id_col, tie)))
    on = rows[source].eqNullSafe(starts[f"{p}source"]) & (rows[klass] == starts[f"{p}class"]) & (rows[cell] == starts[f"{p}cell"])
    joined = rows.join(starts, on)
    step = F.when(F.col(f"{p}source_size") > 0, F.col(f"{p}target") / F.col(f"{p}source_size")).otherwise(F.lit(0.0))
    position = F.col(f"{p}before") + F.col(place)
    offset = offset_of(F.col(source), seed)
    crossed = F.floor(position * step + offset) - F.floor((position - 1) * step + offset)
    return joined.withColumn(f"{p}copies", F.least(crossed, F.lit(most)).cast("long"))


def copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most=MOST_COPIES, seed=SEED) -> DataFrame:
    """One row for each input row: id, source, size, source_size, target and copies."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    sized = stored(_classed(sized, "id", "size", "class", "cell", seed), "sizes")  # the one pass over the texts
    placed = _placed(sized, _starts(sized, weights, most), ("id", "source", "size", "tie", "class", "cell", "place", "p_"), most, seed)
    return placed.select("id", "source", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), F.col("p_copies").alias("copies"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, most=MOST_COPIES, seed=SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, with its own columns."""
    size, tie, klass, cell, place, p = fresh(docs, "mix_size", "mix_tie", "mix_class", "mix_cell", "mix_place", "mix_p_")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"))
    starts = _starts(_classed(sized, "id", "size", "class", "cell", seed), weights, most)
    own = _classed(docs.withColumn(size, word_count(text_of(text_col))).withColumn(tie, F.xxhash64(text_col)), id_col, size, klass, cell, seed)
    placed = _placed(own, starts, (id_col, source_col, size, tie, klass, cell, place, p), most, seed).filter(F.col(f"{p}copies") > 0)
    each = placed.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}copies"))).alias(place))
    return each.select(*docs.columns)


def op8_mix_sources(spark, sf_dir):
    out = copies(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), e AS (
  SELECT *, lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size), 1, 3) AS class,
         substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 2) AS cell
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s
), w AS (
  SELECT *, [5, 2, 1][(k % 3 + 1)::INT]::BIGINT AS weight FROM k
), l AS (
  SELECT *, coalesce(sum(3 * source_size) OVER b, 0)::BIGINT AS held_before,
         (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS weight_left,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM w WINDOW b AS (ORDER BY 3 * source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, 3 * source_size * weight_left < (total - held_before) * weight AS held FROM l
), f AS (
  SELECT held_before AS at_held, weight_left AS at_left FROM h WHERE NOT held
  ORDER BY 3 * source_size / weight, k LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN held THEN (3 * source_size)::DOUBLE
              ELSE ((total - at_held) * weight)::DOUBLE / at_left END AS target
  FROM h LEFT JOIN f ON true
), p AS (
  SELECT e.doc_id, e.size, e.source, t.source_size, t.target,
         row_number() OVER (PARTITION BY e.source ORDER BY class, cell, size, doc_id) AS place
  FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS step,
         ('0x' || substr(md5('mix-1|' || coalesce(source, chr(1) || 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM p
)
SELECT doc_id, size, source_size, target,
       (least(floor(place * step + u) - floor((place - 1) * step + u), 3) * size)::BIGINT AS taken
FROM c
"""
