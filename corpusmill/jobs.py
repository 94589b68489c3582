"""Command line: ``python -m corpusmill.jobs clean|chunk IN OUT [--subset [N]] [--force]``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chunk, clean
from .session import session
from .sources.readers import in_file_order, read_jsonl, read_shards, shard_names
from .sources.writers import write_by_shard, write_jsonl, written_shards


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill")
    p.add_argument("step", choices=("clean", "chunk"))
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--force", action="store_true", help="overwrite")
    p.add_argument("--subset", nargs="?", const="100000", help="only the first N documents; 100000 if N is no number")
    return p


def subset_size(value: str | None) -> int | None:
    return None if value is None else int(value) if value.isdigit() else 100_000


def clean_shards(spark: SparkSession, source: str, out: str, force: bool = False, pattern: str = "wiki_*") -> DataFrame:
    """Cleans every shard below ``source`` into a folder of its own below ``out``/articles and returns counts by
    shard, with its alarm, of all shards; they are kept below ``out``/stats. Shards that have counts already are skipped unless
    ``force``. No shards at all is an error, and so is nothing else: shards without a readable line show in the counts."""
    shards = read_shards(spark, source, pattern)
    names = shard_names(shards, source).select(F.col("_file").alias("_s"), F.regexp_replace("out_name", r"\.jsonl$", "").alias("shard"))
    done = [] if force else written_shards(spark, f"{out}/stats")
    named = shards.join(names, F.col("_file") == F.col("_s")).drop("_s")
    if done:
        named = named.join(spark.createDataFrame([(d,) for d in done], "shard string"), "shard", "left_anti")
    cleaned = clean.clean_articles(named)
    kept = cleaned.filter("_corrupt IS NULL AND drop_reason IS NULL")
    if force:
        for part in ("articles", "stats"):
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{part}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    write_by_shard(clean.kept_articles(kept, keep=("shard",)), f"{out}/articles")
    # Counts come last: only what was written whole is skipped the next time.
    write_by_shard(clean.clean_stats(cleaned, "shard", bad=F.col("_corrupt").isNotNull()), f"{out}/stats")
    stats = spark.read.schema("total long, kept long, dropped long, badlines long, drop_rate double, shard string").json(f"{out}/stats")
    return clean.drop_alarm(stats)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session()
    if args.step == "clean":
        stats = clean_shards(spark, args.source, args.out, args.force)
        totals = stats.agg(*[F.sum(c).alias(c) for c in ("total", "kept", "dropped", "badlines")]).first().asDict()
        print(totals | {"alarms": stats.filter("alarm").count(), "unreadable": [r.shard for r in clean.failed_shards(stats, "shard").collect()]})
        return
    docs = read_jsonl(spark, args.source, "id string, title string, text string")
    n = subset_size(args.subset)
    if n is not None:
        marked, order = in_file_order(docs)
        docs = chunk.subset(marked, n, *order).drop(*order)
    write_jsonl(chunk.chunk_documents(docs).drop("overlap_len", "body_len"), args.out, "overwrite" if args.force else "ignore")


if __name__ == "__main__":
    main()
