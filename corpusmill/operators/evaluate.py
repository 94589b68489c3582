"""Evaluation of retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EVAL_SET_SIZE, HIT_AT, WORST


def first_hits(queries: DataFrame, hits: DataFrame, target="target_title", found="title", query_id="query_id") -> DataFrame:
    """Every query with the rank of its first right hit, null without one."""
    right = hits.join(queries.select(query_id, target), query_id).filter(F.col(found) == F.col(target))
    first = right.groupBy(query_id).agg(F.min("rank").alias("first_rank"))
    return queries.join(first, query_id, "left")


def metrics(ranked: DataFrame, at=HIT_AT, by: tuple[str, ...] = ()) -> DataFrame:
    """n, hit@k for each k and MRR over rows of :func:`first_hits`."""
    hit = [F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in at]
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *hit, F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"))


def worst_cases(ranked: DataFrame, n: int = WORST, query_id="query_id") -> DataFrame:
    """Misses first, then the latest first hits."""
    return ranked.orderBy(F.desc_nulls_first("first_rank"), query_id).limit(n)


def ab_table(variants: dict[str, DataFrame], at=HIT_AT) -> DataFrame:
    """One row of metrics for each named variant."""
    named = [df.select(F.lit(name).alias("variant"), "first_rank") for name, df in sorted(variants.items())]
    return metrics(reduce(DataFrame.unionByName, named), at, ("variant",))


def eval_sample(articles: DataFrame, n: int = EVAL_SET_SIZE, seed: int = 0, id_col="id") -> DataFrame:
    """``n`` articles in an order that a keyed hash of their id fixes."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return articles.orderBy(key, id_col).limit(n)


def build_eval_set(articles: DataFrame, ask, n: int = EVAL_SET_SIZE, seed: int = 0, id_col="id") -> DataFrame:
    """question, target_title for a human to go through; ``ask`` turns a row's text Column into a question."""
    return eval_sample(articles, n, seed, id_col).select(ask(F.col("text")).alias("question"), F.col("title").alias("target_title"))
