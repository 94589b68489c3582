"""Cleaning and gating of articles.

Texts and verdicts are computed in one projection, and dropped rows stay, with their reason, until the
caller filters: reasons can be counted, and nothing is computed twice. Which gate sees which state of the
text is part of the definition, see :func:`clean_articles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CleanConfig
from ..functions import text as T

REASONS = ("empty", "redirect", "magic", "late_redirect", "stub", "short")


def clean_articles(
    articles: DataFrame,
    config: CleanConfig = CleanConfig(),
    table: dict[str, str] | None = None,
    text_col: str = "text",
    raw: Column | None = None,
) -> DataFrame:
    """Adds ``clean_text`` and ``drop_reason`` (null: kept).

    Order: empty gate; NFC and newlines; early redirect gate; references; tags; conversion markup;
    invisible characters; empty parentheses; magic-word gate; late redirect gate; lines and paragraphs;
    stub and length gates; conversion; truncation."""
    if config.convert and not table:
        raise ValueError("conversion is enabled but no conversion table is given")
    source = F.col(text_col) if raw is None else raw
    # Only normal forms and references need Arrow steps, and only in texts that can hold any.
    step = articles.withColumn("_raw", T.fold_newlines(T.nfc(source)))
    step = step.withColumn("_plain", T.conversion_markup(T.strip_tags(T.unescape(F.col("_raw"))), config.rounds))
    step = step.withColumn("_bare", T.empty_parens(T.strip_invisible(F.col("_plain")), config.rounds))
    step = step.withColumn("_body", T.paragraphs_of(T.clean_lines(F.col("_bare"), config.heading_chars)))
    step = step.withColumn("_size", T.effective_length(F.col("_body")))
    reason = (
        F.when(source.isNull() | (F.regexp_replace(source, T.WS, "") == ""), "empty")
        .when(F.col("_raw").rlike(T.REDIRECT), "redirect")
        .when(F.col("_bare").rlike(T.MAGIC_WORD), "magic")
        .when(F.col("_bare").rlike(T.REDIRECT), "late_redirect")
        .when(F.col("_body").rlike(T.STUB) & (F.col("_size") < config.stub_chars), "stub")
        .when(F.col("_size") < config.min_chars, "short")
    )
    body = F.col("_body")
    if config.convert:
        body = T.convert_variants(body, table)
    step = step.withColumn("drop_reason", reason)
    step = step.withColumn("clean_text", F.when(F.col("drop_reason").isNull(), T.truncated(body, config.max_chars)))
    return step.drop("_raw", "_plain", "_bare", "_body", "_size")


def kept_articles(cleaned: DataFrame, id_col="id", title_col="title", url_col="url", keep: tuple[str, ...] = ()) -> DataFrame:
    """The article table: id, title, url, n_chars (of the final text, without white space), text, and the columns ``keep``."""
    return cleaned.filter("drop_reason IS NULL").select(
        F.col(id_col).cast("string").alias("id"),
        F.col(title_col).alias("title"),
        F.col(url_col).alias("url"),
        T.effective_length(F.col("clean_text")).alias("n_chars"),
        F.col("clean_text").alias("text"),
        *keep,
    )


def failed_shards(stats: DataFrame, *by: str) -> DataFrame:
    """The shards of :func:`clean_stats` of which no line could be read."""
    return stats.filter("total > 0 AND badlines = total").select(*by)


def clean_stats(cleaned: DataFrame, *by: str, bad: Column | None = None) -> DataFrame:
    """total, kept, dropped, badlines and drop_rate, by group or over all; total is the sum of the three."""
    broken = F.lit(False) if bad is None else bad
    out = cleaned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~broken & F.col("drop_reason").isNull()).alias("kept"),
        F.count_if(~broken & F.col("drop_reason").isNotNull()).alias("dropped"),
        F.count_if(broken).alias("badlines"),
    )
    return out.withColumn("drop_rate", F.col("dropped") / F.greatest(F.col("total"), F.lit(1)))


def drop_alarm(stats: DataFrame, config: CleanConfig = CleanConfig()) -> DataFrame:
    return stats.withColumn("alarm", F.col("drop_rate") > config.drop_rate_alarm)


def reason_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
