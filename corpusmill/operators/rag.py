"""Prompts with numbered sources, and batched question answering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SYSTEM_PROMPT, SearchConfig
from . import search


def estimated_tokens(text: Column) -> Column:
    """A character estimate: one token a wide character, one for four of the others."""
    wide = F.length(F.regexp_replace(text, r"[^⺀-鿿가-힯豈-﫿＀-￯]", ""))
    return (wide + F.ceil((F.length(text) - wide) / 4)).cast("int")


def counted_tokens(text: Column, encode: Callable[[str], list]) -> Column:
    """Tokens by a given encoder."""

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t is not None else 0).astype("int32")

    return run(text)


def _prompt(sources: Column, question: Column, chars: Column | int) -> Column:
    """``sources`` are structs with title and text in order; numbers follow that order without gaps."""
    cut = lambda s, i: F.concat(F.lit("[来源"), (i + 1).cast("string"), F.lit("] "), F.coalesce(s["title"], F.lit("")), F.lit("\n"), F.substring(F.coalesce(s["text"], F.lit("")), 1, chars))
    listed = F.array_join(F.transform(sources, cut), "\n\n")
    return F.concat(F.lit(SYSTEM_PROMPT + "\n\n"), F.when(F.size(sources) > 0, F.concat(listed, F.lit("\n\n"))).otherwise(""), F.lit("问题:"), question)


def build_prompts(questions: DataFrame, hits: DataFrame, max_sources=SearchConfig.top_m, source_chars=SearchConfig.source_chars, query_id="query_id", budget: int | None = None, tokens: Callable[[Column], Column] = estimated_tokens, least_chars: int = 200) -> DataFrame:
    """``questions`` (query_id, question) with prompt and sources. ``hits``: query_id, rank, chunk_id, title,
    text, score. Over the token budget sources are first shortened, halving down to ``least_chars``, then
    dropped from the end. A question without hits gets a prompt without sources."""
    used = hits.filter(F.col("rank") <= max_sources).groupBy(query_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "chunk_id", "score", "text"))).alias("sources")
    )
    joined = questions.join(used, query_id, "left").withColumn("sources", F.coalesce("sources", F.expr("array()").cast(used.schema["sources"].dataType)))
    full = _prompt(F.col("sources"), F.col("question"), source_chars)
    if budget is None:
        return joined.withColumn("prompt", full)
    tries = []
    chars = source_chars
    while True:
        tries.append((max_sources, chars))
        if chars <= least_chars:
            break
        chars = max(least_chars, chars // 2)
    tries += [(n, chars) for n in range(max_sources - 1, -1, -1)]
    prompt = lambda n, c: _prompt(F.slice("sources", 1, n) if n else F.slice("sources", 1, 0), F.col("question"), c)
    chosen = prompt(*tries[-1])
    number = F.lit(0)
    for n, c in reversed(tries[:-1]):
        fits = tokens(prompt(n, c)) <= budget
        chosen, number = F.when(fits, prompt(n, c)).otherwise(chosen), F.when(fits, n).otherwise(number)
    out = joined.withColumn("prompt", chosen).withColumn("_n", number)
    return out.withColumn("sources", F.slice("sources", F.lit(1), F.col("_n"))).drop("_n")


def generate(prompts: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Adds ``answer``. ``client`` is called once a partition and gives the function that answers."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = client()
        for texts in batches:
            yield texts.map(answer)

    return prompts.withColumn("answer", run(F.col("prompt")))


def ask(questions: DataFrame, index: DataFrame, metadata: DataFrame, client, k=SearchConfig.recall_k, top_m=SearchConfig.top_m, scorer=None) -> DataFrame:
    """query_id, question, answer and sources (title, chunk_id, score) for ``questions`` (query_id, question,
    query_vec): search, rerank, prompt, generate, in one plan."""
    hits = search.search_many(index, questions, k)
    # Without a scorer the order is known before texts are fetched: only the final hits meet them.
    if scorer is None:
        hits = search.with_metadata(search.rerank(hits, top_m), metadata)
    else:
        hits = search.rerank(search.with_metadata(hits, metadata), top_m, scorer)
    answered = generate(build_prompts(questions.select("query_id", "question"), hits, top_m), client)
    listed = F.transform("sources", lambda s: F.struct(s["title"].alias("title"), s["chunk_id"].alias("chunk_id"), s["score"].alias("score")))
    return answered.select("query_id", "question", "answer", listed.alias("sources"))
