"""Search, evaluation, prompts, embedding."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.config import EmbedConfig
from corpusmill.functions import vectors as V
from corpusmill.operators import embed, evaluate, rag, search


def vectors(spark, n=40, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, dim)).astype(float)
    return v, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, embedding array<float>")


def test_top_k_is_exact_with_ties(spark):
    v, index = vectors(spark)
    queries = index.filter("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = search.search_many(index.repartition(5), queries, 6).orderBy("query_id", "rank").collect()
    for q in range(7):
        order = sorted(range(len(v)), key=lambda i: (-float(v[i] @ v[q]), i))[:6]
        assert [r.chunk_id for r in got if r.query_id == q] == order
        one = search.search_one(index, list(v[q]), 6).collect()
        assert [r.chunk_id for r in one] == order


def test_k_above_the_index_and_empty_sides(spark):
    _, index = vectors(spark, 3)
    q = index.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    assert search.search_many(index, q, 50).count() == 9
    assert search.search_many(index.limit(0), q, 5).count() == 0
    assert search.search_many(index, q.limit(0), 5).count() == 0


def test_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_self_check_and_rerank(spark):
    _, index = vectors(spark, 8, 64)
    unit = index.select("chunk_id", V.l2_normalize(F.col("embedding")).alias("embedding"))
    assert [r.passed for r in search.self_check(unit).collect()] == [True] * 3
    hits = spark.createDataFrame([(1, c, float(-c)) for c in range(6)], "query_id int, chunk_id long, score double")
    assert [r.chunk_id for r in search.rerank(hits, 3).orderBy("rank").collect()] == [0, 1, 2]
    turned = search.rerank(hits, 6, lambda h: h.withColumn("rerank_score", -F.col("score")))
    assert [r.chunk_id for r in turned.orderBy("rank").collect()] == [5, 4, 3, 2, 1, 0]


def test_metrics(spark):
    queries = spark.createDataFrame([(1, "b"), (2, "z")], "query_id int, target_title string")
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "a")], "query_id int, rank int, title string")
    ranked = evaluate.first_hits(queries, hits)
    m = evaluate.metrics(ranked, (1, 2)).first()
    assert (m.n, m.hit_at_1, m.hit_at_2, m.mrr) == (2, 0.0, 0.5, 0.25)
    assert [r.query_id for r in evaluate.worst_cases(ranked, 1).collect()] == [2]
    assert {r.variant: r.mrr for r in evaluate.ab_table({"x": ranked, "y": ranked.limit(0)}).collect()} == {"x": 0.25}
    made = evaluate.build_eval_set(spark.createDataFrame([("1", "t", "abc")], "id string, title string, text string"), lambda t: F.concat(F.lit("? "), t)).collect()
    assert [tuple(r) for r in made] == [("? abc", "t")]


def prompt_inputs(spark):
    questions = spark.createDataFrame([(1, "why"), (2, "how")], "query_id int, question string")
    hits = spark.createDataFrame([(1, i, f"t{i}", str(i), 1.0 / i, "x" * 1000) for i in range(1, 8)], "query_id int, rank int, title string, chunk_id string, score double, text string")
    return questions, hits


def test_prompts(spark):
    got = {r.query_id: r for r in rag.build_prompts(*prompt_inputs(spark)).collect()}
    assert got[1].prompt.count("[来源") == 6 and "x" * 801 not in got[1].prompt and got[1].prompt.endswith("问题:why")
    assert [s.title for s in got[1].sources] == ["t1", "t2", "t3", "t4", "t5"]
    assert got[2].sources == [] and got[2].prompt.endswith("问题:how")


@pytest.mark.parametrize(("budget", "sources", "chars"), [(10_000, 5, 800), (600, 5, 400), (400, 5, 200), (300, 4, 200), (1, 0, 0)])
def test_prompt_budget_shortens_before_it_drops(spark, budget, sources, chars):
    row = next(r for r in rag.build_prompts(*prompt_inputs(spark), budget=budget).collect() if r.query_id == 1)
    assert len(row.sources) == sources
    assert not sources or ("x" * chars in row.prompt and "x" * (chars + 1) not in row.prompt)


def test_ask(spark):
    _, index = vectors(spark, 12)
    meta = index.select("chunk_id", F.concat(F.lit("t"), "chunk_id").alias("title"), F.lit("body").alias("text"))
    questions = index.limit(3).select(F.col("chunk_id").alias("query_id"), F.lit("q").alias("question"), F.col("embedding").alias("query_vec"))
    got = rag.ask(questions, index, meta, lambda: lambda p: f"{p.count('body')}", k=8, top_m=4).collect()
    assert len(got) == 3 and all(r.answer == "4" and len(r.sources) == 4 for r in got)


def test_embedding_resumes(spark, tmp_path):
    config = EmbedConfig(dim=16, batch=3)
    chunks = spark.createDataFrame([(str(i), "text " * (i % 4)) for i in range(10)], "chunk_id string, text string")
    first = embed.resume_embedding(chunks.limit(4), f"{tmp_path}/v", embed.hash_provider(16), config)
    assert first.count() == 4

    def refuses():
        raise AssertionError("nothing is left to embed")

    assert embed.resume_embedding(chunks, f"{tmp_path}/v", embed.hash_provider(16), config).count() == 10
    assert embed.missing(chunks, spark.read.parquet(*[str(p) for p in (tmp_path / "v").iterdir()])).count() == 0
    norms = {round(r[0], 3) for r in spark.read.parquet(*[str(p) for p in (tmp_path / "v").iterdir()]).select(V.norm(F.col("embedding"))).collect()}
    assert norms <= {0.0, 1.0}


def test_retries():
    waits, calls = [], []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [[1.0, 2.0]] * len(texts)

    config = EmbedConfig(dim=2)
    assert len(embed.with_retries(flaky, ["a", "b"], config, waits.append)) == 2 and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        embed.with_retries(lambda t: [[1.0]], ["a"], config, waits.append)
    assert waits[2:] == [2.0, 4.0, 8.0]


def test_tokens(spark):
    df = spark.createDataFrame([("资料abcd",), ("",)], "t string")
    assert [r[0] for r in df.select(rag.estimated_tokens(F.col("t"))).collect()] == [3, 0]
    assert [r[0] for r in df.select(rag.counted_tokens(F.col("t"), list)).collect()] == [6, 0]


def test_eval_sample_is_seeded(spark):
    a = spark.range(50).withColumnRenamed("id", "id")
    pick = lambda seed: [r.id for r in evaluate.eval_sample(a, 5, seed).collect()]
    assert pick(1) == pick(1) != pick(2)
    random.seed(0)
