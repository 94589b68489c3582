"""The library's queries over the driver's tables: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EmbedConfig
from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunk, clean, embed, evaluate, pages, rag, search
from .. import jobs
from ..session import scratch
from ..sources import readers, writers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _articles(spark, sf_dir) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("url"), F.col("source").alias("title"), "text", "lang", "doc_id")


#: What the gates look for, put into one document of ten each.
def injected(text: Column, doc_id: Column) -> Column:
    k = doc_id % 10
    return (
        F.when(k == 0, F.concat(F.lit("#REDIRECT [[X]]\n"), text))
        .when(k == 1, F.concat(text, F.lit(" __NOTOC__")))
        .when(k == 2, F.lit(" \t\n "))
        .when(k == 3, F.concat(text, F.lit(" 可以指")))
        .when(k == 5, F.concat(F.lit("-{H|zh-cn:a;}-\n#重定向 X\n"), text))
        .otherwise(text)
    )


def _injected(spark, sf_dir) -> DataFrame:
    return _articles(spark, sf_dir).withColumn("text", injected(F.col("text"), F.col("doc_id")))


def _wide(spark, sf_dir) -> DataFrame:
    """Documents with full-width sentence ends and blank lines between paragraphs."""
    a = _articles(spark, sf_dir)
    return a.withColumn("text", F.replace(F.translate("text", ".!?", "。！？"), F.lit("\n"), F.lit("\n\n")))


def clean_lines(spark, sf_dir):
    return _articles(spark, sf_dir).select("doc_id", T.paragraphs_of(T.clean_lines(F.col("text"))).alias("body"))


def eff_len(spark, sf_dir):
    return _articles(spark, sf_dir).select("doc_id", T.effective_length(F.col("text")).cast("long").alias("eff_len"))


def drop_reasons(spark, sf_dir):
    return clean.clean_articles(_injected(spark, sf_dir)).select("doc_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))


def drop_reason_counts(spark, sf_dir):
    return clean.reason_counts(clean.clean_articles(_injected(spark, sf_dir)))


def clean_articles(spark, sf_dir):
    return clean.kept_articles(clean.clean_articles(_injected(spark, sf_dir))).select("id", "title", F.col("n_chars").cast("long").alias("n_chars"), "text")


def clean_stats(spark, sf_dir):
    return clean.drop_alarm(clean.clean_stats(clean.clean_articles(_injected(spark, sf_dir)), "lang")).withColumn("drop_rate", F.round("drop_rate", 6))


def strip_tags(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def unescape_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.unescape(F.col("html")).alias("html"))


def nfc_fold(spark, sf_dir):
    text = F.concat(F.replace(F.col("text"), F.lit("e"), F.lit("é")), F.lit("\r\nx\ry"))
    return _articles(spark, sf_dir).select("doc_id", T.fold_newlines(T.nfc(text)).alias("text"))


# Inputs and what becomes of them, in turn over the documents.
CONVERSIONS = (
    ("軍-{}-團", "軍團"),
    ("-{出}-", "出"),
    ("-{zh-cn:域;zh-tw:體}-", "域"),
    ("-{zh-hans:里瓦尔多;zh-hk:李華度;zh-tw:里瓦爾多}-", "里瓦尔多"),
    ("x-{zh-hant:;zh-hans:;}-y", "xy"),
    ("-{zh-cn:12:00}-", "12:00"),
    ("-{foo:1;bar:2}-", "foo:1;bar:2"),
    ("a-{H|zh-cn:重定向;zh-tw:重新導向;}-b", "ab"),
    ("a-{H", "a"),
    ("-{zh-tw:甲;zh-cn: 乙 ;zh-cn:丙}-", "丙"),
)
PARENS = (
    ("（，）x", "x"),
    ("( )x", "x"),
    ("(,;)x", "x"),
    ("（1955年2月17日—）", "（1955年2月17日—）"),
    ("(（）)x", "x"),
    ("a​b﻿c­d\u0007e", "abcde"),
    ("a\tb", "a\tb"),
    ("((()))x", "x"),
)


def _cases(cases, key: Column, text: Column) -> Column:
    of = F.element_at(F.array(*[F.lit(a) for a, _ in cases]), (key % len(cases) + 1).cast("int"))
    return F.concat(of, F.lit("\n"), text)


def conversion_markup(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return a.select("doc_id", T.conversion_markup(_cases(CONVERSIONS, F.col("doc_id"), F.col("text"))).alias("text"))


def invisible_parens(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return a.select("doc_id", T.empty_parens(T.strip_invisible(_cases(PARENS, F.col("doc_id"), F.col("text")))).alias("text"))


def truncate_long(spark, sf_dir):
    long = F.repeat(F.col("text"), (F.col("doc_id") % 40 + 1).cast("int"))
    cut = T.truncated(long, 50_000)
    return _articles(spark, sf_dir).select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("hash"))


def paragraphs(spark, sf_dir):
    return _wide(spark, sf_dir).select("doc_id", F.posexplode(chunk.paragraphs(F.col("text"))).alias("para_no", "para"))


def sentences(spark, sf_dir):
    return chunk.sentence_rows(_wide(spark, sf_dir), "doc_id")


def hard_cut(spark, sf_dir):
    return _articles(spark, sf_dir).select("doc_id", F.posexplode(chunk.hard_cut(F.col("text"))).alias("part", "piece"))


def _chunks(spark, sf_dir):
    return chunk.chunk_documents(_wide(spark, sf_dir))


def chunks(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("chunk_id", "doc_id", "title", "chunk_index", "overlap_len", "text")


def chunk_stats(spark, sf_dir):
    c = _chunks(spark, sf_dir).withColumnRenamed("title", "source")
    out = chunk.chunk_stats(c, "source")
    return out.withColumn("max_len", F.col("max_len").cast("long"))


def subset_first_n(spark, sf_dir):
    return chunk.subset(_articles(spark, sf_dir), 100, "doc_id").select("doc_id", "text")


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def l2_normalize(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: (x * (F.col("vec_id") % 7)).cast("float"))
    out = _vectors(spark, sf_dir).select("vec_id", V.l2_normalize(scaled).alias("v"))
    return out.select("vec_id", F.round(V.norm(F.col("v")), 4).alias("norm"))


def cosine_pairs(spark, sf_dir):
    a = _vectors(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


def _queries(spark, sf_dir):
    v = _vectors(spark, sf_dir).filter("vec_id % 100 = 0")
    return v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("target_title"))


def topk_single(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    query = list(v.filter("vec_id = 0").first().embedding)
    return search.search_one(v, query, 50, "vec_id").select("vec_id", F.round("score", 4).alias("score"))


def topk_batch(spark, sf_dir):
    hits = search.search_many(_vectors(spark, sf_dir), _queries(spark, sf_dir), 10, "vec_id")
    return hits.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def reranked(spark, sf_dir):
    hits = search.search_many(_vectors(spark, sf_dir), _queries(spark, sf_dir), 50, "vec_id")
    by_id = lambda h: h.withColumn("rerank_score", -F.col("vec_id"))
    return search.rerank(hits, 5, by_id, id_col="vec_id").select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"))


def self_check(spark, sf_dir):
    return search.self_check(_vectors(spark, sf_dir), id_col="vec_id").select("query_id", "vec_id", F.round("score", 3).alias("score"), "passed")


def _ranked(spark, sf_dir, k: int):
    q = _queries(spark, sf_dir)
    v = _vectors(spark, sf_dir)
    # A query may not find itself.
    hits = search.search_many(v, q, k + 1, "vec_id").filter("query_id != vec_id")
    order = hits.join(v.select("vec_id", F.col("label").alias("title")), "vec_id")
    return evaluate.first_hits(q.select("query_id", "target_title"), order)


def hit_mrr(spark, sf_dir):
    m = evaluate.metrics(_ranked(spark, sf_dir, 50))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


def worst_cases(spark, sf_dir):
    return evaluate.worst_cases(_ranked(spark, sf_dir, 50)).select("query_id", "target_title", F.col("first_rank").cast("long").alias("first_rank"))


def ab_table(spark, sf_dir):
    m = evaluate.ab_table({"k5": _ranked(spark, sf_dir, 5), "k50": _ranked(spark, sf_dir, 50)})
    return m.select("variant", "n", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def eval_sample(spark, sf_dir):
    return evaluate.eval_sample(_articles(spark, sf_dir)).select("id", "title")


def build_prompt(spark, sf_dir):
    """Each benchmark item asks; the documents of five ids after its own are its sources."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    near = items.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("rank"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "source", "text")
    hits = near.join(docs, near["query_id"] + near["rank"] == docs["d"])
    hits = hits.select("query_id", "rank", F.col("source").alias("title"), F.col("d").cast("string").alias("chunk_id"), F.lit(1.0).alias("score"), "text")
    return rag.build_prompts(items, hits).select("query_id", "prompt", F.size("sources").cast("long").alias("n_sources"))


def token_counts(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return a.select("doc_id", rag.estimated_tokens(F.concat(F.lit("参考资料"), F.col("text"))).cast("long").alias("tokens"))


def answers(spark, sf_dir):
    """Search, rerank, prompt and a stub in place of the generator."""
    v = _vectors(spark, sf_dir).withColumnRenamed("vec_id", "chunk_id")
    meta = v.select("chunk_id", F.col("label").cast("string").alias("title"), F.concat(F.lit("text "), F.col("chunk_id").cast("string")).alias("text"))
    questions = _queries(spark, sf_dir).withColumn("question", F.concat(F.lit("q"), F.col("query_id").cast("string")))
    out = rag.ask(questions, v, meta, lambda: lambda prompt: str(len(prompt)), k=20, top_m=3)
    return out.select("query_id", "answer", F.transform("sources", lambda s: s["chunk_id"]).cast("string").alias("sources"))


def page_blocks(spark, sf_dir):
    return pages.page_blocks(_table(spark, sf_dir, "pages")).select("page_id", "title", "pos", "text")


def _lines(spark, sf_dir):
    """Lines of documents as paragraphs of a question page."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    k = (F.col("doc_id") + F.col("pos")) % 6
    text = (
        F.when(k == 0, F.concat(F.col("pos").cast("string"), F.lit("、"), F.col("line"), F.lit("答案： yes")))
        .when(k == 1, F.concat(F.lit("答案:"), F.col("line")))
        .when(k == 2, F.concat(F.lit("二、"), F.col("line")))
        .when(k == 3, F.concat(F.lit("7. "), F.col("line")))
        .otherwise(F.col("line"))
    )
    return d.select(F.col("doc_id").alias("page_id"), "pos", text.alias("text"))


def paragraph_kinds(spark, sf_dir):
    return pages.classify(_lines(spark, sf_dir)).select("page_id", "pos", "kind", "num", "question", "answer")


def image_urls(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    plain = F.concat(F.lit("//img.example.com/"), F.col("page_id").cast("string"))
    key = F.lit(pages.IMAGE_KEY).cast("binary")
    secret = F.base64(F.aes_encrypt(plain.cast("binary"), key, F.lit("ECB"), F.lit("PKCS")))
    k = F.col("page_id") % 4
    data_src = F.when(k == 0, secret).when(k == 1, F.lit("https://a.example/x.png")).when(k == 2, F.lit("not base64!"))
    src = F.concat(F.lit("/i/"), F.col("page_id").cast("string"), F.lit(".png"))
    return p.select("page_id", pages.image_url(data_src, src, F.lit("https://h.example/d/p.html")).alias("url"))


def resume_antijoin(spark, sf_dir):
    a = _articles(spark, sf_dir)
    done = a.filter("doc_id % 3 = 0").select(F.col("id").alias("chunk_id"))
    return embed.missing(a.withColumnRenamed("id", "chunk_id"), done).select("chunk_id")


def embed_documents(spark, sf_dir):
    config = EmbedConfig(dim=64)
    v = embed.embed_chunks(_articles(spark, sf_dir).withColumnRenamed("id", "chunk_id"), embed.count_provider(64), config)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return v.select("chunk_id", F.size("embedding").cast("long").alias("dim"), F.round(total, 3).alias("total"), F.round(F.array_max("embedding").cast("double"), 3).alias("peak"))


def json_lines(spark, sf_dir):
    """Rows as JSON lines, one in ten broken, read back tolerantly."""
    d = _table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text"))
    cut = d.select("lang", F.when(F.col("doc_id") % 10 == 0, F.substring(line, 1, 8)).otherwise(line).alias("line"))
    parsed = cut.select("lang", F.from_json("line", readers.ARTICLE + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}).alias("r"))
    return parsed.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("r._corrupt").isNotNull()).alias("badlines"), F.sum(F.length("r.text")).alias("chars"))


def text_hashes(spark, sf_dir):
    return _articles(spark, sf_dir).select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


def human_sizes(spark, sf_dir):
    n = F.pow(F.lit(2.0), F.col("doc_id") % 50) * 3
    return _articles(spark, sf_dir).select("doc_id", T.human_size(n).alias("size"), T.human_time(F.col("doc_id") * 37).alias("time"))


def ordered_concat(spark, sf_dir):
    """Non-blank lines of all documents in order of document and place, with their running number by document."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.filter(F.length(F.trim("line")) > 0).orderBy("doc_id", "pos").select("doc_id", "pos", "line")


def clean_then_chunk(spark, sf_dir):
    """The flagship: clean, gate, chunk, and statistics by language."""
    a = _articles(spark, sf_dir).withColumn("text", F.translate("text", ".!?", "。！？"))
    kept = clean.clean_articles(a).filter("drop_reason IS NULL").select("id", F.col("lang").alias("title"), F.col("clean_text").alias("text"))
    out = chunk.chunk_stats(chunk.chunk_documents(kept), "title").withColumnRenamed("title", "lang")
    return out.withColumn("max_len", F.col("max_len").cast("long"))


def jsonl_round_trip(spark, sf_dir):
    """Documents written as JSON lines, some more appended, and read back strictly."""
    a, at = _articles(spark, sf_dir).select("id", "url", "title", "text"), scratch(spark, "jsonl")
    writers.write_jsonl(a.filter("id % 2 = 0"), at)
    writers.append_jsonl(a.filter("id % 2 = 1"), at)
    return readers.read_jsonl(spark, at).select("id", "url", "title", F.md5("text").alias("hash"))


def merged_shards(spark, sf_dir):
    """Lines of documents in three shards, merged without the empty ones; the number of each line."""
    d, at = _table(spark, sf_dir, "documents"), scratch(spark, "shards")
    for k in range(3):
        d.filter(F.col("doc_id") % 3 == k).select(F.explode(F.split("text", "\n")).alias("line")).write.text(f"{at}/{k}")
    writers.merge_shards(spark, [f"{at}/{k}" for k in (2, 0, 1, 7)], f"{at}/all")
    return spark.read.text(f"{at}/all").groupBy(F.md5("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def cleaned_shards(spark, sf_dir):
    """The cleaning job over shards, one line in seven broken: its counts and the characters that it kept."""
    a, at = _injected(spark, sf_dir), scratch(spark, "clean")
    line = F.to_json(F.struct("id", "url", "title", "text"))
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    a.select(broken).write.text(f"{at}/in")
    stats = jobs.clean_shards(spark, f"{at}/in", f"{at}/out", pattern="part-*")
    again = jobs.clean_shards(spark, f"{at}/in", f"{at}/out", pattern="part-*")  # all are there: nothing is cleaned twice
    kept = spark.read.schema("text string, shard string").json(f"{at}/out/articles").agg(F.sum(F.length("text")).alias("chars"))
    totals = stats.unionByName(again).agg(*[(F.sum(c) / 2).cast("long").alias(c) for c in ("total", "kept", "dropped", "badlines")])
    return totals.crossJoin(kept)


def built_index(spark, sf_dir):
    """Vectors and their metadata written as an index and loaded."""
    v, at = _vectors(spark, sf_dir), scratch(spark, "index")
    meta = v.select("vec_id", F.col("label").cast("string").alias("title"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"))
    writers.build_index(v.select("vec_id", "embedding"), meta, at, "vec_id")
    index = writers.load_index(spark, at)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return index.select("vec_id", "title", "text", F.size("embedding").cast("long").alias("width"), F.round(total, 4).alias("total"))


def row_counts(spark, sf_dir):
    """Lines written and counted, and how many are still to be written once two thirds are there."""
    a, at = _articles(spark, sf_dir).select("id", "title"), scratch(spark, "rows")
    a.filter("id % 3 != 0").write.parquet(f"{at}/table")
    a.filter("id % 3 != 0").write.json(f"{at}/lines")
    left = writers.unwritten(a, f"{at}/table", "id")
    return left.agg(F.count(F.lit(1)).alias("unwritten")).withColumn("lines", F.lit(readers.count_rows(spark, f"{at}/lines")).cast("long"))


def chunk_checks(spark, sf_dir):
    """Acceptance figures of chunking: bodies above the limit, bodies near it, overlaps out of range, and documents that
    cannot be rebuilt from their chunks."""
    docs = _wide(spark, sf_dir).filter(F.length("text") > 0)
    made = chunk.chunk_documents(docs, "id")
    body = F.expr("substring(text, overlap_len + 1)")
    parts = made.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", body.alias("body")))).alias("c"))
    rebuilt = parts.select("doc_id", F.regexp_replace(F.array_join(F.transform("c", lambda x: x["body"]), ""), "\n", "").alias("rebuilt"))
    both = docs.select("id", F.regexp_replace("text", "\n", "").alias("whole")).join(rebuilt, F.col("id") == F.col("doc_id"), "left")
    lost = both.agg(F.count_if(~F.col("whole").eqNullSafe(F.coalesce("rebuilt", F.lit("")))).alias("lost"))
    figures = made.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("overlap_len") > 100).alias("long_overlaps"),
        F.count_if((F.col("chunk_index") == 0) & (F.col("overlap_len") > 0)).alias("first_overlaps"),
    )
    return figures.crossJoin(lost)


QUERIES = {
    f.__name__: f
    for f in (
        clean_lines, eff_len, drop_reasons, drop_reason_counts, clean_articles, clean_stats, strip_tags, unescape_pages, nfc_fold,
        conversion_markup, invisible_parens, truncate_long, paragraphs, sentences, hard_cut, chunks, chunk_stats, subset_first_n,
        l2_normalize, cosine_pairs, topk_single, topk_batch, reranked, self_check, hit_mrr, worst_cases, ab_table, eval_sample,
        build_prompt, token_counts, answers, page_blocks, paragraph_kinds, image_urls, resume_antijoin, embed_documents, json_lines,
        text_hashes, human_sizes, ordered_concat, clean_then_chunk, jsonl_round_trip, merged_shards, cleaned_shards,
        built_index, row_counts, chunk_checks,
    )
}
