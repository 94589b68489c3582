"""Readers, writers, pages, streams."""

import base64
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from corpusmill import jobs
from corpusmill.operators import pages
from corpusmill.sources import readers, writers
from corpusmill.streaming import jobs as stream


def lines(path, *rows, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + end, encoding="utf-8")


def article(i, text="x"):
    return {"id": str(i), "url": "u", "title": f"t{i}", "text": text}


def test_strict_reader(spark, tmp_path):
    lines(tmp_path / "a.jsonl", article(1), "", article(2))
    assert [r.id for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()] == ["1", "2"]
    lines(tmp_path / "b.jsonl", article(1), "{broken")
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    rows = readers.iter_jsonl(tmp_path / "b.jsonl")
    assert next(rows)["id"] == "1"
    with pytest.raises(ValueError, match="line 2"):
        next(rows)


def test_tolerant_reader_and_report(spark, tmp_path):
    lines(tmp_path / "AA" / "wiki_00", article(1), "", "{'id': '2'}", "{broken", article(3), end="")
    lines(tmp_path / "AB" / "wiki_01", article(4))
    lines(tmp_path / "AB" / "other", article(9))
    shards = readers.read_shards(spark, str(tmp_path)).cache()
    assert shards.count() == 5 and shards.filter("_corrupt IS NOT NULL").count() == 2
    assert [(r.line) for r in readers.broken_lines(spark, str(tmp_path / "AA")).orderBy("line").collect()] == [3, 4]
    assert [r.out_name for r in readers.shard_names(shards, str(tmp_path)).collect()] == ["wiki_00.jsonl", "wiki_01.jsonl"]
    shards.unpersist()
    lines(tmp_path / "AC" / "wiki_00", article(5))
    again = readers.read_shards(spark, str(tmp_path))
    assert [r.out_name for r in readers.shard_names(again, str(tmp_path)).collect()] == ["AA_wiki_00.jsonl", "AB_wiki_01.jsonl", "AC_wiki_00.jsonl"]
    with pytest.raises(FileNotFoundError):
        readers.shard_names(again.limit(0), str(tmp_path))


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>T</title><id>7</id><revision><id>1</id><text bytes='3'>正文</text></revision></page></mediawiki>", encoding="utf-8")
    assert [tuple(r) for r in readers.read_dump(spark, str(tmp_path / "d.xml")).collect()] == [("7", None, "T", "正文")]


def test_merge(spark, tmp_path):
    lines(tmp_path / "b.jsonl", "b1", "", "b2", end="")
    lines(tmp_path / "a.jsonl", "a1", "  ", "a2")
    out = str(tmp_path / "out")
    n = writers.merge_shards(spark, [str(tmp_path / x) for x in ("b.jsonl", "a.jsonl", "missing.jsonl")] + [out], out, single_file=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert n == 5 and part.read_text() == "a1\n  \na2\nb1\nb2\n" and readers.count_rows(spark, out) == 5
    with pytest.raises(FileNotFoundError):
        writers.merge_shards(spark, [str(tmp_path / "missing")], str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_writers(spark, tmp_path):
    for a in ("字", None):
        writers.append_jsonl(spark.createDataFrame([(a,)], "a string").coalesce(1), str(tmp_path / "d"))
    assert sorted(p.read_text(encoding="utf-8") for p in (tmp_path / "d").glob("part-*")) == ['{"a":"字"}\n', '{"a":null}\n']
    rows = spark.createDataFrame([("1", "字")], "id string, text string")
    writers.write_jsonl(rows, str(tmp_path / "j"))
    assert "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("part-*")) == '{"id":"1","text":"字"}\n'
    index = spark.createDataFrame([("1", [1.0])], "chunk_id string, embedding array<float>")
    writers.build_index(index, rows.select(F.col("id").alias("chunk_id"), F.lit("t").alias("title"), "text"), str(tmp_path / "i"))
    assert writers.load_index(spark, str(tmp_path / "i")).columns == ["chunk_id", "embedding", "title", "text"]
    keys = spark.createDataFrame([("1",), ("2",)], "chunk_id string")
    assert [r[0] for r in writers.unwritten(keys, str(tmp_path / "i"), "chunk_id").collect()] == ["2"]
    assert writers.unwritten(keys, str(tmp_path / "no"), "chunk_id").count() == 2


def test_hashes(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    row = readers.file_hashes(spark, str(tmp_path / "f")).first()
    assert row.sha1 == readers.hash_file(tmp_path / "f") == "a9993e364706816aba3e25717850c26c9cd0d89d"
    assert readers.verify_file(tmp_path / "f", row.md5.upper()) and readers.verify_file(tmp_path / "f", row.sha256) and not readers.verify_file(tmp_path / "f", "0" * 40)
    with pytest.raises(ValueError):
        readers.verify_file(tmp_path / "f", "abc")


def test_download(tmp_path):
    (tmp_path / "src").write_bytes(b"x" * 20_000)
    assert readers.download((tmp_path / "src").as_uri(), tmp_path / "d" / "got").read_bytes() == b"x" * 20_000
    assert not (tmp_path / "d" / "got.part").exists()


def test_page(spark):
    html = """<html><title>no</title><h1> 题 <b>库</b></h1><div class="article-content"><p>一、标题</p><p>答案：先</p><p>12、问 <i>什么</i>答案： 这个 </p>
    <p>答案:后 </p><p><img data-src="https://a/b.png">文</p><img src="/c.png"><p></p></div>"""
    title, blocks = pages.parse_page(html)
    assert title == "题库" and [b["text"] for b in blocks] == ["一、标题", "答案：先", "12、问什么答案： 这个", "答案:后", "文", "", ""]
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>a")], "page_id int, html string")
    rows = pages.classify(pages.page_blocks(df)).orderBy("page_id", "pos").collect()
    assert [(r.kind, r.num, r.question, r.answer) for r in rows if r.page_id == 1] == [
        ("heading", None, None, None), ("plain", None, None, None), ("question", "12", "问什么", "这个"), ("answer", None, None, "后"), ("plain", None, None, None),
    ]
    assert [r.text for r in rows if r.page_id == 3] == ["a"]


def test_image_urls(spark):
    key = F.lit(pages.IMAGE_KEY).cast("binary")
    secret = spark.range(1).select(F.base64(F.aes_encrypt(F.lit("/x.png").cast("binary"), key, F.lit("ECB"), F.lit("PKCS")))).first()[0]
    rows = [(secret, None), ("//h/a.png", None), (base64.b64encode(b"0" * 16).decode(), "b.png"), (None, "data:xx"), ("", "c.png"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, s string")
    got = [r[0] for r in df.orderBy("i").select(pages.image_url(F.col("d"), F.col("s"), F.lit("https://base/p/"))).collect()]
    assert got == ["https://www.sohu.com/x.png", "https://h/a.png", "https://base/p/b.png", None, "https://base/p/c.png", None]


def test_stream_resumes(spark, tmp_path):
    text = ("字" * 99 + "。") * 12
    lines(tmp_path / "in" / "a.json", article(1, text), article(2, "short"))

    def run():
        cleaned = stream.clean_stream(stream.article_stream(spark, str(tmp_path / "in")))
        assert stream.run_available(stream.chunk_stream(cleaned), str(tmp_path / "out"), str(tmp_path / "ck"), 120)
        return spark.read.parquet(str(tmp_path / "out"))

    assert {r.doc_id for r in run().collect()} == {"1"} and run().count() == 3
    lines(tmp_path / "in" / "b.json", article(3, text))
    assert run().groupBy("doc_id").count().orderBy("doc_id").collect() == [("1", 3), ("3", 3)]


def test_command_line(spark, tmp_path):
    lines(tmp_path / "in" / "wiki_0", article(1, "字" * 60), article(2, "x"), "{bad")
    jobs.main(["clean", str(tmp_path / "in"), str(tmp_path / "clean")])
    jobs.main(["chunk", str(tmp_path / "clean" / "articles"), str(tmp_path / "chunks"), "--subset=5"])
    assert [r.chunk_id for r in spark.read.json(str(tmp_path / "chunks")).collect()] == ["wiki1_c000"]
    assert (jobs.subset_size(None), jobs.subset_size("7"), jobs.subset_size("x")) == (None, 7, 100_000)
