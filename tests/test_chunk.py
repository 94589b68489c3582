"""Packing, overlap and assembly: literal cases and invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from corpusmill.config import ChunkConfig
from corpusmill.operators import chunk as C


def sentence(n: int) -> str:
    return "字" * (n - 1) + "。"


def sizes(text: str) -> list[int]:
    return [len(C.block_text(b)) for b in C.pack(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (sentence(100) * 4 + sentence(60), [460]),
        (sentence(100) * 6, [500, 100]),
        (sentence(60) * 10, [600]),
        ("\n\n".join([sentence(200)] * 3), [604]),
        (sentence(200) + "\n\n" + sentence(300), [502]),
        ("字" * 700, [350, 350]),
        (sentence(500) + "\n\n" + sentence(30), [532]),
        (sentence(440) + sentence(200) + "\n\n" + sentence(30), [640, 30]),
        ("", []),
    ],
)
def test_packing(text, expected):
    assert sizes(text) == expected


@pytest.mark.parametrize(
    ("previous", "expected"),
    [
        ("甲" * 100 + "。" + "乙" * 50, "乙" * 50),
        ("甲" * 80 + "。" + "乙" * 80, "乙" * 80),
        ("丙" * 500, "丙" * 50),
        ("丁" * 300 + "。" + "戊" * 300, "戊" * 50),
        ("短", ""),
        ("短" * 50, ""),
        ("甲！乙？" + "丙" * 60, "丙" * 60),
        ("甲\n" + "丙" * 60, "丙" * 60),
    ],
)
def test_overlap(previous, expected):
    assert C.overlap_of(previous) == expected


@pytest.mark.parametrize(("text", "expected"), [("。这种潮流最早。", ["。", "这种潮流最早。"]), ("。", ["。"]), ("。。连续", ["。", "。", "连续"]), ("正常句子。第二句", ["正常句子。", "第二句"]), ("", [])])
def test_sentences(spark, text, expected):
    assert C.split_sentences(text) == expected
    assert spark.range(1).select(C.sentences(F.lit(text)).alias("s")).first().s == expected


def rebuilt(text: str) -> str:
    return "".join(t[n:] for t, n in C.chunk_text(text))


texts = st.lists(st.lists(st.integers(1, 700).map(sentence) | st.integers(1, 60).map(lambda n: "x" * n), min_size=1, max_size=6).map("".join), max_size=8).map("\n\n".join)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_invariants(text):
    chunks = C.chunk_text(text)
    assert rebuilt(text) == text
    for (before, _), (now, n) in zip(chunks, chunks[1:], strict=False):
        assert before.endswith(now[:n]) or not n
        assert 50 <= n <= 100 or (n == 0 and len(before) <= 50)
    for block in C.pack(text):
        assert 0 < len(C.block_text(block)) <= 1001


@pytest.mark.parametrize("text", ["第一段的正常内容。\n\n。这是段首带句号的一段。", "第一段。\n\n连音 \n\n以下词组。", "第一段。\n\n   \n\n第三段。"])
def test_lossless(text):
    assert rebuilt(text) == text
    assert rebuilt("\n\n".join([text] * 60)) == "\n\n".join([text] * 60)


def test_rows(spark):
    docs = spark.createDataFrame([("a", None, sentence(100) * 12), ("b", "t", ""), ("c", "t", None), ("d", "t", sentence(9) * 7000)], "id string, title string, text string")
    rows = C.chunk_documents(docs).orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk_id for r in rows if r.doc_id == "a"] == ["wikia_c000", "wikia_c001", "wikia_c002"] and rows[0].title == ""
    assert not [r for r in rows if r.doc_id in "bc"]
    d = [r for r in rows if r.doc_id == "d"]
    assert [r.chunk_index for r in d] == list(range(len(d))) and len({r.chunk_id for r in rows}) == len(rows)
    assert "".join(r.text[r.overlap_len :] for r in d) == sentence(9) * 7000
    stats = C.chunk_stats(C.chunk_documents(docs)).first()
    assert stats.docs == 2 and stats.chunks == len(rows) and stats.chunks_per_doc == round(len(rows) / 2, 2)


def test_ids_widen_past_three_digits(spark):
    text = (sentence(450) + "\n\n") * 1001
    last = C.chunk_documents(spark.createDataFrame([("1", "", text)], "id string, title string, text string")).orderBy(F.desc("chunk_index")).first()
    assert last.chunk_id == "wiki1_c1000"


def test_missing_id_is_an_error(spark):
    with pytest.raises(PySparkException):
        C.chunk_documents(spark.createDataFrame([(None, "t", "x")], "id string, title string, text string")).collect()
    with pytest.raises(ValueError):
        C.subset(spark.range(3), 0, "id")


def test_hard_cut(spark):
    for n in (1, 499, 500, 501, 1234):
        text = "".join(chr(0x4E00 + i % 1000) for i in range(n))
        assert spark.range(1).select(C.hard_cut(F.lit(text)).alias("p")).first().p == C.cut_evenly(text, ChunkConfig.hard_cut)
