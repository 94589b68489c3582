"""Chunking with overlap.

Splitting and numbering are expressions. Packing carries state from sentence to sentence, and an overlap is
cut from the finished text of the chunk before, so both run in one Arrow function that turns a text into an
array of chunks; documents are independent and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig

# Sentence ends, and where a chunk may begin.
ENDS = "。！？"
SENTENCE = rf"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+$"
BREAKS = ENDS + "\n"
SEPARATOR = "\n\n"

Piece = tuple[int, str]


def paragraphs(text: Column) -> Column:
    """Between blank lines; only empty ones are left out, and none is trimmed."""
    return F.filter(F.split(text, SEPARATOR, -1), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """The terminator stays with its sentence; lone terminators are sentences; nothing is lost."""
    return F.regexp_extract_all(paragraph, F.lit(rf"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+\z"), 0)


def sentence_rows(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """doc_id, para_no, sent_no, sent."""
    paras = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(paragraphs(F.coalesce(text_col, F.lit("")))).alias("para_no", "para"))
    return paras.select("doc_id", "para_no", F.posexplode(sentences(F.col("para"))).alias("sent_no", "sent"))


def hard_cut(sentence: Column, most: int = ChunkConfig.hard_cut) -> Column:
    """Equal parts of at most ``most`` code points; the last takes what is left."""
    length = F.length(sentence)
    n = F.ceil(length / most).cast("int")
    size = F.ceil(length / n).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda j: sentence.substr(j * size + 1, size)))


def split_sentences(paragraph: str) -> list[str]:
    out, start = [], 0
    for i, c in enumerate(paragraph):
        if c in ENDS:
            out.append(paragraph[start : i + 1])
            start = i + 1
    return [*out, paragraph[start:]] if start < len(paragraph) else out


def cut_evenly(sentence: str, most: int) -> list[str]:
    n = -(-len(sentence) // most)
    size = -(-len(sentence) // n)
    return [sentence[i : i + size] for i in range(0, len(sentence), size)]


def pack(text: str, config: ChunkConfig = ChunkConfig()) -> list[list[Piece]]:
    """Blocks of (paragraph number, sentence).

    A sentence above the limit closes the block and is cut into blocks of its own. Otherwise a full enough
    block closes before a sentence that does not fit, and at the end of a paragraph. A short last block joins
    the one before if the two stay within the merge limit."""
    pieces = [(i, s) for i, p in enumerate(x for x in text.split(SEPARATOR) if x) for s in split_sentences(p)]
    blocks: list[tuple[list[Piece], int]] = []
    open_block: list[Piece] = []
    size = 0
    for k, (para, sentence) in enumerate(pieces):
        if len(sentence) > config.max_chars:
            if open_block:
                blocks.append((open_block, size))
            blocks += [([(para, part)], len(part)) for part in cut_evenly(sentence, config.hard_cut)]
            open_block, size = [], 0
            continue
        added = len(sentence) + (len(SEPARATOR) if open_block and open_block[-1][0] != para else 0)
        if size >= config.min_chars and size + added > config.max_chars:
            blocks.append((open_block, size))
            open_block, size, added = [], 0, len(sentence)
        open_block.append((para, sentence))
        size += added
        last_of_paragraph = k + 1 == len(pieces) or pieces[k + 1][0] != para
        if last_of_paragraph and size >= config.min_chars:
            blocks.append((open_block, size))
            open_block, size = [], 0
    if open_block:
        if blocks and size < config.tail_merge:
            before, length = blocks[-1]
            joined = length + size + (len(SEPARATOR) if before[-1][0] != open_block[0][0] else 0)
            if joined <= config.merge_limit:
                blocks[-1] = (before + open_block, joined)
                open_block = []
        if open_block:
            blocks.append((open_block, size))
    return [b for b, _ in blocks]


def block_text(block: list[Piece]) -> str:
    return SEPARATOR.join("".join(s for _, s in run) for _, run in groupby(block, key=lambda p: p[0]))


def overlap_of(previous: str, config: ChunkConfig = ChunkConfig()) -> str:
    """The tail of a finished chunk that opens the next one: exactly ``overlap`` characters, or more, up to
    ``overlap_max``, if that makes it begin after a break."""
    if len(previous) <= config.overlap:
        return ""
    cut = len(previous) - config.overlap
    nearest = max(previous.rfind(c, 0, cut) for c in BREAKS) + 1  # 0 without a break
    if nearest == cut or (nearest and len(previous) - nearest <= config.overlap_max):
        return previous[nearest:]
    return previous[cut:]


def chunk_text(text: str | list[str], config: ChunkConfig = ChunkConfig()) -> list[tuple[str, int]]:
    """(finished text, length of the overlap in front) of each chunk of a text or a list of paragraphs."""
    blocks = pack(text if isinstance(text, str) else SEPARATOR.join(text), config)
    out: list[tuple[str, int]] = []
    for k, block in enumerate(blocks):
        if not k:
            out.append((block_text(block), 0))
            continue
        front = overlap_of(out[-1][0], config)
        seam = SEPARATOR if block[0][0] != blocks[k - 1][-1][0] else ""
        out.append((front + seam + block_text(block), len(front)))
    return out


def _chunks(text: Column, config: ChunkConfig) -> Column:
    @F.pandas_udf("array<struct<text:string,overlap_len:int,body_len:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"text": c, "overlap_len": n, "body_len": len(c) - n} for c, n in chunk_text(t or "", config)])

    # Marked so that no inferred filter runs it a second time.
    return run.asNondeterministic()(text)


def chunk_documents(docs: DataFrame, id_col="id", title_col="title", text_col="text", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """chunk_id, doc_id, title, chunk_index, text, overlap_len, body_len. A missing id is an error."""
    ident = F.col(id_col).cast("string")
    checked = F.when(ident.isNull() | (ident == ""), F.raise_error(F.concat(F.lit("no id: title="), F.coalesce(F.col(title_col), F.lit(""))))).otherwise(ident)
    rows = docs.select(checked.alias("doc_id"), F.coalesce(F.col(title_col), F.lit("")).alias("title"), _chunks(F.col(text_col), config).alias("chunks"))
    rows = rows.select("doc_id", "title", F.posexplode("chunks").alias("chunk_index", "c"))
    return rows.select(
        F.format_string(f"{config.id_prefix}%s_c%03d", "doc_id", "chunk_index").alias("chunk_id"),
        "doc_id",
        "title",
        "chunk_index",
        F.col("c.text").alias("text"),
        F.col("c.overlap_len").alias("overlap_len"),
        F.col("c.body_len").alias("body_len"),
    )


def chunk_stats(chunks: DataFrame, *by: str, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """docs, chunks, max_len, over_max and chunks_per_doc. A document's chunks are counted by their first
    one, which needs no distinct count."""
    out = chunks.groupBy(*by).agg(
        F.count_if(F.col("chunk_index") == 0).alias("docs"),
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.max(F.length("text")), F.lit(0)).alias("max_len"),
        F.count_if(F.length("text") > config.max_chars).alias("over_max"),
    )
    return out.withColumn("chunks_per_doc", F.round(F.col("chunks") / F.greatest("docs", F.lit(1)), 2))


def subset(docs: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` documents in file order, which the caller names as columns."""
    if n <= 0:
        raise ValueError("the subset needs a positive number of documents")
    return docs.orderBy(*order).limit(n)
