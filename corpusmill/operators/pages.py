"""Pages of questions and answers: body, paragraphs, their kinds, and image addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

# Key and host of encrypted image addresses.
IMAGE_KEY, IMAGE_HOST = "www.sohu.com6666", "https://www.sohu.com"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Node:
    def __init__(self, name: str, attrs: dict[str, str], parent=None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self):
        """All elements below, in document order, without recursion."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, _Node):
                yield x
                todo.extend(reversed(x.children))

    def strings(self) -> list[str]:
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, _Node):
                if x.name not in ("script", "style"):
                    todo.extend(reversed(x.children))
            else:
                out.append(x)
        return out

    def text(self) -> str:
        """Its strings, each stripped, joined."""
        return "".join(s.strip() for s in self.strings())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {})

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.name == "p":
            self.at = self.at.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse_page(html: str | None) -> tuple[str, list[dict]]:
    """(title, blocks) of a page. Title: first h1, else title element. Body: first article; else a div by
    class or id; else the parent of the first p. A block is a p or img directly in the body."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    every = list(tree.root.walk())
    first = lambda test: next((n for n in every if test(n)), None)
    title = first(lambda n: n.name == "h1") or first(lambda n: n.name == "title")
    classed = lambda pattern: first(lambda n: n.name == "div" and any(re.search(pattern, c) for c in n.attrs.get("class", "").split()))
    body = first(lambda n: n.name == "article") or classed(r"article[_-]?content") or first(lambda n: n.name == "div" and n.attrs.get("id") == "mp-editor") or classed("article")
    if body is None:
        p = first(lambda n: n.name == "p")
        body = p.parent if p else None
    blocks = []
    for child in body.children if body else []:
        if isinstance(child, _Node) and child.name in ("p", "img"):
            images = [child] if child.name == "img" else [n for n in child.walk() if n.name == "img"]
            blocks.append({
                "text": child.text() if child.name == "p" else "",
                "images": [{"data_src": n.attrs.get("data-src"), "src": n.attrs.get("src")} for n in images],
            })
    return title.text() if title else "", blocks


def page_blocks(pages: DataFrame, id_col="page_id", html_col="html") -> DataFrame:
    """page_id, title, pos, text and images of every block."""
    schema = "struct<title:string,blocks:array<struct<text:string,images:array<struct<data_src:string,src:string>>>>>"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages_html in batches:
            yield pd.DataFrame([dict(zip(("title", "blocks"), parse_page(h), strict=True)) for h in pages_html], columns=["title", "blocks"])

    parsed = pages.select(F.col(id_col).alias("page_id"), run(F.col(html_col)).alias("p"))
    blocks = parsed.select("page_id", F.col("p.title").alias("title"), F.posexplode("p.blocks").alias("pos", "b"))
    return blocks.select("page_id", "title", "pos", F.col("b.text").alias("text"), F.col("b.images").alias("images"))


def classify(blocks: DataFrame, page="page_id", pos="pos", text="text") -> DataFrame:
    """Adds kind (question, heading, answer, plain), num, question and answer to non-empty paragraphs. A line
    that begins with an answer mark counts as an answer only after a question of the same page."""
    t = F.col(text)
    numbered = r"^(\p{Nd}+)[、.]\s*(.*)"
    rest = F.regexp_extract(t, numbered, 2)
    parts = F.split(rest, r"答案[：:]\s*", 2)
    is_question = t.rlike(r"^\p{Nd}+[、.]")
    seen = F.max(is_question.cast("int")).over(Window.partitionBy(page).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1))
    is_answer = t.rlike(r"^答案[：:]") & (F.coalesce(seen, F.lit(0)) == 1)
    kind = F.when(is_question, "question").when(t.rlike(r"^[一二三四五六七八九十]+、"), "heading").when(is_answer, "answer").otherwise("plain")
    out = blocks.filter(F.length(text) > 0).withColumn("kind", kind)
    return out.select(
        "*",
        F.when(F.col("kind") == "question", F.regexp_extract(t, numbered, 1)).alias("num"),
        F.when(F.col("kind") == "question", strip(F.get(parts, F.lit(0)))).alias("question"),
        F.when(F.col("kind") == "question", F.coalesce(strip(F.get(parts, F.lit(1))), F.lit("")))
        .when(F.col("kind") == "answer", strip(F.regexp_replace(t, r"^答案[：:]\s*", "")))
        .alias("answer"),
    )


def decrypt_image(data: Column) -> Column:
    """The address in an encrypted attribute, with its protocol; null where it cannot be read."""
    plain = F.try_aes_decrypt(F.try_to_binary(data, F.lit("base64")), F.lit(IMAGE_KEY).cast("binary"), F.lit("ECB"), F.lit("PKCS")).cast("string")
    return F.when(plain.startswith("//"), F.concat(F.lit("https:"), plain)).when(plain.startswith("/"), F.concat(F.lit(IMAGE_HOST), plain)).otherwise(plain)


def image_url(data_src: Column, src: Column, base: Column) -> Column:
    """An image's address: data-src, decrypted unless it is an address, else src unless it holds data;
    relative ones are resolved against ``base``."""

    @F.pandas_udf("string")
    def join(base: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else urljoin(b or "", u) for b, u in zip(base, url, strict=True)])

    open_ = data_src.startswith("http") | data_src.startswith("//")
    given = F.coalesce(F.length(data_src) > 0, F.lit(False))
    decrypted = F.when(given & ~open_, decrypt_image(data_src))
    usable = F.when(F.length(src) > 0, F.when(~src.startswith("data:"), src))
    return F.coalesce(F.when(F.length(decrypted) > 0, decrypted), join(base, F.coalesce(F.when(given & open_, data_src), usable)))
