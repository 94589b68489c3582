"""Secret scan: fixed patterns, and guess cost of values in credential contexts.

The base patterns find assignments, access keys and hexadecimal runs. Besides, every value that follows a
credential word is rated by the least number of guesses that reaches it: a dynamic program over all segmentations
into common words, dates, repeats, walks and brute-force spans finds the one of minimum total cost, in log10 guesses. Every
substring counts that is one of these: all words, all parts of a keyboard row or sequence of three or more characters, all
repeats of a unit of up to 16 characters at every start. Values at or above ``threshold`` are reported as spans of kind
``guess``, unless a base span already covers them.

Common words are counted from the texts themselves, without the values of credential contexts: runs of 3 to LONGEST_WORD
letters a-z that at least ``least`` documents hold, the ``words`` most frequent by number of documents at most (words of equal
number come together or not at all). A word's rank is its number of guesses. The table is broadcast and bounded by ``words``.

Cases: null text counts as empty. Whole texts are scanned, and whole values rated, whatever their length.
Positions are code points. Repeated rows are scanned each. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from types import MappingProxyType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frequent, slices, stored, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, a sign of assignment, a value: all up to the matching quote on the line, else up to a mark.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?)["']?[\x20\t]*(?:=>|->|:=|[:=])[\x20\t]*"""
    r"""(?:"(?P<double>(?:\\.|[^"\\\r\n]){6,})"|'(?P<single>(?:\\.|[^'\\\r\n]){6,})'|"(?P<plain2>[^"\r\n]{6,})"|'(?P<plain1>[^'\r\n]{6,})'|["']?(?P<bare>[^\s"'<>,;]{6,}))""",
    re.ASCII | re.IGNORECASE,
)
#: Every credential word of ASSIGN and CONTEXT holds one of these.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential")
#: Letters of a dictionary word; documents that must hold it; words of the dictionary.
SHORTEST_WORD, LONGEST_WORD, LEAST, MOST = 3, 20, 5, 30_000
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "abcdefghijklmnopqrstuvwxyz")
_WALKS = "\x00".join([*ROWS, *(r[::-1] for r in ROWS), "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik"])
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
DATE_LENGTHS = range(4, 11)
UNIT = 16
#: Log10 guesses from which a value counts as a secret; cost of one more segment.
THRESHOLD, JOIN = 10.0, 0.3


def _char_cost(c: str) -> float:
    size = 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000
    return math.log10(size)


def date_cost(length: int) -> float:
    return math.log10(150 if length == 4 else 150 * 366)


def walk_cost(length: int) -> float:
    return math.log10(40 * length)


def word_cost(part: str, plain: str, rank: int) -> float:
    """Of ``part``, which stands for the word ``plain``: its rank, and log10 2 for each kind of change."""
    case = 0.0 if part == part.lower() else 0.3 if part.istitle() or part.isupper() else 0.3 * sum(map(str.isupper, part))
    return math.log10(rank) + case + 0.3 * sum(a != b for a, b in zip(part.lower(), plain, strict=True))


def _spans(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of all words, dates and walks in ``value``."""
    low = value.lower()
    low = low if len(low) == len(value) else value
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + SHORTEST_WORD, min(n, i + LONGEST_WORD) + 1):
            rank = ranks.get(plain[i:j])
            if rank:
                yield i, j, word_cost(value[i:j], plain[i:j], rank)
        if value[i].isdigit():
            for length in DATE_LENGTHS:
                if i + length <= n and DATE.fullmatch(value, i, i + length):
                    yield i, i + length, date_cost(length)
        j = i + 3
        while j <= n and low[i:j] in _WALKS:
            yield i, j, walk_cost(j - i)
            j += 1


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """By end: (unit, first start) of the runs in which every unit equals the one before: ``value[s:end]`` is a repeat
    for each s from the first start on that lies two or more units before the end, a whole number of them."""
    out: dict[int, list[tuple[int, int]]] = {}
    for unit in range(1, min(UNIT, len(value) // 2) + 1):
        same = 0
        for k in range(unit, len(value)):
            same = same + 1 if value[k] == value[k - unit] else 0
            if same >= unit:
                out.setdefault(k + 1, []).append((unit, k + 1 - same - unit))
    return out


def guess_cost(value: str, ranks: dict[str, int] = MappingProxyType({})) -> float:
    """Log10 of the guesses for the cheapest segmentation of ``value``; ``ranks`` are the dictionary's."""
    n = len(value)
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _spans(value, ranks):
        ending.setdefault(j, []).append((i, cost))
    repeats = _repeats(value)
    chars = [_char_cost(c) for c in value]
    upto = [0.0, *accumulate(chars)]
    # brute[k]: cheapest split of value[:k] that ends in a brute-force span; best[k]: that ends in any.
    best, brute = np.full(n + 1, math.inf), [math.inf] * (n + 1)
    best[0] = 0.0
    for k in range(1, n + 1):
        brute[k] = min(brute[k - 1], best[k - 1] + (JOIN if k > 1 else 0.0)) + chars[k - 1]
        least = brute[k]
        for i, cost in ending.get(k, ()):
            least = min(least, best[i] + cost + (JOIN if i else 0.0))
        for unit, first in repeats.get(k, ()):
            # All starts that leave two or more whole units; the unit's characters, hence its cost, are those of any start.
            starts = best[k - 2 * unit : first - 1 if first else None : -unit]
            costs = starts + _LOGS[: len(starts)] if len(starts) <= len(_LOGS) else starts + np.log10(np.arange(2, len(starts) + 2))
            whole = upto[k] - upto[k - unit]
            cheapest = float(costs.min()) + whole + JOIN
            if k % unit == 0 and first == 0:
                cheapest = min(cheapest, whole + math.log10(k // unit))  # nothing before it to join
            least = min(least, cheapest)
        best[k] = least
    return float(best[n])


_LOGS = np.log10(np.arange(2, 4098))


def base_spans(text: str, hinted: bool | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns."""
    found = []
    if _hinted(text) if hinted is None else hinted:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _hinted(text: str) -> bool:
    if ":" not in text and "=" not in text and "->" not in text:
        return False
    low = text.lower()
    return any(h in low for h in HINTS)


def scan(text: str, threshold: float = THRESHOLD, ranks: dict[str, int] = MappingProxyType({})) -> tuple[list[tuple[int, int, str]], float]:
    """Base and guess spans in order, and the largest guess cost of a credential value (0 without any)."""
    hinted = _hinted(text)
    found, most = base_spans(text, hinted), 0.0
    covered = sorted((a, b) for a, b, _ in found)
    if hinted:
        extra = []
        for m in CONTEXT.finditer(text):
            a, b = m.span(m.lastgroup)
            cost = guess_cost(m[m.lastgroup], ranks)
            most = max(most, cost)
            if cost >= threshold and not any(x <= a and b <= y for x, y in covered):
                extra.append((a, b, "guess"))
        found += extra
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]))), most


def document_words(docs: DataFrame, text_col="text") -> DataFrame:
    """word, n: documents that hold it outside credential values."""
    letters = re.compile(rf"(?<![^\W\d_])[a-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}(?![^\W\d_])")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    text = text or ""
                    held.update(set(letters.findall((CONTEXT.sub(" ", text) if _hinted(text) else text).lower())))
                if len(held) > 100_000:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(F.col(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, text_col="text", least: int = LEAST, words: int = MOST) -> dict[str, int]:
    """Rank, from 2, of the common words; at most ``words`` come to the driver."""
    counts = stored(document_words(docs, text_col).filter(F.col("n") >= least), "words")
    found = sorted((-r.n, r.word) for r in frequent(counts, words).toLocalIterator())
    return {w: i + 2 for i, (_, w) in enumerate(found)}


def scan_secrets(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD, least=LEAST, words=MOST) -> DataFrame:
    """One row for each input row: id, spans (array of start, end, kind) and max_guess_log10."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, spans array<struct<start:bigint,end:bigint,kind:string>>, max_guess_log10 double"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text_col, least, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, costs = [], []
            for text in batch.column(1):
                found, most = scan(text.as_py() or "", threshold, ranks.value)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                costs.append(most)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(costs, pa.float64())], names=["id", "spans", "max_guess_log10"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op2_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        "max_guess_log10",
    )
