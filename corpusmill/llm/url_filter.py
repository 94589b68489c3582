"""URL filter: rules first, then naive Bayes over segmented host and path words.

Words run together in hosts and paths are separated by a Viterbi search over a unigram model: the counts of the visible
words of all pages. Every substring of every distinct run of letters is looked up in the whole table of counts by a
join, so no word of up to LONGEST letters is left out; a longer one is taken for an unknown run.

Labels come from other words than those that are scored. A page that a rule covers has the rule's verdict for a
label; another one is an example to block if a seed word is among its segments, else to allow. Seeds and the words of the
rules give labels and are withheld from the features, so the model learns from the words that keep company with them.
Multinomial naive Bayes, fitted on all pages with exact counts of every token, scores every page.

Runs are segmented, and scored, once each. A page's runs meet these by a join, in which the runs that make up more than a
thousandth of all, fewer than a thousand, are broadcast.

Cases: a null URL, and one without ``://``, has empty host and path, fits no rule and gets the verdict of
the prior. Of rules of equal length that both fit, blocking wins. Repeated rows count each. Without pages
to block the prior allows. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
SEEDS = (
    "ads", "adult", "bets", "betting", "casino", "escort", "gambling", "hentai", "jackpot", "malware", "nude", "phishing",
    "pills", "poker", "porn", "roulette", "slots", "spam", "spyware", "viagra", "warez", "xxx",
)
SMOOTHING, LONGEST = 0.5, 24
#: Runs with more than this share of all occurrences are broadcast.
HOT = 0.001
NUMBER = "<n>"


def rule_words(rules=RULES) -> set[str]:
    """Words of the rules' names: they decide labels."""
    return {w for name, _ in rules for w in re.findall(r"[a-z]+", name.lower())}


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def segment(run: str, counts: dict[str, float], total: float) -> list[str]:
    """The most probable split of a run of letters; of equal ones that with the longer last word. An unknown run costs
    more with each letter."""
    n = len(run)
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    scale = math.log(total)
    unknown = [math.log(10.0) - scale - length * math.log(10.0) for length in range(LONGEST + 1)]
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            c = counts.get(run[start:end])
            score = best[start] + (unknown[end - start] if c is None else math.log(c) - scale)
            if score > best[end]:
                best[end], back[end] = score, start
    words = []
    while n:
        words.append(run[back[n] : n])
        n = back[n]
    return words[::-1]


def visible_word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """word, n over all pages: runs of 2 to LONGEST ASCII letters outside tags, counted per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held]), pa.array(held.values(), pa.int64())], names=["word", "n"])

        tag, word = re.compile(rb"(?s)<(script|style)\b.*?</\1>|<[^<>]*>|&#?\w+;"), re.compile(rb"(?<![a-z\x80-\xff])[a-z]{2,%d}(?![a-z\x80-\xff])" % LONGEST)
        for batch in batches:
            for html in batch.column(0).to_pylist():
                held.update(word.findall(tag.sub(b" ", html.lower() if html else b"")))
                if len(held) > 100_000:
                    yield batch_of()
                    held.clear()
        if held:
            yield batch_of()

    partial = pages.select(F.encode(F.col(html_col), "UTF-8")).mapInArrow(count, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def segmented(runs: DataFrame, words: DataFrame, seeds=SEEDS) -> DataFrame:
    """run and its tokens, from distinct runs and the table of word counts. Seeds count as frequent words, so that they
    win against a split into short syllables."""
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(100)).alias("most")).first()
    usual, total = sums.most // 100 + 1, float(sums.total + 1)
    lengths = F.sequence(F.lit(1), F.least(F.length("run") - F.col("at") + 1, F.lit(LONGEST)))
    starts = runs.filter("run >= 'a'").select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    parts = starts.select("run", F.explode(F.transform(lengths, lambda n: F.col("run").substr(F.col("at"), n))).alias("word")).distinct()
    # A run has few substrings, so its list is bounded by its own length.
    known = parts.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    asked = runs.join(known, "run", "left").select("run", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = {x["word"]: x["n"] for x in found or ()}
                for w in seeds:
                    if w in text:
                        counts[w] = max(counts.get(w, 0), usual)
                out.append([NUMBER] if text[0].isdigit() else segment(text, counts, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "tokens"])

    return asked.mapInArrow(run, "run string, tokens array<string>")


def _met(rows: DataFrame, runs: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``runs`` (unique by run). The rows of ``hot`` runs, fewer than 1 / HOT, stay where
    they are."""
    some = F.broadcast(runs.join(F.broadcast(hot), "run", "left_semi"))
    rest = rows.join(F.broadcast(hot), "run", "left_anti").join(runs, "run")
    return rows.join(some, "run").unionByName(rest)


def token_weights(counts: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """token and its log odds, from rows (token, allowed, blocked)."""
    sums = counts.agg(F.sum("allowed").alias("all_a"), F.sum("blocked").alias("all_b"), F.count(F.lit(1)).alias("kinds"))
    chance = lambda n, total: F.log((F.col(n) + smoothing) / (F.col(total) + smoothing * F.col("kinds")))
    return counts.crossJoin(F.broadcast(sums)).select("token", (chance("blocked", "all_b") - chance("allowed", "all_a")).alias("weight"))


def judge(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", rules=RULES, seeds=SEEDS) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict, words (segments of host and path) and score."""
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    urls = stored(named.select("*", rule.alias("rule"), says.alias("says")), "urls")
    runs_in = F.regexp_extract_all(F.lower(F.concat_ws(" ", "host", "path")), F.lit("[a-z]+|[0-9]+"), 0)
    pieces = urls.select("row", F.posexplode(runs_in).alias("at", "run"))
    runs = stored(pieces.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "runs")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = stored(runs.filter(F.col("n") > HOT * total).select("run"), "hot-runs")
    cut = stored(segmented(runs.select("run"), stored(visible_word_counts(pages, html_col), "words"), seeds), "segments")
    # Labels: a rule's verdict, or whether a seed is among the segments.
    seed = F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in seeds]))
    seeded = _met(pieces, cut.select("run", seed.alias("seed")), hot).groupBy("row").agg(F.max("seed").alias("seed")).withColumnRenamed("row", "r")
    labels = urls.join(seeded, F.col("row") == F.col("r"), "left")
    labels = stored(labels.select(F.col("row").alias("r"), F.coalesce(F.col("says") == "block", "seed", F.lit(False)).alias("blocked")), "labels")
    # Features: all other tokens, counted by run and label first.
    by_run = pieces.join(labels, F.col("row") == F.col("r")).groupBy("run").agg(F.count_if("blocked").alias("blocked"), F.count_if(~F.col("blocked")).alias("allowed"))
    withheld = sorted({*seeds, *rule_words(rules)})
    features = cut.select("run", F.explode("tokens").alias("token")).filter(~F.col("token").isin(withheld))
    counts = features.join(by_run, "run").groupBy("token").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    weights = stored(token_weights(stored(counts, "tokens")), "weights")
    by_run = features.join(weights, "token").groupBy("run").agg(F.sum("weight").alias("weight"))
    known = stored(cut.join(by_run, "run", "left").select("run", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight")), "run-weights")
    each = _met(pieces, known, hot).groupBy("row").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_list(F.struct("at", "tokens"))).alias("parts")).withColumnRenamed("row", "r")
    n = labels.agg(F.count_if("blocked").alias("b"), F.count_if(~F.col("blocked")).alias("a")).first()
    prior = math.log(n.b + 0.5) - math.log(n.a + 1.0)
    out = urls.join(each, F.col("row") == F.col("r"), "left").withColumn("score", F.lit(prior) + F.coalesce("weight", F.lit(0.0)))
    words = F.coalesce(F.flatten(F.transform("parts", lambda p: p["tokens"])), F.array().cast("array<string>"))
    own = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("id", "host", "path", "rule", F.coalesce("says", own).alias("verdict"), words.alias("words"), "score")


def op1_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
