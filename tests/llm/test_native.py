"""Exact dedup, mixing, quality rules: contracts by brute force, edge cases, scale-free behaviour."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, mixing, outliers

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, t, lang, s in rows], DOCS)


def with_clashes(df, names):
    return df.withColumns({n: F.lit(1) for n in names})


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"e"]), max_size=60), st.integers(1, 4))
def test_misra_gries_keeps_heavy_hitters(stream, counters):
    held = exact_dedup.misra_gries(iter(stream), counters)
    n = Counter(stream)
    assert len(held) <= counters
    for k, c in n.items():
        assert n[k] - len(stream) / (counters + 1) <= held.get(k, 0) <= c


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_groups(spark, counters):
    rows = [(i, "hot  copy" if i % 3 else "hot copy", "en", "s") for i in range(60, 30, -1)]
    rows += [(1, None, "en", None), (2, "", "en", "s"), (3, " ", None, "s"), (4, "\t\n", "en", "s"), (5, "x", "en", "s"), (5, "x", "en", "s"), (6, " x", "en", "s"), (None, "x", "en", "s")]
    rows += [(7, "long " * 50_000, "en", "s"), (8, "é", "en", "s"), (9, "é", "en", "s")]
    docs = with_clashes(documents(spark, rows), ["digest", "row", "id", "kept", "first"])
    got = exact_dedup.exact_groups(docs, counters=counters).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t, _, _ in rows:
        groups[hashlib.sha256(normal(t).encode()).digest()].append(i)
    for r in got:
        own = groups[bytes(r.digest)]
        first = None if None in own else min(own)
        assert r.keep_id == first and r.group_size == len(own)
    for d, own in groups.items():
        kept = [r for r in got if bytes(r.digest) == d and r.kept]
        assert len(kept) == 1 and kept[0].id == (None if None in own else min(own))
    left = exact_dedup.exact_dedup(docs, counters=counters)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        rest = total - sum(held.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target | held
        held |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, None: 50}, {"a": 1, "b": 1000, "c": 10, "é": 0, "z": 5}, {"x": 7}, {"a": 0, "b": 0}, {c: 10 * i for i, c in enumerate("abcdefghij")}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_mix(spark):
    import random

    random.seed(4)
    rows = [(i, " ".join(["w"] * random.randint(0, 400)), "en", "hot" if i % 3 else random.choice(["a", "b", None])) for i in range(1500)]
    rows += [(5000, None, "en", "a"), (5001, " \x0b\x1c ", "en", "b"), (None, "a b", None, "c"), (7, "same same", "en", "a"), (7, "same same", "en", "a")]
    rows += [(6000 + i, "copy " * 30, "en", "hot") for i in range(800)]
    docs = with_clashes(documents(spark, rows), ["size", "cell", "class", "target", "copies"])
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(size)
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.03 * t + 900, s
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    again = {(r.id, r.size, r.copies) for r in mixing.copies(docs.repartition(7)).collect()}
    assert again == {(r.id, r.size, r.copies) for r in got}
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def brute_statistics(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_statistics(spark):
    import random

    random.seed(5)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e f", "a " * 11, "a b c d e a b c d e", "x\r\nx\ny\n \nx\n", "é|日 <#>\x1c\u2028z", "q " * 30_000]
    texts += [" ".join(random.choice("ab") for _ in range(random.randint(5, 40))) for _ in range(80)]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.id: r for r in outliers.quality_rules(with_clashes(docs, ["s", "points", "n_words", "distance"])).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == brute_statistics(t or "")
        assert got[i].base_failed == (got[i].n_words < 10 or 100 * got[i].n_repeat_words > 20 * got[i].n_words)
        assert not (got[i].base_failed and got[i].kept)
    assert outliers.quality_rules(docs.limit(0)).count() == 0


def test_outliers_go_and_the_rest_stays(spark):
    import random

    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(3, 8)))
    words = lambda n: [word() for _ in range(n)]
    clean = [(i, " ".join(words(random.randint(30, 300))), "en", "s") for i in range(300)]
    clean += [(500 + i, "\n".join(["a line that stands twice"] * 2 + [" ".join(words(120))]), "en", "s") for i in range(5)]
    junk = [(1000 + i, " ".join(word() + "***" for _ in range(80)), "en", "s") for i in range(30)]
    junk += [(1100, " ".join(word() * 6 for _ in range(80)), "en", "s"), (1101, "\n".join(x for i in range(60) for x in (word(), "ab cd", *words(3))), "en", "s")]
    junk += [(1102, " ".join(words(60_000)), "en", "s")]
    small = [(2000, " ".join(word() + "$$$" for _ in range(80)), "en", "tiny"), (2001, " ".join(words(80)), "en", "tiny"), (2002, " ".join(word() + "$$$" for _ in range(80)), "xx", None), (2003, " ".join(words(80)), None, "tiny")]
    rows = clean + junk + small
    docs = with_clashes(documents(spark, rows + [clean[0]]), ["level", "x0", "g_lang", "m0", "start"])
    got = {r.id: r.kept for r in outliers.quality_rules(docs).collect()}
    # The cutoff leaves out a thousandth of normal points, and lengths here are not normal.
    assert sum(got[i] for i, *_ in clean) >= 0.98 * len(clean) and sum(got[500 + i] for i in range(5)) >= 4 and not any(got[i] for i, *_ in junk)
    # Small groups are judged by their language, and small languages by all documents.
    assert (got[2000], got[2001], got[2002], got[2003]) == (False, True, False, True)
    few = {r.id: r.kept for r in outliers.quality_rules(documents(spark, small)).collect()}
    assert all(few.values())  # too few points for any estimate


def fast_mcd(x, floors, share=outliers.SHARE):
    """Concentration steps to convergence from a hundred random starts, lowest determinant."""
    rng, best = np.random.default_rng(1), None
    h = int(np.ceil(share * len(x)))
    for _ in range(100):
        sub = x[rng.choice(len(x), 8, replace=False)]
        for _ in range(100):
            m, s = sub.mean(0), np.cov(sub.T, bias=True) * outliers.CONSISTENCY + np.diag(floors)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            after = x[np.argsort(d, kind="stable")[:h]]
            if after.shape == sub.shape and (after == sub).all():
                break
            sub = after
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0]:
            best = (det, m, s)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_mcd_against_random_starts(spark, seed):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(5, 5))
    x = rng.normal(size=(900, 5)) @ mix + rng.normal(size=5)
    x[:150] = rng.normal(size=(150, 5)) * 0.3 + 12
    df = spark.createDataFrame([(0, "g", "s", *map(float, r)) for r in x], "level int, g_lang string, g_source string, " + ", ".join(f"x{i} double" for i in range(5)))
    floors = outliers.floors_of(df)
    e = outliers.mcd_estimates(df, floors).first()
    det, m, s = fast_mcd(x, np.array([floors.first()[f"f{i}"] for i in range(5)]))
    assert e.det <= det + 0.05
    assert np.allclose([e[f"m{i}"] for i in range(5)], m, atol=0.15 * np.sqrt(np.diag(s)).max())
    mine = np.array([[e[f"s{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
    assert np.abs(mine - s).max() < 0.15 * np.diag(s).max()
    # The inverse is the scatter's.
    inverse = np.array([[e[f"i{min(i, j)}{max(i, j)}"] for j in range(5)] for i in range(5)])
    assert np.allclose(inverse @ mine, np.eye(5), atol=1e-6)
