"""Near duplicates, WARC archives, the pipeline."""

import gzip
import hashlib
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from corpusmill.llm import common, exact_dedup, mixing, near_dedup, pieces, warc

DOCS = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= threshold:
            parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        members[root(i)].append(k)
    return sorted(sorted(m) for m in members.values())


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"new{random.randrange(10**6)}"
    return " ".join(words)


def corpus():
    random.seed(8)
    word = lambda: random.choice("abcdefghijklmnop") + str(random.randrange(300))
    rows, k = [], 0
    passage = " ".join(word() for _ in range(60))
    for _ in range(40):
        base = [word() for _ in range(random.randint(30, 300))]
        for n in range(random.choice([1, 1, 2, 4])):
            rows.append((k, edited(base, n * random.choice([1, 2]) if n else 0)))
            k += 1
    base = [word() for _ in range(200)]
    for n in range(60):  # a large group around one text: pairs of copies lie on both sides of the threshold
        rows.append((k, edited(base, random.choice([0, 1, 2, 3]))))
        k += 1
    rows += [(k + i, passage + " " + " ".join(word() for _ in range(150))) for i in range(20)]
    k += 20
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "two words"), (k + 4, "Two  words"), (k + 5, "two other"), (k + 6, "w " * 5000), (k + 7, "w " * 5000 + "end")]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], DOCS + ", key int, bands int")
    got = near_dedup.near_classes(df).collect()
    assert len(got) == len(rows)
    members = defaultdict(list)
    for r in got:
        members[r.class_id].append(r.id)
    assert sorted(sorted(m) for m in members.values()) == brute_classes(rows)
    assert all(r.class_id == min(members[r.class_id]) and r.class_size == len(members[r.class_id]) for r in got)
    left = near_dedup.near_dedup(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(members)
    assert near_dedup.near_classes(df.limit(0)).count() == 0 and near_dedup.near_dedup(df.limit(0)).count() == 0


def test_twins_inside_one_boilerplate_family(spark):
    random.seed(21)
    word = lambda: f"w{random.randrange(10**6)}"
    passage = [word() for _ in range(172)]
    rows = []
    for i in range(80):  # twins share more than the passage, by which all the others are just too far apart
        own = [word() for _ in range(28)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:12] + [word() for _ in range(16)]))]
    want = brute_classes(rows)
    assert len(want) == 80
    df = spark.createDataFrame(rows, DOCS)
    params = {"rows": 1, "bands": 8}  # buckets that hold most of the family
    found = defaultdict(list)
    for r in near_dedup.near_classes(df, **params).collect():
        found[r.class_id].append(r.id)
    assert sorted(sorted(m) for m in found.values()) == want


def test_dense_families_are_compared_in_blocks(spark, monkeypatch):
    # Few partners are compared one by one, many in blocks; both ways find the same classes.
    random.seed(5)
    word = lambda: f"w{random.randrange(10**6)}"
    passage = [word() for _ in range(172)]
    rows = []
    for i in range(40):
        own = [word() for _ in range(28)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + own[:12] + [word() for _ in range(16)]))]
    want = brute_classes(rows)
    monkeypatch.setattr(near_dedup, "PAIRS", 1)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SKETCH_BLOCK", 16)
    monkeypatch.setattr(near_dedup, "PART", 4)
    found = defaultdict(list)
    for r in near_dedup.near_classes(spark.createDataFrame(rows, DOCS), rows=1, bands=8).collect():
        found[r.class_id].append(r.id)
    assert sorted(sorted(m) for m in found.values()) == want


def test_passes_with_and_without_dense_nodes(spark, monkeypatch):
    # A pass may find pairs alone, dense nodes alone or both; its batch has the same types.
    random.seed(6)
    word = lambda: f"w{random.randrange(10**6)}"
    rows = []
    for _ in range(3):
        passage = [word() for _ in range(172)]
        for _ in range(6):
            own = [word() for _ in range(28)]
            rows += [(len(rows), " ".join(passage + own)), (len(rows) + 1, " ".join(passage + own[:12] + [word() for _ in range(16)]))]
    monkeypatch.setattr(near_dedup, "PAIRS", 2)
    monkeypatch.setattr(near_dedup, "slices", lambda batch, column, *_: common.slices(batch, column, most_rows=1))
    found = defaultdict(list)
    for r in near_dedup.near_classes(spark.createDataFrame(rows, DOCS), rows=1, bands=8).collect():
        found[r.class_id].append(r.id)
    assert sorted(sorted(m) for m in found.values()) == brute_classes(rows)


def test_recall_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    sets = [(r.doc_id, shingles(r.text)) for r in df.collect()]
    places = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for g in s:
            places[g].add(i)
    pairs = {p for own in places.values() if len(own) > 1 for p in combinations(sorted(own), 2)}  # all that share a shingle
    true = [(a, b) for a, b in pairs if jaccard(sets[a][1], sets[b][1]) >= 0.8]
    label = {r.id: r.class_id for r in near_dedup.near_classes(df).collect()}
    caught = sum(label[sets[a][0]] == label[sets[b][0]] for a, b in true)
    print("pairs", len(true), "recall", caught / len(true))
    assert caught / len(true) >= 0.99


@pytest.mark.parametrize("columns", [7, 4096])
def test_close_pairs_equal_single_comparisons(monkeypatch, columns):
    monkeypatch.setattr(near_dedup, "COLUMNS", columns)
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(60, rng.integers(1, 60), replace=False)).astype(np.uint64).tobytes() for _ in range(80)]
    sets += [np.arange(1000 + i, 1004 + i, dtype=np.uint64).tobytes() for i in range(3)]
    got = set(zip(*(x.tolist() for x in near_dedup.close_pairs(sets[:50], sets[30:], 0.5)), strict=True))
    assert got == {(i, j) for i, a in enumerate(sets[:50]) for j, b in enumerate(sets[30:]) if near_dedup.similarity(a, b) >= 0.5}


def test_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (2, None)], DOCS)
    got = near_dedup.near_classes(df).collect()
    both = spark.createDataFrame([(5, text), (5, "quite another text that shares nothing at all"), (6, text), (5, text)], DOCS)
    assert sorted(tuple(r) for r in near_dedup.near_dedup(both).collect()) == [(5, text) if i else (5, "quite another text that shares nothing at all") for i in (1, 0)]
    assert [r.class_size for r in got if r.id == 1] == [3, 3] and all(r.class_size == 1 for r in got if r.id == 2)


def test_agreement_estimates_similarity():
    random.seed(9)
    pairs = []
    for share in (0.2, 0.5, 0.8, 0.95):
        base = [f"w{random.randrange(10**6)}" for _ in range(2000)]
        other = base[: int(2000 * share)] + [f"v{random.randrange(10**6)}" for _ in range(2000 - int(2000 * share))]
        pairs.append((" ".join(base), " ".join(other)))
    pairs.append(("r " * 50, "r " * 100))  # weights count: 46 against 96 units of one shingle
    for a, b in pairs:
        d, e = near_dedup.regions([a.encode(), b.encode()])
        s = near_dedup.darts(d, e, 2, k=512)
        assert (s != 0).all()
        assert (s[0] == s[1]).mean() == pytest.approx(jaccard(shingles(a), shingles(b)), abs=0.09)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \n\x0bÉé\x1c", max_size=30), max_size=6))
def test_word_hashes_tell_words_apart(texts):
    raw = [t.encode() for t in texts]
    hashes, lengths = near_dedup.word_hashes(raw)
    words = [w for t in raw for w in t.lower().split()]
    assert lengths.tolist() == [len(t.split()) for t in raw] and len(set(zip(hashes.tolist(), words, strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def test_signatures_do_not_depend_on_company():
    a, b = b"a b c d e f g", b"one two three four five six " * 30
    alone = near_dedup.darts(*near_dedup.regions([a]), 1)
    both = near_dedup.darts(*near_dedup.regions([b, a]), 2)
    assert (alone[0] == both[1]).all()


def test_components(spark):
    random.seed(3)
    edges = [(bytes([a]), bytes([b])) for a, b in [(1, 2), (2, 3), (9, 8), (3, 3)]] + [(bytes([100 + i]), bytes([101 + i])) for i in range(40)]
    got = {bytes(r.node): bytes(r.label) for r in near_dedup.components(spark.createDataFrame(edges, "x binary, y binary")).collect()}
    want = {bytes([i]): bytes([1]) for i in (1, 2, 3)} | {bytes([i]): bytes([8]) for i in (8, 9)} | {bytes([100 + i]): bytes([100]) for i in range(41)}
    assert got == want


# WARC


def page_rows():
    big = "<p>é" + "x" * 1200
    rows = [(i, f"http://h/{i}", big if i % 2 else "small") for i in range(40)]
    return rows + [(100, None, None), (101, "http://h/a b\r\nc%41é\u2028", ""), (102, "u", "y" * 300_000), (103, "u", "z" * 1000), (104, "u", "z" * 1000), (105, "u", "z" * 999), (106, "u", "z" * 999), (None, "u", "q"), (107, "u", "k" * 2000), (107, "u", "k" * 2000)]


def test_archives(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "page_id long, url string, html string, digest int, id int").repartition(3)
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.plan_records(df), folder).cache()
    got = warc.read_records(index, folder).collect()
    payload = lambda t: (t or "").encode()
    top = defaultdict(lambda: -1)
    for i, _, t in rows:
        if i is not None:
            top[t] = max(top[t], i)
    want = Counter()
    for i, u, t in rows:
        p = payload(t)
        revisit = len(p) >= 1000 and i != top[t]
        want[i, u, "revisit" if revisit else "response", len(p), hashlib.sha1(p).hexdigest(), top[t] if revisit else None, None if revisit else p] += 1
    assert Counter((r.id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    # The archives are whole gzip files of records, and the index covers them without gaps.
    for file in {r.file for r in index.collect()}:
        path = tmp_path / "w" / file
        spans = sorted((r.offset, r.length) for r in index.collect() if r.file == file)
        assert [o + n for o, n in spans] == [o for o, _ in spans[1:]] + [os.path.getsize(path)]
        assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1\r\n") == len(spans)
    some = index.filter("id % 7 = 0")
    assert sorted(r.id for r in warc.read_records(some, folder, with_payload=False).collect()) == sorted(i for i, *_ in rows if i is not None and i % 7 == 0)
    assert warc.read_records(warc.write_archives(warc.plan_records(df.limit(0)), f"{folder}0"), f"{folder}0").count() == 0


def test_record_headers():
    date = "2026-01-02T03:04:05Z"
    a, b = (warc.parse(warc.record(7, "http://h/a%41b?c=%25", b"x", "d", None, name, date))[0] for name in ("f/0", "f/9"))
    assert a["WARC-Date"] == date and a["WARC-Target-URI"] == "http://h/a%41b?c=%25" and a["WARC-Record-ID"] != b["WARC-Record-ID"]
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= a.keys()


def test_damage_is_an_error():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    heads, body = warc.parse(good)
    assert body == b"abc" and warc._row(heads, body, True)[0] == 1
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/0.9"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        warc._row(heads, b"abd", True)


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 500), st.integers(1, 50)), max_size=20))
def test_coalesced_reads_cover_every_range_once(ranges):
    ranges = sorted(ranges)
    reads = list(warc.coalesced(iter(ranges), gap=20, most=200))
    assert [(f, o, n) for f, _, _, m in reads for o, n in m] == ranges
    assert all(s <= o and o + n <= e for _, s, e, m in reads for o, n in m)


# Pipeline


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    random.seed(12)
    word = lambda: random.choice(["alpha", "beta", "gamma", "delta"]) + str(random.randrange(80))
    docs, labels = [], []
    for i in range(260):
        words = [word() for _ in range(random.randint(25, 90))]
        bad = random.random() < 0.25
        if bad:
            words[::6] = ["scum"] * len(words[::6])
        docs.append((i, " ".join(words), "en", random.choice(["s0", "s1", "s2"]), 0))
        labels.append((i, 1, int(bad)))
    clean = [d for d, x in zip(docs, labels, strict=True) if not x[2]]
    docs += [(1000 + i, clean[i][1].replace(" ", "  "), "en", "s0", 0) for i in range(20)]
    docs += [(2000 + i, edited(clean[30 + i][1].split() * 3, 1), "en", "s1", 0) for i in range(10)]
    docs += [(3000 + i, edited(clean[30 + i][1].split() * 3, 1), "en", "s1", 0) for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, columns = common.table(spark, str(tmp_path), "documents"), ["doc_id", "text", "lang", "source", "n_chars"]
    steps = [now]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(common.stored(stage(spark, steps[-1], str(tmp_path)), name.replace(" ", "")))
    start, graded, exact, near, mixed, encoded = steps
    assert all(s.columns == columns for s in steps[:-1])
    kept = {r.doc_id for r in graded.collect()}
    assert not kept & {i for i, _, t in labels if t} and {d[0] for d in clean} <= kept
    first = {}
    for i, t in sorted((r.doc_id, exact_dedup_text(r.text)) for r in graded.collect()):
        first.setdefault(t, i)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(first.values())
    classes = brute_classes([(r.doc_id, r.text) for r in exact.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(c[0] for c in classes)
    wanted = {r.id: r.copies for r in mixing.copies(near).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in wanted.items() if n})
    text = {r.doc_id: r.text for r in mixed.collect()}
    v = pieces.Vocabulary()
    rows = encoded.collect()
    assert len(rows) == mixed.count() and all(r.lossless and pieces.decode(r.ids, v) == text[r.doc_id] for r in rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_copies_of_the_mix_are_encoded_apart(spark):
    text = "the quick brown foxes jumped over internationalisation " * 20
    docs = spark.createDataFrame([(1, text)] * 3 + [(1, "other " * 60), (None, text), (None, text)], DOCS)
    rows = [(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.piece_encoding(spark, docs, "").collect()]
    again = [(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.piece_encoding(spark, docs.repartition(3), "").collect()]
    assert len(rows) == len(set(rows)) == 6 and sorted(map(repr, rows)) == sorted(map(repr, again))


def exact_dedup_text(t):
    import re

    assert exact_dedup.SPACE
    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing sources", "piece encoding"]


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op8_mix_sources", "op9_quality_rules", "op10_warc"])
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    mine = entry.queries()[name](spark, folder)
    columns = sorted(mine.columns)
    theirs = c.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, mine.select(*columns).collect()))) == sorted(map(repr, theirs))
