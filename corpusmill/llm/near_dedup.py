"""Near-duplicate classes by DartMinHash, banding and exact checking.

A document is the multiset of its five-word shingles (ASCII letters lower-cased); fewer than five
words make one shingle of all. Each unit of a shingle's weight is a region into which darts are
thrown: their ranks are the arrivals of a unit Poisson process, their coordinates and values further
hashes, all keyed by the region alone. A document with total weight W looks at the darts of rank up to
theta/W only, about ``k ln k + 2k`` of them however long it is, and keeps the earliest dart of each of
``k`` coordinates; if a coordinate stays empty the bound is doubled. Two documents agree in a
coordinate with probability equal to their weighted Jaccard similarity.

``bands`` bands of ``rows`` coordinates make buckets. Equal multisets are one node from the start. In a
bucket every node is compared with the bucket's smallest key, its hub: first with the smallest of all its
hubs, then, where that has not brought the two into one class, with the others. Buckets that hold several classes
even then are compared completely, every node with all of other classes, so no pair of a bucket is left out. A
comparison looks at the ``k`` coordinates first, a byte of each, and passes over pairs that agree in six standard
deviations fewer than pairs at the threshold do; a link counts only after the similarity of both full
multisets, by 64-bit hashes, was computed and reaches ``threshold``. Classes are the connected components of the links.

Hot buckets: a hub's partners are dealt out to parts of PART links, and its multiset is sent once to each part. In a
complete comparison the largest class of a bucket is dealt out once and only the members of other classes are
sent to all its blocks.

Cases: null and empty texts, and texts without words, have no shingles; each is a class of its own.
Repeated rows and equal texts share a node. A null id sorts before others. An empty table gives an
empty result. Extra input columns are ignored by :func:`near_classes` and kept by :func:`near_dedup`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from .common import bitmap_table, fresh, in_arrow, key_bitmap, maybe_among, slices, stored, table

K, ROWS, BANDS = 128, 5, 25
SHINGLE, THRESHOLD = 5, 0.8
#: Links of a part of a hub; nodes of a block by coordinates and by multisets, the latter with so many regions at most.
PART, SKETCH_BLOCK, SET_BLOCK, SET_REGIONS = 512, 4096, 256, 1 << 20
#: Possible partners of a node in a piece of a cell that are compared one by one.
PAIRS = 8
#: Regions of a pass of a matrix product.
COLUMNS = 4096
_U = np.uint64
_LINKS = pa.schema([("x", pa.binary()), ("y", pa.binary())])
_ALIKE = pa.schema([("bucket", pa.int64()), *_LINKS])
#: Bytes of text and documents of a pass of the signature kernel, and bytes below which documents are passed apart.
PASS_BYTES, PASS_DOCS, SMALL = 1 << 20, 1024, 384


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Random 64-bit value of each byte, A-Z as a-z; which bytes are white space; an odd base and its inverse.
_BYTE = mix64(np.arange(256, dtype=_U) + _U(0x51))
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9FB21C651E98DF25
_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; kept for passes of the usual size only."""
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, 2 * PASS_BYTES), base, _U)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= 2 * PASS_BYTES:
        _powers[:] = made
    return made


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each: a polynomial hash taken
    from running sums over the joined bytes, so no word becomes an object."""
    joined = b"\n".join(t or b"" for t in texts)
    raw = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    power, inverse = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * inverse[starts])
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def regions(texts: list[bytes | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document index, region) of every unit of shingle weight, in document order."""
    h, lengths = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), _U)
        window = np.minimum(lengths, shingle)[doc]
        for j in range(shingle):
            ahead = np.zeros(len(h), _U)
            if j < len(h):
                ahead[: len(h) - j] = h[j:]
            rolled = np.where(j < window, rolled * _U(0x100000001B3) + mix64(ahead + _U(j)), rolled)
        whole = place + window <= lengths[doc]
        s, d = mix64(rolled[whole]), doc[whole]
        # Equal shingles of a document are told apart by their turn: the unit of weight they fill.
        own = s ^ mix64(d.astype(_U))
        order = np.argsort(own)
        own = own[order]
        same = np.zeros(len(s), bool)
        same[1:] = own[1:] == own[:-1]
        turn = np.zeros(len(s), _U)
        if same.any():
            place = np.arange(len(s))
            turn[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(_U)
        return d, mix64(s + turn * _U(0xD6E8FEB86659FD93))


def darts(doc: np.ndarray, region: np.ndarray, docs: int, k: int = K) -> np.ndarray:
    """Signatures (docs x k, uint64); rows of documents without regions stay 0."""
    weight = np.bincount(doc, minlength=docs)
    theta = k * math.log(k) + 2 * k
    out = np.zeros((docs, k), _U)
    with np.errstate(divide="ignore", over="ignore"):
        bound = theta / weight
        left = weight > 0
        while left.any():
            on = left[doc]
            d, e = doc[on], region[on]
            best = np.full(docs * k, np.inf)
            rank = np.zeros(len(e))
            found = []
            step = 0
            while len(e):
                step += 1
                x = mix64(e + _U(step) * _U(0xA0761D6478BD642F))
                rank = rank - np.log(((x >> _U(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53)))
                near = rank <= bound[d]
                d, e, rank, x = d[near], e[near], rank[near], x[near]
                y = mix64(x ^ _U(0xE7037ED1A0B428DB))
                at = d * k + (y % _U(k)).astype(np.int64)
                np.minimum.at(best, at, rank)
                found.append((at, rank, y // _U(k)))
            full = np.isfinite(best.reshape(docs, k)).all(axis=1) & left
            flat = out.reshape(-1)
            for at, r, value in found:
                win = (r == best[at]) & full[at // k]
                flat[at[win]] = value[win]
            left &= ~full
            bound = bound * 2
    return out


def band_hashes(signatures: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = signatures[:, : rows * bands].reshape(len(signatures), bands, rows)
        h = np.broadcast_to(np.arange(bands, dtype=_U), (len(signatures), bands))
        for r in range(rows):
            h = mix64(h * _U(0x100000001B3) + parts[:, :, r])
        return h.astype(np.int64)


def _keys(d: np.ndarray, e: np.ndarray, docs: int) -> list[bytes | None]:
    """128 bits that equal multisets share; None without regions. Sums over the regions in any order."""
    weight = np.bincount(d, minlength=docs)
    ends = np.cumsum(weight)
    with np.errstate(over="ignore"):
        sums = [np.concatenate(([_U(0)], np.cumsum(mix64(e ^ _U(c))))) for c in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)]
        a, b = (mix64(s[ends] - s[ends - weight] + weight.astype(_U)) for s in sums)
    raw = np.stack([a, b], 1).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] if weight[i] else None for i in range(docs)]


def sketches(signatures: np.ndarray) -> list[bytes]:
    """A byte of every coordinate: 128 bytes for a document."""
    low = np.ascontiguousarray(signatures.astype(np.uint8))
    return [row.tobytes() for row in low]


def least_agreement(threshold: float, k: int) -> int:
    """Coordinates in which two documents must agree to be compared on their multisets: six standard deviations
    below what pairs at the threshold agree in."""
    return max(0, math.floor(k * threshold - 6 * math.sqrt(k * threshold * (1 - threshold))))


def _passes(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in passes: small documents with small ones, so that the long series of darts that a tiny
    document needs is walked once for many."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for group in (np.flatnonzero(sizes < SMALL), np.flatnonzero(sizes >= SMALL)):
        ends = np.cumsum(sizes[group])
        start = 0
        while start < len(group):
            before = ends[start - 1] if start else 0
            stop = min(max(start + 1, int(np.searchsorted(ends, before + PASS_BYTES, "right"))), start + PASS_DOCS * (4 if sizes[group[start]] < SMALL else 1))
            yield batch.take(pa.array(group[start:stop]))
            start = stop


def signatures(docs: DataFrame, id_col: str, text_col: str, k=K, rows=ROWS, bands=BANDS) -> DataFrame:
    """id, digest (of the text), key (binary, null without shingles), weight (regions), bands (array of long) and
    sketch (binary)."""
    schema = docs.select(F.col(id_col).alias("id")).schema.simpleString()[len("struct<") : -1].replace("id:", "id ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _passes(batch, 2):
                n = part.num_rows
                d, e = regions(part.column(2).to_pylist())
                found = darts(d, e, n, k)
                flat = pa.array(band_hashes(found, rows, bands).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
                made = [pa.array(_keys(d, e, n), pa.binary()), pa.array(np.bincount(d, minlength=n).astype(np.int64)), lists, pa.array(sketches(found), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["id", "digest", "key", "weight", "bands", "sketch"])

    given = docs.select(F.col(id_col).alias("id"), digest_of(text_col).alias("digest"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return in_arrow(given, run, f"{schema}, digest string, key binary, weight bigint, bands array<bigint>, sketch binary")


def digest_of(text_col: str) -> Column:
    return F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))


def _key_hash() -> Column:
    return F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long")


def multisets(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """key and the sorted 64-bit region hashes of the texts with wanted keys, a row or more for each. A broadcast
    bitmap, sized by their number, holds back nearly all others before the shuffle, and a task sends a key rarely twice."""
    bits = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted, _key_hash(), wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        bitmap = bits.value
        mask = len(bitmap) * 8 - 1
        for batch in batches:
            for part in slices(batch, 0, PASS_BYTES, PASS_DOCS):
                d, e = regions(part.column(0).to_pylist())
                ends = np.cumsum(np.bincount(d, minlength=part.num_rows))
                rows = []
                if len(sent) > 50_000:
                    sent.clear()
                for i, key in enumerate(_keys(d, e, part.num_rows)):
                    if key is None or key in sent:
                        continue
                    place = int.from_bytes(key[:7], "big") & mask
                    if bitmap[place >> 3] >> (place & 7) & 1:
                        sent.add(key)
                        rows.append((key, np.sort(e[ends[i - 1] if i else 0 : ends[i]]).tobytes()))
                if rows:
                    yield _binary(rows, ("key", "regions"))

    return in_arrow(docs.select(F.encode(F.col(text_col), "UTF-8").alias("text")), run, "key binary, regions binary")


def _binary(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=list(names))


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted multisets of 64-bit hashes."""
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    # Turns make regions unique, so the multisets are sets here.
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is among those of ``keys``, by a bitmap, and few others: only these move at all."""
    bits, size = bitmap_table(keys, _key_hash(), keys.count())
    return maybe_among(rows, _key_hash(), bits, size, "asked").filter("asked").drop("asked")


def likely(links: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The rows (x, y) of ``links`` that agree in enough coordinates."""
    sketch = nodes.select("key", "sketch")
    pairs = links.join(sketch.toDF("x", "a"), "x").join(sketch.toDF("y", "b"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in part.columns[2:])
                good = (a == b).sum(axis=1) >= least_agreement(threshold, a.shape[1])
                yield part.filter(pa.array(good)).select([0, 1])

    return in_arrow(pairs.select("x", "y", "a", "b"), run, "x binary, y binary")


def verified(links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The rows (x, y) of ``links`` whose full multisets, in ``sets``, reach the threshold. ``x`` is the hub: its
    partners are dealt out to parts, and a task holds the hub's multiset while its partners' pass by."""
    links = stored(links, "likely")
    if not links.take(1):
        return links
    parts = stored(links.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).withColumnRenamed("x", "hub"), "hubs")
    members = links.join(parts, F.col("x") == F.col("hub")).select(F.col("y").alias("k"), "hub", F.pmod(F.xxhash64("y"), "parts").cast("int").alias("part"))
    members = stored(members, "roles")
    rows = members.join(_among(sets, members.withColumnRenamed("k", "key")), F.col("k") == F.col("key")).select("hub", "part", F.lit(1).alias("side"), "key", "regions")
    # A hub's multiset goes straight to its parts, a few others with them. Hubs of several parts are at most a PART-th of the links.
    several = F.broadcast(parts.filter("parts > 1").withColumnRenamed("hub", "k"))
    first = _among(sets, parts.withColumnRenamed("hub", "key")).join(several, F.col("k") == F.col("key"), "left")
    number = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    rows = rows.unionByName(first.select(F.col("key").alias("hub"), number, F.lit(0).alias("side"), "key", "regions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, b""
        for batch in batches:
            for piece in slices(batch, 4):
                good = []
                for x, _, side, key, regions_ in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if not side:
                        hub, held = x, regions_
                    elif x == hub and similarity(held, regions_) >= threshold:
                        good.append((x, key))
                if good:
                    yield _binary(good, ("x", "y"))

    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "side")
    return stored(in_arrow(dealt, run, "x binary, y binary"), "verified")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node in ``links`` (x, y), by alternating
    large-star and small-star steps until nothing changes."""
    two = F.col("x") != F.col("y")
    edges = stored(links.filter(two).select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(smallest, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u != v").distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.filter("u != v").distinct(), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def close_pairs(left: list[bytes], right: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of sorted multisets that reach the threshold: a matrix product over the
    regions that occur on both sides, some columns at a time."""
    a, b = ([np.frombuffer(x, _U) for x in side] for side in (left, right))
    flat = [np.concatenate(side) for side in (a, b)]
    row = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (a, b)]
    common = np.intersect1d(*flat)
    for s in range(2):
        held = np.isin(flat[s], common)
        flat[s], row[s] = np.searchsorted(common, flat[s][held]), row[s][held]
        order = np.argsort(flat[s], kind="stable")
        flat[s], row[s] = flat[s][order], row[s][order]
    both = np.zeros((len(a), len(b)))
    for lo in range(0, len(common), COLUMNS):
        parts = []
        for s, n in enumerate((len(a), len(b))):
            on = slice(*np.searchsorted(flat[s], (lo, lo + COLUMNS)))
            parts.append(np.zeros((n, min(COLUMNS, len(common) - lo)), np.float32))
            parts[s][row[s][on], flat[s][on] - lo] = 1
        both += parts[0] @ parts[1].T
    whole = np.add.outer([len(x) for x in a], [len(x) for x in b])
    return np.nonzero(both / (whole - both) >= threshold)


def _blocks(rows: DataFrame, size: Column, held: DataFrame | None = None) -> DataFrame:
    """``rows`` (bucket, key, label, ...), several times each, with cell and side: every two rows of a bucket with
    different labels are in one cell, on different sides. ``size`` gives a group's number of blocks from its rows. The
    largest class of a bucket is dealt to blocks once; the others' members meet each of these, and their own blocks
    each other. ``held`` (key, ...) is joined once, to rows that have a cell."""
    classes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    top = classes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("classes"))
    top = top.filter("classes > 1").withColumnRenamed("bucket", "b")
    marked = rows.join(top, F.col("bucket") == F.col("b")).withColumn("major", F.col("label") == F.col("top"))
    sizes = classes.join(top, F.col("bucket") == F.col("b")).groupBy("bucket", (F.col("label") == F.col("top")).alias("m")).agg(size.alias("blocks"))
    sizes = sizes.groupBy(F.col("bucket").alias("s")).agg(F.max(F.when(F.col("m"), F.col("blocks"))).alias("major_blocks"), F.max(F.when(~F.col("m"), F.col("blocks"))).alias("minor_blocks"))
    marked = marked.join(sizes, F.col("bucket") == F.col("s"))
    columns = rows.columns
    if held is not None:
        marked, columns = marked.join(held, "key"), [*columns, *(c for c in held.columns if c != "key")]
    to = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    hashed = F.xxhash64("key")
    nothing = F.lit(0)
    own_major, own = F.pmod(hashed, "major_blocks").cast("int"), F.pmod(hashed, "minor_blocks").cast("int")
    minor = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("major_blocks") - 1), lambda i: to(0, i, nothing, 1)),
        F.transform(F.sequence(own, F.col("minor_blocks") - 1), lambda j: to(1, own, j, 0)),
        F.transform(F.sequence(F.lit(0), own), lambda i: to(1, i, own, 1)),
    )
    roles = F.when(F.col("major"), F.array(to(0, own_major, nothing, 0))).otherwise(minor)
    return marked.select(*columns, F.explode(roles).alias("cell")).select(*columns, "cell.*")


def _compared(rows: DataFrame, payload: str, compare, schema: pa.Schema) -> DataFrame:
    """What ``compare`` yields for the cells of :func:`_blocks`: it gets the rows (key, label, payload) of the first
    side, those of the second side some at a time, and a dictionary that lasts for the cell."""
    group = ["bucket", "kind", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, memo = None, [], {}
        for batch in batches:
            for piece in slices(batch, 7):
                found, right = [], []
                for *at, side, key, label, held in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if at != now:
                        if left and right:
                            found += compare(now[0], left, right, memo)
                        now, left, right, memo = at, [], [], {}
                    (right if side else left).append((key, label, held))
                if left and right:
                    found += compare(now[0], left, right, memo)
                if found:
                    # Types are given, not inferred: a column may hold nothing but nulls.
                    columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    dealt = rows.select(*group, "side", "key", "label", payload).repartition(*group).sortWithinPartitions(*group, "side")
    return in_arrow(dealt, run, from_arrow_schema(schema))


def _alike(threshold: float):
    """Compares sketches: (bucket, x, y) of the pairs of different classes that may be close. Where there are more
    than PAIRS for a node of a cell's piece, (bucket, key, null) of their ends instead, so what is made stays
    in proportion to the rows."""

    def compare(bucket: int, left: list[tuple], right: list[tuple], memo: dict) -> list[tuple]:
        if "left" not in memo:
            memo["left"] = np.frombuffer(b"".join(r[2] for r in left), np.uint8).reshape(len(left), -1)
            memo["labels"], memo["sent"] = np.array([r[1] for r in left], object), set()
        a, labels = memo["left"], memo["labels"]
        least, pairs, ends = least_agreement(threshold, a.shape[1]), [], set()
        for key, label, sketch in right:
            near = (a == np.frombuffer(sketch, np.uint8)).sum(axis=1) >= least
            if near.any():
                others = np.flatnonzero(near & (labels != label))
                if len(others) > PAIRS:
                    ends.add(key)
                    ends.update(left[i][0] for i in others)
                else:
                    pairs += [(bucket, min(key, left[i][0]), max(key, left[i][0])) for i in others]
        new = ends - memo["sent"]
        memo["sent"] |= new
        return pairs + [(bucket, key, None) for key in sorted(new)]

    return compare


def _spanning(threshold: float):
    """Compares multisets: links that join all close pairs of different classes; pairs that earlier links of
    the cell have joined are left out."""

    def compare(bucket: int, left: list[tuple], right: list[tuple], above: dict) -> list[tuple]:
        def root(x: bytes) -> bytes:
            while x in above:
                x = above[x]
            return x

        found = []
        for i, j in zip(*close_pairs([r[2] for r in left], [r[2] for r in right], threshold), strict=True):
            x, y = root(left[i][1]), root(right[j][1])
            if x != y:
                above[max(x, y)] = min(x, y)
                found.append((min(left[i][0], right[j][0]), max(left[i][0], right[j][0])))
        return found

    return compare


def _complete(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (x, y) that join all close pairs of different classes that share a bucket. Hubs are left out: they
    were compared with all members of their buckets. Sketches tell which pairs may be close; where these are few
    for a node they are compared one by one, else all such nodes of a bucket in blocks."""
    named = members.filter("n > 2 AND key != hub").select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    split = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select(F.col("bucket").alias("b"))
    open_ = stored(named.join(split, F.col("bucket") == F.col("b"), "left_semi").select("bucket", "key", "label"), "split")
    if not open_.take(1):
        return open_.select(F.col("key").alias("x"), F.col("key").alias("y"))
    # Written once: the plan of the cells reads it several times.
    sized = stored(open_.join(nodes.select("key", "weight", "sketch"), "key"), "sized")
    cells = _blocks(sized, F.ceil(F.sum("n") / SKETCH_BLOCK).cast("int"))
    near = stored(_compared(cells, "sketch", _alike(threshold), _ALIKE), "alike")
    links = verified(near.filter("y IS NOT NULL").select("x", "y").distinct(), sets, threshold)
    dense = near.filter("y IS NULL").select("bucket", F.col("x").alias("key")).distinct()
    dense = stored(dense.join(sized.drop("sketch"), ["bucket", "key"]), "dense")
    if not dense.take(1):
        return links
    number = F.ceil(F.greatest(F.sum("n") / SET_BLOCK, F.sum("weight") / SET_REGIONS)).cast("int")
    cells = _blocks(dense, number, _among(sets, dense))
    found = _compared(cells, "regions", _spanning(threshold), _LINKS)
    return links.unionByName(stored(found.distinct(), "complete"))


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """key, bucket, hub (the bucket's smallest key) and n (its nodes) of the buckets that hold several nodes. Most hold
    one: the buckets' numbers alone are counted first, and of the rows only those of shared buckets move, by a bitmap,
    with few others."""
    buckets = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "shared")
    bits, size = bitmap_table(shared, F.col("bucket"), shared.count())
    asked = stored(maybe_among(buckets, F.col("bucket"), bits, size, "asked").filter("asked").select("key", "bucket"), "asked")
    hubs = asked.groupBy("bucket").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("bucket", "b")
    return stored(asked.join(hubs, F.col("bucket") == F.col("b")).drop("b"), "members")


def near_classes(docs: DataFrame, id_col="doc_id", text_col="text", threshold=THRESHOLD, k=K, rows=ROWS, bands=BANDS) -> DataFrame:
    """One row for each input row: id, class_id (the smallest id in its class), class_size, copies (rows
    with an equal multiset), digest (MD5 of the text) and kept (it is the class's row with the smallest id, of equal
    ids that with the smallest digest)."""
    signed = stored(signatures(docs, id_col, text_col, k, rows, bands), "signatures")
    found = signed.filter("key IS NOT NULL")
    # Equal multisets have equal bands and sketches: any of the rows speaks for the node.
    any_of = [F.first(c).alias(c) for c in ("weight", "bands", "sketch")]
    nodes = stored(found.groupBy("key").agg(F.min(F.struct("id", "digest")).alias("first"), F.count(F.lit(1)).alias("copies"), *any_of), "nodes")
    members = shared_buckets(nodes)
    shared = stored(_among(nodes.select("key", "weight", "sketch"), members), "shared-nodes")
    pairs = members.filter("key != hub").select(F.col("hub").alias("x"), F.col("key").alias("y")).distinct()
    candidates = stored(likely(pairs, shared, threshold), "candidates")
    # The one further pass over the texts: multisets of all nodes that share a bucket.
    sets = multisets(docs, text_col, members.select("key").distinct()).groupBy("key").agg(F.first("regions").alias("regions"))
    sets = stored(sets, "sets")
    first = stored(candidates.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "first")
    links = verified(first, sets, threshold)
    labels = stored(components(links), "labels")
    l1, l2 = labels.toDF("x", "lx"), labels.toDF("y", "ly")
    apart = candidates.join(first, ["x", "y"], "left_anti").join(l1, "x", "left").join(l2, "y", "left")
    apart = apart.filter(F.coalesce("lx", "x") != F.coalesce("ly", "y")).select("x", "y")
    links = links.unionByName(verified(apart, sets, threshold))
    labels = stored(components(links), "labels")
    more = _complete(members, labels, shared, sets, threshold)
    if more.take(1):
        labels = stored(components(links.unionByName(more)), "labels")
    node = nodes.select("key", "first", "copies").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    classes = node.groupBy("label").agg(F.min("first").alias("chief"), F.sum("copies").alias("class_size"))
    node = stored(node.join(classes, "label").select(F.col("key").alias("k"), "chief", "class_size", "copies"), "classes")
    out = signed.select("id", "digest", "key").join(node, F.col("key") == F.col("k"), "left")
    none = F.col("key").isNull()
    one = F.lit(1).cast("long")
    return out.select(
        "id",
        F.when(none, F.col("id")).otherwise(F.col("chief.id")).alias("class_id"),
        F.when(none, one).otherwise(F.col("class_size")).alias("class_size"),
        F.when(none, one).otherwise(F.col("copies")).alias("copies"),
        "digest",
        (none | (F.col("id").eqNullSafe(F.col("chief.id")) & (F.col("digest") == F.col("chief.digest")))).alias("kept"),
    )


def near_dedup(docs: DataFrame, id_col="doc_id", text_col="text", **params) -> DataFrame:
    """``docs`` with one document of each class, with its own columns. Rows equal in id and text count once. Only
    rows that may be dropped, by a bitmap of those that are, move through a shuffle; the others stay where they are."""
    own, flag, c, g, n = fresh(docs, "near_own", "near_flag", "near_id", "near_digest", "near_turn")
    decided = near_classes(docs, id_col, text_col, **params).groupBy("id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    decided = stored(decided, "decided")
    doubtful = decided.filter("n > 1 OR NOT kept")
    bits, size = bitmap_table(doubtful, F.xxhash64("id", "digest"), doubtful.count())
    rows = docs.withColumn(own, digest_of(text_col))
    rows = maybe_among(rows, F.xxhash64(id_col, own), bits, size, flag)
    kept = decided.filter("kept").select(F.col("id").alias(c), F.col("digest").alias(g))
    met = rows.filter(flag)
    met = met.join(kept, met[id_col].eqNullSafe(kept[c]) & (met[own] == kept[g]), "left_semi")
    met = met.withColumn(n, F.row_number().over(Window.partitionBy(id_col, own).orderBy(F.lit(1)))).filter(F.col(n) == 1)
    return rows.filter(~F.col(flag)).select(*docs.columns).unionByName(met.select(*docs.columns))


def op7_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("digest")
