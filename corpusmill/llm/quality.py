"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is rated 0, 1 or 2: one point for good quality, one for not being toxic. One weight
vector over hashed text features is shared by all thresholds,

    P(grade > j) = sigma(w . x - t_j),  t_0 < t_1,

so the model gives an expected grade and tail probabilities; documents are selected by the tail
probability of the top grade. Features are the distinct words (ASCII letters lower-cased, without the signs around them), their shapes -
runs of letters, digits and single signs - and coarse bins of repetition and length, hashed to 2**``bits``
places; of each only the presence counts. The model is fitted in numpy by Adam on at most ``max_rows``
rated documents, those with the smallest hashes of their ids; scoring covers every document.

Cases: null text counts as empty. Ratings with a null in either column, or without a document, are not
used; several ratings of a document count each. Without any ratings every document gets the top grade.
Repeated rows are scored alike. An empty table gives an empty result. Extra columns are ignored by
:func:`grade_documents` and kept by :func:`select_documents`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_arrow, slices, stored, table

BITS, MAX_ROWS, STEPS, RATE, DECAY, LEAST = 18, 16_384, 200, 0.05, 1e-3, 8
GRADES = 3
KEEP_FROM = 0.5
_SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
#: Signs around a word that its feature leaves out; its shape keeps them.
_EDGES = b".,;:!?\"'()[]"
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def _hash(token: bytes, bits: int) -> int:
    return zlib.crc32(token) & ((1 << bits) - 1)


class Features:
    """Feature places of texts. Words' places are remembered while they are few."""

    def __init__(self, bits: int = BITS):
        self.bits, self.words, self.shapes = bits, {}, {}

    def _word(self, w: bytes) -> int:
        if len(self.words) > 60_000:
            self.words.clear()
        h = self.words[w] = _hash(b"w" + w.lower().strip(_EDGES), self.bits)
        return h

    def _shape(self, w: bytes) -> int:
        if len(self.shapes) > 60_000:
            self.shapes.clear()
        h = self.shapes[w] = _hash(b"s" + _RUNS.sub(rb"\1", w.translate(_SHAPE)), self.bits)
        return h

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.split() if text else []
        distinct = set(words)
        w, s = self.words, self.shapes
        places = {w[x] if x in w else self._word(x) for x in distinct}
        shapes: dict[int, int] = {}
        for x in distinct:
            h = s[x] if x in s else self._shape(x)
            shapes[h] = shapes.get(h, 0) + 1
        # A shape says more the larger its part of the words is.
        for h, n in shapes.items():
            places.add(_hash(b"S%d:%d" % (h, (10 * n) // len(distinct)), self.bits))
        places.update(shapes)
        lines = [x for x in (text or b"").split(b"\n") if x.strip()]
        for name, part, whole in ((b"d", len(distinct), len(words)), (b"l", len(set(lines)), len(lines))):
            places.add(_hash(b"%s%d" % (name, 20 * part // whole if whole else -1), self.bits))
        places.add(_hash(b"n%d" % len(words).bit_length(), self.bits))
        return np.fromiter(places, np.int32, len(places))


@dataclass
class Ordinal:
    """weights (one for each place), thresholds (ascending) and bits."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, places: list[np.ndarray]) -> np.ndarray:
        """P(grade > j) for j = 0, 1, ... of each text."""
        sizes = np.array([len(p) for p in places])
        flat = np.concatenate(places) if len(places) else np.zeros(0, np.int32)
        if not len(flat):
            return np.zeros((len(places), len(self.thresholds)))
        score = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score[:, None], -40, 40)))


def train(places: list[np.ndarray], grades: np.ndarray, bits=BITS, steps=STEPS, rate=RATE, decay=DECAY, least=LEAST) -> Ordinal:
    """Maximum likelihood with weight decay. Places that occur in fewer than ``least`` documents weigh 0."""
    cuts = GRADES - 1
    if not len(places):
        return Ordinal(np.zeros(1 << bits), np.array([-20.0] * cuts), bits)
    size = 1 << bits
    n = len(places)
    row = np.repeat(np.arange(n), [len(p) for p in places])
    flat = np.concatenate(places)
    frequent = np.bincount(flat, minlength=size)[flat] >= least
    row, flat = row[frequent], flat[frequent]
    weights = np.zeros(size)
    above = (grades[:, None] > np.arange(cuts)).mean(axis=0).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - above) / above)
    # Thresholds stay in order: the first one, and logs of the steps to the next ones.
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    mw, vw, mt, vt = np.zeros(size), np.zeros(size), np.zeros(cuts), np.zeros(cuts)
    for step in range(1, steps + 1):
        t = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
        score = np.bincount(row, weights[flat], minlength=n)
        # Above each threshold: 1 for the grades below it, 0 at the top.
        p = np.concatenate((np.ones((n, 1)), 1.0 / (1.0 + np.exp(np.clip(t - score[:, None], -30, 30))), np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        hi, lo = p[at, grades], p[at, grades + 1]
        chance = np.maximum(hi - lo, 1e-9)
        # d log chance / d score, and / d t_j for the two thresholds beside the grade.
        dhi, dlo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
        gw = np.bincount(flat, (dhi - dlo)[row], minlength=size) / n - decay * weights
        gt = (np.bincount(grades, -dhi, minlength=cuts + 1)[1:] + np.bincount(grades, dlo, minlength=cuts + 1)[:cuts]) / n
        gf = np.concatenate(([gt.sum()], [gt[j:].sum() * np.exp(free[j]) for j in range(1, cuts)]))
        for x, g, m, v in ((weights, gw, mw, vw), (free, gf, mt, vt)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    t = free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))
    return Ordinal(weights.astype(np.float64), t, bits)


def graded(labels: DataFrame, id_col="doc_id") -> DataFrame:
    """rated (id) and grade: one point for quality, one for not being toxic."""
    good = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    grade = F.when(F.col("quality") > 0, 1).otherwise(0) + F.when(F.col("toxic") > 0, 0).otherwise(1)
    return labels.filter(good).select(F.col(id_col).alias("rated"), grade.alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, id_col="doc_id", text_col="text", max_rows=MAX_ROWS, bits=BITS, **params) -> Ordinal:
    """Fit on ``ratings`` (rated, grade), bounded by ``max_rows`` rows; features are made by executors."""
    chosen = ratings.orderBy(F.xxhash64(F.col("rated").cast("string")), "rated", "grade").limit(max_rows)
    chosen = stored(chosen, "ratings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits)
        for batch in batches:
            for part in slices(batch, 2):
                raw = [np.sort(features(t)).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], names=["rated", "grade", "places"])

    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    # At most max_rows rows, hence a proven bound for the broadcast.
    rated = texts.join(F.broadcast(chosen), texts["id"] == chosen["rated"]).select("rated", "grade", "text")
    id_type = ratings.schema["rated"].dataType.simpleString()
    made = stored(in_arrow(rated, run, f"rated {id_type}, grade int, places binary"), "features")
    # Repeated documents could exceed the bound; the fit takes the first max_rows again, in the same order.
    order = F.xxhash64(F.col("rated").cast("string"))
    rows = sorted(((str(r.rated), r.grade, bytes(r.places)) for r in made.orderBy(order, "rated", "grade", "places").limit(max_rows).toLocalIterator()))
    return train([np.frombuffer(p, np.int32) for _, _, p in rows], np.array([g for _, g, _ in rows], int), bits, **params)


def grade_documents(docs: DataFrame, model: Ordinal, id_col="doc_id", text_col="text", keep_from=KEEP_FROM) -> DataFrame:
    """One row for each input row: id, expected_grade, tail_1 and tail_2 (P(grade >= 1), P(grade >= 2)) and
    kept (tail_2 >= keep_from)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value.bits)
        for batch in batches:
            for part in slices(batch, 1):
                tails = shared.value.tails([features(t) for t in part.column(1).to_pylist()])
                columns = [pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, 1] >= keep_from)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "expected_grade", "tail_1", "tail_2", "kept"])

    texts = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return in_arrow(texts, run, f"id {id_type}, expected_grade double, tail_1 double, tail_2 double, kept boolean")


def select_documents(docs: DataFrame, model: Ordinal, text_col="text", keep_from=KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` whose chance of the top grade reaches ``keep_from``, with its own columns, in one
    pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, (name,) = docs.schema, fresh(docs, "quality_utf8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value.bits)
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                tails = shared.value.tails([features(t) for t in part.column(last).to_pylist()])
                yield part.select(range(last)).filter(pa.array(tails[:, 1] >= keep_from))

    return in_arrow(docs.withColumn(name, F.encode(F.col(text_col), "UTF-8")), run, schema)


def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, graded(table(spark, sf_dir, "labels")))
    return grade_documents(docs, model).withColumnRenamed("id", "doc_id")
