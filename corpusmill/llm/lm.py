"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

The model predicts a token from the ``lags`` tokens before it, together:

    h = sum_i C_i * r(w_i)          (diagonal position matrices)
    P(w | h) = P(top(w) | h) P(group(w) | top(w), h) P(w | group(w), h),

each a softmax of h . q_x + b_x over the members x of one node of a tree of three levels.

Word counts are exact and cover all training documents. The words with vectors of their own are the most frequent
ones; their number grows with the tokens N of the corpus as ``own`` * N^(1/3), so that the model
grows and can still be sent to every worker (100 TB make about a million). Every other word has the vectors of one of
``suffixes`` hashes of its last three bytes, and its smoothed share of that class: within a class a word has
(count + 0.5) / (the class's count + 0.5 (kinds + 1)). So the probabilities of all words, with one unseen word a class,
add up to one. Nodes have about the cube root of all words as members, words in order of frequency, so a token's
normalised log-probability takes three short rows of scores; those of a batch are matrix products, one a node.

Training is stochastic gradient ascent of the contrastive objective at each level, against noise from the node's
unigram distribution: noise-contrastive estimation with ``NOISE`` samples a token, in the limit of their expectation,

    J = log sig(d_w) + NOISE sum_x p(x) log sig(-d_x),   d_x = h . q_x + b_x - log(NOISE p(x)).

Every training document is visited, in ``rounds`` rounds of documents: a task trains a copy of the parameters on its
documents of the round, and the changes of each row are averaged over tasks, weighted by the times that the task moved
it. Every token of a document is a target, and a context of those after it. Where there are fewer than ``visits`` tokens, a
task visits its slices more than once. For given partitions of the input the result is reproducible.

The counts of the ``local_words`` most frequent words are broadcast, a bounded table which changes speed only; the other
words of a document meet their counts in an ordinary join.

Cases: null text counts as empty: one token, the end. A null id is trained on. Without training
documents every count is 0 and the base score is log10(0.5/0.5) = 0 a token. Repeated rows count each. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frequent, slices, stored, table

OWN, SUFFIXES, DIM, LAGS, ROUNDS, VISITS = 25, 256, 32, 2, 4, 4_000_000
#: Noise samples of a token, tokens of a batch, step size.
NOISE, BATCH, RATE = 10, 8192, 0.1
LOCAL_WORDS = 1 << 16
#: Tokens of a slice, tokens that are scored and bytes of text that are counted at a time.
SLICE_TOKENS, SCORED_TOKENS, COUNT_BYTES = 1 << 18, 1 << 16, 1 << 23
END = b" end"  # holds a space, so no word equals it


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (binary), A-Z in lower case, and their number in each text. Arrow's ASCII white space is
    exactly the contract's."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)
    ends = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return words.filter(real), np.diff(ends[offsets])


def word_counts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """word (binary), n over the training documents, the ends of texts included; tasks send sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            for part in slices(batch, 0, COUNT_BYTES, 1 << 20):
                ends += part.num_rows
                found = words_of(part.column(0))[0].value_counts()
                if len(found):
                    yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], names=["word", "n"])
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([ends], pa.int64())], names=["word", "n"])

    texts = docs.filter(~held_out(id_col)).select(F.col(text_col))
    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_class(word: bytes, suffixes: int) -> int:
    return zlib.crc32(word[-3:]) % suffixes


@dataclass
class Vocabulary:
    """``local`` words, their leaf, log10(count + 0.5) and whether training has them; the leaf of each suffix class;
    the leaves' counts, in descending order. The tree has ``width`` members a node, hence width**3 places for leaves."""

    local: pa.Array
    leaf: np.ndarray
    logs: np.ndarray
    counted: np.ndarray
    classes: np.ndarray
    sizes: np.ndarray
    inside: np.ndarray  # of each leaf, log10 of a class's denominator; 0 for a word of its own

    @property
    def width(self) -> int:
        width = 2
        while width**3 < len(self.sizes):
            width += 1
        return width

    def shares(self) -> dict[str, np.ndarray]:
        """Unigram share of each member in its node, by level; 0 for places without words."""
        w = self.width
        leaf = np.zeros(w**3)
        leaf[: len(self.sizes)] = self.sizes / self.sizes.sum()
        group = leaf.reshape(-1, w).sum(axis=1)
        top = group.reshape(-1, w).sum(axis=1)
        within = lambda x, whole: x / np.repeat(np.where(whole > 0, whole, 1.0), w)
        return {"top": top, "group": within(group, top), "leaf": within(leaf, group)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(leaves, numbers of local words or -1, tokens of each text, the words that are not local, the text of
        each of these); every text's last token is its end."""
        words, n = words_of(texts)
        inner = pc.fill_null(pc.index_in(words, value_set=self.local), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(n)), n)
        number = np.empty(len(inner) + len(n), np.int64)
        number[np.arange(len(inner)) + text] = inner
        number[np.cumsum(n + 1) - 1] = self.end
        leaf = self.leaf[number]
        far = np.flatnonzero(inner < 0)
        rare = words.take(pa.array(far)).to_pylist()
        if rare:
            leaf[far + text[far]] = self.classes[[suffix_class(w, len(self.classes)) for w in rare]]
        return leaf, number, n + 1, rare, text[far]

    @property
    def end(self) -> int:
        return len(self.local) - 1


#: The tables of parameters: vectors of contexts, position matrices, and vectors with biases of the three levels.
_LEVELS = ("top", "group", "leaf")
_NAMES = ("r", "c", *_LEVELS)
#: Bias of places without words: their probability is 0.
_NEVER = -1e4


def with_starts(leaves: np.ndarray, n: np.ndarray, lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """``leaves`` with ``lags`` start marks before each text of ``n`` tokens, and the tokens' places among them."""
    places = np.arange(len(leaves)) + lags * np.repeat(np.arange(1, len(n) + 1), n)
    out = np.full(len(leaves) + lags * len(n), start, leaves.dtype)
    out[places] = leaves
    return out, places


@dataclass
class Parameters:
    """Tables by name, r with the start mark last, levels with their biases as last columns; and by table the sums of
    squares by which steps are scaled, one a row."""

    table: dict[str, np.ndarray]
    scale: dict[str, np.ndarray]

    @staticmethod
    def start(v: Vocabulary, dim: int, lags: int, seed: int = 5) -> Parameters:
        rng = np.random.default_rng(seed)
        made = {"r": rng.normal(0, 0.3, (len(v.sizes) + 1, dim)), "c": np.repeat(1.0 / np.arange(1, lags + 1), dim).reshape(lags, dim)}
        for name, share in v.shares().items():
            made[name] = np.column_stack((rng.normal(0, 0.1, (len(share), dim)), np.where(share > 0, np.log(np.maximum(share, 1e-300)), _NEVER)))
        made = {k: x.astype(np.float32) for k, x in made.items()}
        return Parameters(made, {k: np.full(len(x), 1e-3, np.float32) for k, x in made.items()})

    def copy(self) -> Parameters:
        return Parameters({k: x.copy() for k, x in self.table.items()}, {k: x.copy() for k, x in self.scale.items()})

    def contexts(self, leaves: np.ndarray, at: np.ndarray) -> np.ndarray:
        """h of the places ``at``, with a last column of ones for the biases."""
        r, c = self.table["r"], self.table["c"]
        h = np.ones((len(at), r.shape[1] + 1), np.float32)
        for i, x in enumerate(c):
            part = np.take(r, leaves[at - 1 - i], axis=0)
            part *= x
            h[:, :-1] = part if not i else np.add(h[:, :-1], part, out=part)
        return h

    def levels(self, target: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
        """(level, node of each target, member among its node of each target, (node, first row, last row + 1) of the
        nodes with targets) for the ascending leaves ``target``."""
        w = len(self.table["top"])
        for name, down in zip(_LEVELS, (w * w, w, 1), strict=True):
            place = target // down
            node = place // w
            first = np.flatnonzero(np.diff(node, prepend=-1))
            edges = [*first.tolist(), len(node)]
            yield name, node, place - node * w, list(zip(node[first].tolist(), edges[:-1], edges[1:], strict=True))

    def scores(self, name: str, h: np.ndarray, nodes: list[tuple[int, int, int]]) -> np.ndarray:
        """h . q + b of every row with the members of its node."""
        w = len(self.table["top"])
        q = self.table[name].reshape(-1, w, h.shape[1])
        out = np.empty((len(h), w), np.float32)
        for node, lo, hi in nodes:
            np.dot(h[lo:hi], q[node].T, out=out[lo:hi])
        return out

    def log_probabilities(self, leaves: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log-probability of the leaves at the places ``at``, given those before them."""
        order = _ascending(leaves[at])
        at = at[order]
        h, target = self.contexts(leaves, at), leaves[at]
        found = np.zeros(len(at), np.float32)
        for name, _, own, nodes in self.levels(target):
            s = self.scores(name, h, nodes)
            found += s[np.arange(len(s)), own]
            if len(s) and s.max() > 60:  # else exponentials stay in range as they are
                top = s.max(axis=1, keepdims=True)
                s -= top
                found -= top[:, 0]
            np.exp(s, out=s)
            found -= np.log(s @ np.ones(s.shape[1], np.float32))
        out = np.empty_like(found)
        out[order] = found
        return out


def _ascending(leaves: np.ndarray) -> np.ndarray:
    """Stable order of leaves; numpy sorts short numbers by radix."""
    short = len(leaves) and leaves.max() < 1 << 16
    return np.argsort(leaves.astype(np.uint16) if short else leaves, kind="stable")


class Trainer:
    """Trains a copy of the parameters and knows how often each row was moved."""

    def __init__(self, v: Vocabulary, p: Parameters, rate: float, seed: int):
        self.rate, self.rng, self.p, self.width = rate, np.random.default_rng(seed), p.copy(), v.width
        self.moved = {k: np.zeros(len(x), np.int64) for k, x in p.scale.items()}
        shares = v.shares()
        self.against = {k: (-NOISE * x).astype(np.float32).reshape(-1, v.width) for k, x in shares.items()}
        self.shift = {k: np.where(x < 0, np.log(np.maximum(-x, 1e-30)), 0) for k, x in self.against.items()}

    def _step(self, name: str, at, grads: np.ndarray, n) -> None:
        """Moves the rows ``at``, or the rows of the nodes ``at`` where ``grads`` (used up) has a matrix for each."""
        scale, moved = (x[name].reshape(-1, *grads.shape[1:-1]) for x in (self.p.scale, self.moved))
        new = scale[at] + np.einsum("...j,...j->...", grads, grads) / np.float32(grads.shape[-1])
        scale[at] = new
        grads *= (self.rate / np.sqrt(new))[..., None]
        self.p.table[name].reshape(-1, *grads.shape[1:])[at] += grads
        moved[at] += n

    def visit(self, leaves: np.ndarray, places: np.ndarray) -> None:
        places = self.rng.permutation(places)
        for start in range(0, len(places), BATCH):
            self._batch(leaves, places[start : start + BATCH])

    def _batch(self, leaves: np.ndarray, at: np.ndarray) -> None:
        p, w = self.p, self.width
        at = at[_ascending(leaves[at])]
        h, target = p.contexts(leaves, at), leaves[at]
        gh, part = np.zeros_like(h), np.empty_like(h)
        steps = []
        for name, node, own, nodes in p.levels(target):
            g = p.scores(name, h, nodes)
            np.subtract(np.take(self.shift[name], node, axis=0), g, out=g)
            _sigmoid_of_negative(g)
            flat, hit = g.reshape(-1), np.arange(len(own)) * w + own
            up = 1 - flat[hit]
            g *= np.take(self.against[name], node, axis=0)
            flat[hit] += up
            q = p.table[name].reshape(-1, w, h.shape[1])
            made = np.empty((len(nodes), *q.shape[1:]), np.float32)
            for k, (m, lo, hi) in enumerate(nodes):
                np.dot(g[lo:hi], q[m], out=part[lo:hi])
                np.dot(g[lo:hi].T, h[lo:hi], out=made[k])
            gh += part
            members = np.array([m for m, _, _ in nodes])
            times = np.bincount(node * w + own, minlength=len(q) * w).reshape(-1, w)[members]
            steps.append((name, members, made, np.maximum(times, 1)))
        gh = np.ascontiguousarray(gh[:, :-1])
        context, c = p.table["r"], p.table["c"]
        before = [leaves[at - 1 - i] for i in range(len(c))]
        gc = np.stack([np.einsum("ij,ij->j", gh, np.take(context, b, axis=0)) for b in before])
        flat = np.concatenate(before)
        times = np.bincount(flat, minlength=len(context))
        rows = np.flatnonzero(times)
        # Sums of each row's gradients, by one count over (row, dimension).
        place, dim = np.cumsum(times > 0) - 1, gh.shape[1]
        cells = (place[flat] * dim)[:, None] + np.arange(dim)
        gr = np.bincount(cells.reshape(-1), np.concatenate([gh * x for x in c]).reshape(-1), len(rows) * dim).reshape(-1, dim).astype(np.float32)
        # All gradients are taken at the parameters before the step.
        for step in steps:
            self._step(*step)
        self._step("c", slice(None), gc, len(at))
        self._step("r", rows, gr, times[rows])


def _sigmoid_of_negative(x: np.ndarray) -> None:
    """In place; beyond the range of exponentials it is 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


_CHANGES = "name string, row long, n long, change binary"


def _train_round(encoded: DataFrame, v, p: Parameters, number: int, rounds: int, repeats: int, rate: float) -> Parameters:
    """The parameters after a round. Tasks send the rows that they moved; these are averaged by executors, and the
    rows of the model come to the driver."""
    shared = encoded.sparkSession.sparkContext.broadcast(p)
    lags = len(p.table["c"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for batch in batches:
            for part in slices(batch, 0, 4 * SLICE_TOKENS, 1 << 16):
                texts = part.column(0).to_pylist()
                if trainer is None:
                    trainer = Trainer(v.value, shared.value, rate, zlib.crc32(texts[0]) + number)
                n = np.array([len(x) // 4 for x in texts])
                leaves, places = with_starts(np.frombuffer(b"".join(texts), np.int32), n, lags, len(v.value.sizes))
                for _ in range(repeats):
                    trainer.visit(leaves, places)
        if trainer is None:
            return
        for name in _NAMES:
            moved = np.flatnonzero(trainer.moved[name])
            old, new = shared.value, trainer.p
            change = np.column_stack((new.table[name][moved] - old.table[name][moved], new.scale[name][moved] - old.scale[name][moved])).astype(np.float32)
            for start in range(0, len(moved), 4096):
                at = slice(start, start + 4096)
                yield _changes(name, moved[at], trainer.moved[name][moved[at]], change[at])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        for batch in batches:
            for name, row, n, change in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(change, np.float32).astype(np.float64) * n
                own = held.get((name, row))
                if own is None:
                    held[name, row] = [n, x]
                else:
                    own[0] += n
                    own[1] += x
        for name in _NAMES:
            rows = [(row, n, x / n) for (k, row), (n, x) in held.items() if k == name]
            for start in range(0, len(rows), 4096):
                row, n, x = zip(*rows[start : start + 4096], strict=True)
                yield _changes(name, np.array(row), np.array(n), np.array(x, np.float32))

    chosen = encoded.filter(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == number))
    sent = chosen.select("leaves").mapInArrow(learn, _CHANGES)
    found = stored(sent.repartition("name", "row").mapInArrow(average, _CHANGES), "round")
    out = p.copy()
    for r in found.toLocalIterator():
        change = np.frombuffer(bytes(r["change"]), np.float32)
        out.table[r["name"]][r["row"]] += change[:-1]
        out.scale[r["name"]][r["row"]] += change[-1]
    shared.unpersist()
    return out


def _changes(name: str, rows: np.ndarray, n: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([name] * len(rows)), pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in change], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["name", "row", "n", "change"])


def build_vocabulary(counts: DataFrame, total: int, own: float, suffixes: int, local_words: int) -> Vocabulary:
    """The vocabulary of a table of word counts. The rows that come to the driver are as many as the model's words."""
    wanted = max(1, math.ceil(own * total ** (1 / 3)))
    near = {bytes(r.word): r.n for r in frequent(counts, max(local_words, wanted)).toLocalIterator()}
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    near[END] = ends.n if ends else 0
    ranked = sorted(near.keys() - {END}, key=lambda w: (-near[w], w))
    mine = {*ranked[:wanted], END}
    ranked.append(END)  # a number of its own that no word of a text is looked up as

    def classes(batches):
        n, kinds = np.zeros(suffixes, np.int64), np.zeros(suffixes, np.int64)
        for batch in batches:
            at = [suffix_class(w, suffixes) for w in batch.column(0).to_pylist()]
            np.add.at(n, at, batch.column(1).to_numpy())
            np.add.at(kinds, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(suffixes)), pa.array(n), pa.array(kinds)], names=["c", "n", "kinds"])

    n, kinds = np.zeros(suffixes, np.int64), np.zeros(suffixes, np.int64)
    for r in counts.select("word", "n").mapInArrow(classes, "c long, n long, kinds long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        n[r.c], kinds[r.c] = r.n, r.kinds
    for w in mine:
        if near[w]:
            n[suffix_class(w, suffixes)] -= near[w]
            kinds[suffix_class(w, suffixes)] -= 1
    leaves = [(-near[w], 0, w) for w in mine] + [(-int(x), 1, i) for i, x in enumerate(n)]
    leaves.sort(key=lambda x: (x[0], x[1], str(x[2])))
    place = {x[1:]: i for i, x in enumerate(leaves)}
    of_class = np.array([place[1, i] for i in range(suffixes)])
    inside = np.zeros(len(leaves))
    inside[of_class] = np.log10(n + 0.5 * (kinds + 1))
    leaf = np.array([place[0, w] if w in mine else of_class[suffix_class(w, suffixes)] for w in ranked])
    sizes = np.array([-x[0] for x in leaves], float) + 0.5
    found = np.array([near[w] for w in ranked], float)
    return Vocabulary(pa.array(ranked, pa.binary()), leaf.astype(np.int32), np.log10(found + 0.5), found > 0, of_class.astype(np.int32), sizes, inside)


def learn_counts(docs: DataFrame, id_col="doc_id", text_col="text", own=OWN, suffixes=SUFFIXES, local_words=LOCAL_WORDS) -> tuple[Vocabulary, DataFrame, int, int]:
    """The vocabulary, the table of word counts, their sum and number."""
    counts = stored(word_counts(docs, id_col, text_col), "counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    return build_vocabulary(counts, sums.n, own, suffixes, local_words), counts, sums.n, sums.v


_ENCODED = "row long, id {id}, held_out boolean, n_tokens long, n_known long, counted double, share double, leaves binary, word binary, times long"


def encode(docs: DataFrame, vocabulary, id_col="doc_id", text_col="text") -> DataFrame:
    """A row for each document: its leaves, numbers of tokens and of known ones, the sum of log10(count + 0.5), and that of
    its words' shares of their classes; of words that are not local both sums lack log10(count + 0.5). And a row
    (row, word, times) for each such word of each document."""
    schema = _ENCODED.format(id=docs.schema[id_col].dataType.simpleString())
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        is_class = np.zeros(len(v.sizes), bool)
        is_class[v.classes] = True
        for batch in batches:
            for part in slices(batch, 3, 4 * SLICE_TOKENS, 1 << 16):
                leaves, number, n, rare, text = v.encode(part.column(3))
                counted = np.where(number >= 0, v.logs[number], 0.0)
                share = np.where(is_class[leaves], counted - v.inside[leaves], 0.0)
                starts = np.cumsum(n) - n
                known = np.add.reduceat(((number >= 0) & v.counted[number]).astype(np.int64), starts)
                held = Counter(zip(part.column(0).to_numpy()[text].tolist(), rare, strict=True))
                k, extra = part.num_rows, len(held)
                raw = leaves.astype(np.int32).tobytes()
                cuts = (4 * np.append(starts, len(leaves))).tolist()
                docs_ = [part.column(1), part.column(2), pa.array(n), pa.array(known), *(pa.array(np.add.reduceat(x, starts)) for x in (counted, share)), pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())]
                columns = [pa.concat_arrays([part.column(0), pa.array([r for r, _ in held], pa.int64())])]
                columns += [pa.concat_arrays([c, pa.nulls(extra, c.type)]) for c in docs_]
                columns += [pa.concat_arrays([pa.nulls(k, x.type), x]) for x in (pa.array([w for _, w in held], pa.binary()), pa.array(list(held.values()), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def train(encoded: DataFrame, vocabulary: Vocabulary, total: int, dim=DIM, lags=LAGS, rounds=ROUNDS, visits=VISITS, rate=RATE) -> Parameters:
    """Parameters fitted on the training documents of :func:`encode`; ``total`` is their number of tokens."""
    p = Parameters.start(vocabulary, dim, lags)
    if total:
        shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
        repeats = max(1, min(16, visits // total))
        for number in range(rounds):
            p = _train_round(encoded, shared, p, number, rounds, repeats, rate)
    return p


def score(docs: DataFrame, id_col="doc_id", text_col="text", own=OWN, suffixes=SUFFIXES, local_words=LOCAL_WORDS, **training) -> DataFrame:
    """One row for each input row: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    vocabulary, counts, total, distinct = learn_counts(docs, id_col, text_col, own, suffixes, local_words)
    base = math.log10(total + 0.5 * (distinct + 1))
    made = stored(encode(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "encoded")
    encoded = made.filter("word IS NULL")
    model = spark.sparkContext.broadcast(train(encoded, vocabulary, total, **training))
    start = len(vocabulary.sizes)
    kept = ("row", "id", "held_out", "n_tokens", "n_known", "counted")
    schema = ", ".join(f for f in _ENCODED.format(id=docs.schema[id_col].dataType.simpleString()).split(", ") if f.split()[0] in kept) + ", modelled double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            for part in slices(batch, len(kept) + 1, 4 * SLICE_TOKENS, 1 << 16):
                n = part.column(3).to_numpy()
                leaves, at = with_starts(np.frombuffer(b"".join(part.column(len(kept) + 1).to_pylist()), np.int32), n, len(p.table["c"]), start)
                logs = np.concatenate([p.log_probabilities(leaves, at[i : i + SCORED_TOKENS]) for i in range(0, len(at), SCORED_TOKENS)])
                sums = np.add.reduceat(logs.astype(np.float64), np.cumsum(n) - n) / math.log(10) + part.column(len(kept)).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(sums)], names=[*kept, "modelled"])

    scored = encoded.select(*kept, "share", "leaves").mapInArrow(run, schema)
    # The words that are not local, with their counts; 0 where training has none.
    asked = made.filter("word IS NOT NULL").select("row", "word", "times")
    met = asked.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    added = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known")
    ).withColumnRenamed("row", "r")
    out = scored.join(added, F.col("row") == F.col("r"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("modelled") + more).alias("score"),
    )


def op3_lm_scores(spark, sf_dir):
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
