"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding follows the merge-type model of a public vocabulary: characters start as symbols, an agenda holds
every pair of neighbours whose union is a piece, best score and then leftmost first, and merges run until
the agenda is empty. With dropout each candidate that comes up is skipped by its own chance, drawn from the
seed, the document's id and the word's position in it; hence every occurrence of a word is segmented on its
own, and all repeats exactly for the same seed. How many candidates pass until the next skip is geometric: an
occurrence whose first skip lies beyond the word's merges takes the undropped form, which is remembered; the others
are merged one by one, many side by side in numpy. Characters that
are no piece become byte pieces, also the space mark itself where a text holds it, so that decoding gives
back every text exactly.

Texts are cut into words where no merge can reach across: before a space mark, around a newline, and between a
letter or digit and a punctuation mark that no piece has in this order, all read off the vocabulary. Cutting there
changes no segmentation. With dropout 0 the result is that of the vocabulary's own library.

Cases: null text counts as empty and has no pieces. Texts of any length are encoded whole. A null id draws
like an empty one. Repeated rows encode alike, unless a column numbers the copies. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED, REMEMBER = 0.1, 17, 100_000
MARK = "▁"
#: Stands for a space mark that the text itself holds; a lone surrogate, which no text can hold.
OWN_MARK = "\udc81"
#: Words longer than this keep their agenda in a heap instead of a list, and their forms are not remembered.
LONG = 48
#: Cells of the tables in which words are merged side by side; the rank of what is no piece.
CELLS, NEVER = 1 << 17, (1 << 31) - 1
#: Slots of the table of pairs, as a power of two.
SLOT_BITS = 19
#: The skip hash works on 30 bits, which Python multiplies fast.
_ODD, _PLACE, _BITS = 0x2C1B3C6D, 0x165667B1, 30
_MASK = (1 << _BITS) - 1
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


class Vocabulary:
    """Pieces and ranks of a model: a file's path, or its bytes."""

    def __init__(self, model: str | bytes = VOCABULARY):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(**({"model_file": model} if isinstance(model, str) else {"model_proto": model}))
        ids = range(sp.get_piece_size())
        self.unknown = sp.unk_id()
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        back = {i: p.replace(MARK, " ").encode() for p, i in self.id.items()}
        self.bytes = [back.get(i, b"") for i in ids]
        for value, i in self.byte.items():
            self.bytes[i] = bytes([value])
        self.binary = pa.array(self.bytes, pa.large_binary())
        if len(self.byte) != 256:
            raise ValueError("lossless encoding needs a vocabulary with all byte pieces")
        self.cost = {p: -s for p, s in self.score.items()}
        #: A fixed random number for each piece, part of the skip decision's key.
        self.salt = {p: xxhash.xxh64_intdigest(p.encode(), 3) & _MASK for p in self.id}
        self.words = self._cuts()
        self._tables()

    def _tables(self) -> None:
        """Numbers the symbols, pieces and the characters in them, from 1; 0 is any other character. ``union`` looks up what
        two of them make, among all cuts of pieces in two."""
        symbols = sorted({*self.id, *(c for p in self.id for c in p)})
        number = {s: i for i, s in enumerate(symbols, 1)}
        self.char = np.zeros(0x110000, np.int32)
        for s in symbols:
            if len(s) == 1:
                self.char[ord(s)] = number[s]
        self.id_of = np.array([-1, *(self.id.get(s, -1) for s in symbols)], np.int64)
        order = {c: i for i, c in enumerate(sorted(set(self.cost.values())))}
        self.rank = np.array([NEVER, *(order[self.cost[s]] if s in self.cost else NEVER for s in symbols)], np.int32)
        self.base = len(symbols) + 1
        pairs = {}
        for p in self.id:
            for i in range(1, len(p)):
                a, b = number.get(p[:i]), number.get(p[i:])
                if a and b:
                    pairs[a * self.base + b] = number[p]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        # A table of slots by hash; the few pairs that share one are looked up in order.
        slot = self._slot(self.pairs)
        crowded = np.bincount(slot, minlength=1 << SLOT_BITS) > 1
        self.slot_pair, self.slot_made = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int32)
        self.slot_pair[slot], self.slot_made[slot] = self.pairs, self.pair_made
        self.slot_pair[crowded], self.slot_made[crowded] = -1, 0

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pair.astype(_U) * _U(_STEP)) >> _U(64 - SLOT_BITS)).astype(np.int64)

    def union(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that symbols ``a`` and ``b`` make, 0 if none."""
        pair = a * self.base + b
        slot = self._slot(pair)
        known = self.slot_pair[slot]
        made = np.where(known == pair, self.slot_made[slot], 0).astype(np.int64)
        crowded = np.flatnonzero(known < 0)
        if len(crowded):
            pair = pair[crowded]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            made[crowded] = np.where(self.pairs[place] == pair, self.pair_made[place], 0)
        return made

    def spelled(self, code: int) -> list[int]:
        """The byte pieces of a character."""
        c = chr(code)
        return [self.byte[b] for b in (MARK if c == OWN_MARK else c).encode()]

    def _cuts(self) -> re.Pattern:
        """Finds the words. Besides space marks and newlines, a run of letters and digits ends before a
        punctuation mark, unless it holds one of the few characters that some piece has right before one."""
        after = {(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)}
        if any(b == MARK and a != MARK for a, b in after) or any("\n" in pair for pair in after):
            raise ValueError("pieces join a space mark or newline to text before it")
        marks = "!\"#$%&'()*+,-./:;<=>?@[]^`{|}~"
        joining = {a for a, b in after if a.isalnum() and b in marks} | {"_"}
        run = rf"{MARK}*[^\W{re.escape(''.join(sorted(joining)))}]++(?=[{re.escape(marks)}])"
        return re.compile(rf"\n|{run}|{MARK}*[^{MARK}\n]+|{MARK}+")


def merge(word: str, cost: dict[str, float], salt: dict[str, int] | None = None, key: int = 0, limit: int = 0) -> list[str]:
    """Symbols of ``word`` after all merges. With ``salt`` a candidate is skipped if the hash of key, place and
    piece is below ``limit``; a skipped candidate is gone until a neighbour's merge makes a new one."""
    if len(word) > LONG:
        return _merge_long(word, cost, salt, key, limit)
    symbols, starts = list(word), list(range(len(word)))
    never = float("inf")
    agenda = [cost.get(word[i : i + 2], never) for i in range(len(word) - 1)]
    while agenda:
        least = min(agenda)
        if least == never:
            break
        i = agenda.index(least)
        piece = symbols[i] + symbols[i + 1]
        if salt is not None:
            x = ((key ^ salt[piece]) + starts[i] * _PLACE) & _MASK
            x = ((x ^ (x >> 15)) * _ODD) & _MASK
            if x ^ (x >> 13) < limit:
                agenda[i] = never
                continue
        symbols[i] = piece
        del symbols[i + 1], starts[i + 1], agenda[i]
        if i:
            agenda[i - 1] = cost.get(symbols[i - 1] + piece, never)
        if i < len(agenda):
            agenda[i] = cost.get(piece + symbols[i + 1], never)
    return symbols


def _merge_long(word: str, cost: dict[str, float], salt, key: int, limit: int) -> list[str]:
    n = len(word)
    symbol: list[str | None] = list(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(c, i, word[i : i + 2]) for i in range(n - 1) if (c := cost.get(word[i : i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        _, i, piece = heapq.heappop(agenda)
        j = after[i]
        # Stale if either symbol was merged meanwhile.
        if symbol[i] is None or j >= n or symbol[i] + symbol[j] != piece:
            continue
        if salt is not None:
            x = ((key ^ salt[piece]) + i * _PLACE) & _MASK
            x = ((x ^ (x >> 15)) * _ODD) & _MASK
            if x ^ (x >> 13) < limit:
                continue
        symbol[i], symbol[j] = piece, None
        k = after[i] = after[j]
        h = before[i]
        if k < n:
            before[k] = i
        for left, right in ((i, k), (h, i)):
            if left >= 0 and right < n:
                pair = symbol[left] + symbol[right]
                c = cost.get(pair)
                if c is not None:
                    heapq.heappush(agenda, (c, left, pair))
    return [s for s in symbol if s is not None]


def _mixed(x: np.ndarray) -> np.ndarray:
    """The random numbers after ``x`` in the series of their occurrences."""
    with np.errstate(over="ignore"):
        x = x + _U(_STEP)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Encoder:
    """Encodes texts to id bytes (little-endian int32). Undropped forms of words are remembered in two generations,
    so that the frequent ones stay; what is remembered changes speed only."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED, remember: int = REMEMBER):
        self.v, self.dropout, self.seed, self.most = vocabulary, dropout, seed, remember
        #: Word: number of its merges and ids.
        self.new: dict[str, tuple[float, bytes]] = {}
        self.old: dict[str, tuple[float, bytes]] = {}
        self.limit = int(dropout * (1 << _BITS))
        self.rate = math.log1p(-dropout) if dropout < 1 else -math.inf

    def _ids(self, symbols: list[str]) -> bytes:
        v = self.v
        out: list[int] = []
        for s in symbols:
            found = v.id.get(s)
            if found is not None:
                out.append(found)
            else:
                out.extend(v.spelled(ord(s)))
        return array("i", out).tobytes()

    def _gaps(self, x: np.ndarray) -> np.ndarray:
        """Candidates that pass until the next skip, geometric, from random numbers."""
        return np.floor(np.log(((x >> _U(11)).astype(np.float64) + 1.0) / (1 << 53)) / self.rate)

    def _merged(self, words: list[str], gaps: np.ndarray, x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of each word, and its number of merges, if ``gaps`` candidates are merged before the first skip and
        the random numbers after ``x`` give the further gaps. Words of about one length are merged side by side."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cells = lengths[order] + 2
        out: list[bytes] = [b""] * len(words)
        merges = np.zeros(len(words), np.int64)
        start = 0
        while start < len(words):
            room = np.searchsorted(cells[start : start + CELLS] * np.arange(1, min(CELLS, len(words) - start) + 1), CELLS, "right")
            part = order[start : start + max(1, int(room))]
            found, merges[part] = self._side_by_side([words[i] for i in part.tolist()], lengths[part], gaps[part], x[part])
            for i, ids in zip(part.tolist(), found, strict=True):
                out[i] = ids
            start += len(part)
        return out, merges

    def _side_by_side(self, words: list[str], lengths: np.ndarray, left: np.ndarray, x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        v, n, w = self.v, len(words), int(lengths.max()) + 2
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        own = np.repeat(np.arange(n), lengths)
        # A row for each word: symbols between two empty ones, linked to their neighbours.
        cell = own * w + np.arange(1, len(codes) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        symbol, code, made = np.zeros(n * w, np.int64), np.zeros(n * w, np.uint32), np.zeros(n * w, np.int64)
        symbol[cell], code[cell] = v.char[codes], codes
        after, before = np.arange(1, n * w + 1), np.arange(-1, n * w - 1)
        live = np.zeros(n * w, bool)
        live[cell] = True
        agenda = np.full(n * w, NEVER, np.int32)
        made[cell] = v.union(symbol[cell], symbol[cell + 1])
        agenda[cell] = v.rank[made[cell]]
        agenda = agenda.reshape(n, w)
        merges, rows = np.zeros(n, np.int64), np.arange(n)
        while len(rows):
            best = agenda.argmin(axis=1)
            on = agenda[np.arange(len(rows)), best] != NEVER
            if not on.all():
                agenda, rows, best, left, x = agenda[on], rows[on], best[on], left[on], x[on]
            flat, here = agenda.reshape(-1), np.arange(len(rows)) * w + best
            skip = left < 1
            left = left - 1
            if skip.any():
                flat[here[skip]] = NEVER
                x[skip] = _mixed(x[skip])
                left[skip] = self._gaps(x[skip])
            go = ~skip
            here, at = here[go], (rows * w + best)[go]
            merges[rows[go]] += 1
            gone, left_of = after[at], before[at]
            right_of = after[gone]
            s = made[at]
            symbol[at], live[gone] = s, False
            after[at], before[right_of] = right_of, at
            flat[here + gone - at] = NEVER
            for place, union in ((at, v.union(s, symbol[right_of])), (left_of, v.union(symbol[left_of], s))):
                made[place] = union
                flat[here + place - at] = v.rank[union]
        at = np.flatnonzero(live)
        ids = v.id_of[symbol[at]]
        sizes = np.ones(len(at), np.int64)
        for i in np.flatnonzero(ids < 0).tolist():
            sizes[i] = len(v.spelled(int(code[at[i]])))
        ends = np.cumsum(np.bincount(at // w, weights=sizes, minlength=n).astype(np.int64)) * 4
        spelled = np.flatnonzero(ids < 0)
        if len(spelled):
            places = np.cumsum(sizes) - sizes
            whole = np.repeat(ids, sizes)
            for i in spelled.tolist():
                whole[places[i] : places[i] + sizes[i]] = v.spelled(int(code[at[i]]))
            ids = whole
        raw = ids.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], merges

    def _learn(self, words: list[str]) -> None:
        """Remembers the undropped forms of words."""
        fresh = []
        for word in words:
            form = self.old.get(word)
            if form is not None:
                self.new[word] = form
            elif len(word) > LONG:
                # With dropout a long word is merged anew each time: no first skip is beyond its candidates.
                self.new[word] = (math.inf, b"" if self.dropout else self._ids(merge(word, self.v.cost)))
            else:
                fresh.append(word)
        if fresh:
            ids, merges = self._merged(fresh, np.full(len(fresh), np.inf), np.zeros(len(fresh), _U))
            self.new.update(zip(fresh, zip(merges.tolist(), ids, strict=True), strict=True))

    def batch(self, texts: list[str], keys: list[str]) -> list[bytes]:
        """Ids of texts whose draws are keyed by ``keys``."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        find = self.v.words.findall
        found = [find(MARK + t.replace(MARK, OWN_MARK).replace(" ", MARK)) if t else [] for t in texts]
        counts = np.array([len(f) for f in found], np.int64)
        words = [w for f in found for w in f]
        get = self.new.get
        forms = [get(w) for w in words]
        if None in forms:
            self._learn(list(dict.fromkeys(w for w, f in zip(words, forms, strict=True) if f is None)))
            forms = [f or get(w) for w, f in zip(words, forms, strict=True)]
        out = [f[1] for f in forms]
        if self.dropout and words:
            starts = np.array([xxhash.xxh64_intdigest(k, self.seed) for k in keys], _U)
            place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                x = _mixed((place.astype(_U) + np.repeat(starts, counts) - _U(1)) * _U(_STEP))
            gaps = self._gaps(x)
            hit = np.flatnonzero(gaps < np.fromiter(map(itemgetter(0), forms), np.float64, len(forms)))
            short = [i for i in hit.tolist() if len(words[i]) <= LONG]
            for i in (i for i in hit.tolist() if len(words[i]) > LONG):
                out[i] = self._ids(merge(words[i], self.v.cost, self.v.salt, int(_mixed(x[i : i + 1])[0]) & _MASK, self.limit))
            if short:
                ids, _ = self._merged([words[i] for i in short], gaps[short], x[short])
                for i, made in zip(short, ids, strict=True):
                    out[i] = made
        ends = np.cumsum(counts).tolist()
        return [b"".join(out[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def __call__(self, text: str, key: str) -> bytes:
        return self.batch([text], [key])[0]


@lru_cache(maxsize=1)
def _vocabulary(model: bytes) -> Vocabulary:
    """One for all tasks of a worker."""
    return Vocabulary(model)


def decoded_to(ids: np.ndarray, sizes: list[int], texts: list[str], vocabulary: Vocabulary) -> list[bool]:
    """Whether the ids of each text, ``sizes`` of them, decode to it: :func:`decode` of many texts at once, as bytes."""
    taken = vocabulary.binary.take(pa.array(ids))
    ends = np.cumsum([0, *sizes])
    ends = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist() if len(ids) else ends.tolist()
    data = taken.buffers()[2]
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a + (raw[a : a + 1] == b" " and a < b) : b] == t.encode() for a, b, t in zip(ends[:-1], ends[1:], texts, strict=True)]


def decode(ids, vocabulary: Vocabulary) -> str:
    """The text of ids; the space that encoding puts in front is taken off."""
    raw = b"".join(map(vocabulary.bytes.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode()


def _model_bytes(rows: DataFrame, path: str):
    """The driver's model file, sent to the executors: the path need not exist there."""
    with open(path, "rb") as file:
        return rows.sparkSession.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary=VOCABULARY, dropout=DROPOUT, seed=SEED, copy_col=None) -> DataFrame:
    """One row for each input row: id, ids (array of int), n_pieces and lossless (decoding the ids gave
    back the text). ``copy_col`` numbers repeated rows from 0, so that they draw apart."""
    id_type = docs.schema[id_col].dataType.simpleString()
    model = _model_bytes(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model.value)
        encoder = Encoder(v, dropout, seed)
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                copies = part.column(2).to_pylist()
                keys = [("" if i is None else str(i)) + (f"\x00{c}" if c else "") for i, c in zip(part.column(0).to_pylist(), copies, strict=True)]
                ids = encoder.batch(texts, keys)
                sizes = [len(x) // 4 for x in ids]
                flat = np.frombuffer(b"".join(ids), "<i4")
                lossless = decoded_to(flat, sizes, texts, v)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat))
                columns = [part.column(0), lists, pa.array(sizes, pa.int32()), pa.array(lossless)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "n_pieces", "lossless"])

    copy = F.col(copy_col).cast("long") if copy_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), copy.alias("copy"))
    return in_arrow(rows, run, f"id {id_type}, ids array<int>, n_pieces int, lossless boolean")


def decode_documents(encoded: DataFrame, ids_col="ids", vocabulary=VOCABULARY) -> DataFrame:
    """``encoded`` with a column ``decoded``; null ids give null."""
    model = _model_bytes(encoded, vocabulary)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = Vocabulary(model.value)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else decode(list(x), v))

    return encoded.withColumn("decoded", text(F.col(ids_col)))


def op4_pieces(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
