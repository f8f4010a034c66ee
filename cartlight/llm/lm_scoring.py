"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts a word from the two words before and the two after it,
never from the word itself: position-wise embeddings are added, passed through
tanh, and a two-level softmax gives P(class) * P(word | class). It is trained
in numpy on masked words of all documents: every partition trains a copy on
its own documents and the copies are averaged, weighted by their words. A
document's score is the sum of the log-probabilities of all its words.

The last class stands for every word beyond the vocabulary. Such a word is
predicted as P(last class | context) * P(word | beyond the vocabulary), the
second factor spelt byte by byte, so that no two words share a probability by
falling into one bucket and unseen words have a defined one.

Texts are read twice: to count their words, and to write the number of every
word and what the rare ones cost to spell. Training and scoring read numbers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlight.llm.common import append_columns, narrow, position, slices
from cartlight.session import materialize

CLASSES = 33
PER_CLASS = 128
SIZE = CLASSES * PER_CLASS
#: Words beyond the vocabulary fall into so many hash buckets as context; they are the last class as targets.
RARE = PER_CLASS
PAD = SIZE
WIDTH = 24
SHIFTS = (-2, -1, 1, 2)
#: Distinct words that a task counts before it sends them on.
FLUSH = 200_000
#: Words in one forward pass.
CHUNK = 1 << 14
#: Copies of the parameters added up in one task; slices of a copy.
FAN_IN = 32
#: Words in one step of the training.
BATCH = 8192
PIECES = 16
#: Bytes and the end of a word; slots that pairs of preceding bytes are hashed to; weight of the shorter context.
SYMBOLS = 257
SLOTS = 4096
BACKOFF = 8.0
#: Spelt words that a worker remembers before it starts anew.
CACHE = 1 << 19


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; ``docs`` has a column text."""

    def run(batches: Iterator[pa.RecordBatch]):
        def out(counter: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], ["word", "n"])

        counter: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    counter.update(split_words(text))
                if len(counter) > FLUSH:
                    yield out(counter)
                    counter = Counter()
        if counter:
            yield out(counter)

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> list[bytes]:
    """The most frequent words, at most SIZE - RARE of them; equal counts by word. ``counts`` is (word, n)."""
    best = counts.orderBy(F.desc("n"), "word").limit(SIZE - RARE)
    rows = materialize(best, "lm-vocabulary").collect()  # written first, so that partitions are not merged in the driver
    return [bytes(r["word"]) for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))]


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words with their ends, the symbol before each, the slot of the two before, and the ends' places."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(size) - 1
    symbols = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
    symbols[ends] = SYMBOLS - 1
    before = np.concatenate([[SYMBOLS - 1], symbols[:-1]])
    second = np.where(before == SYMBOLS - 1, SYMBOLS - 1, np.concatenate([[SYMBOLS - 1], before[:-1]]))
    return symbols, before, ((second * SYMBOLS + before) * 2654435761 >> 12) % SLOTS, ends


class Spelling:
    """P(word | beyond the vocabulary) by bytes, each from the two before it; interpolated with shorter contexts."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray, known: list[bytes]):
        self.pairs, self.triples = pairs, triples  # counts (SYMBOLS, SYMBOLS) and (SLOTS, SYMBOLS)
        self._short = (pairs + BACKOFF / SYMBOLS) / (pairs.sum(axis=1, keepdims=True) + BACKOFF)
        self._sums = triples.sum(axis=1)
        self._rest = 0.0
        taken = sum(np.exp(self._spell(known)).tolist())  # words of the vocabulary are never spelt
        self._rest = float(np.log(max(1 - taken, 1e-12)))

    def _spell(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        symbols, before, slot, ends = letters(words)
        p = (self.triples[slot, symbols] + BACKOFF * self._short[before, symbols]) / (self._sums[slot] + BACKOFF)
        total = np.cumsum(np.log(p))[ends]
        return np.diff(total, prepend=0.0) - self._rest

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """One number a word; ``words`` are all beyond the vocabulary."""
        return self._spell(words)


def spelling(counts: DataFrame, known: list[bytes]) -> Spelling:
    """Counts of symbols over all occurrences of all words beyond the vocabulary; two tables of fixed size are collected."""
    cells = (SYMBOLS + SLOTS) * SYMBOLS
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(known))

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(cells)
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in shared.value]
            if rows:
                words, times = zip(*rows)
                symbols, before, slot, ends = letters(list(words))
                weight = np.repeat(np.array(times, dtype=np.float64), np.diff(ends, prepend=-1))
                for context in (before, SYMBOLS + slot):
                    total += np.bincount(context * SYMBOLS + symbols, weight, cells)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    # one table a task and not one a partition of the shuffle
    summed = counts.select("word", "n").coalesce(FAN_IN).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = materialize(summed, "lm-spelling").toArrow()
    table = np.zeros(cells)
    table[np.asarray(rows.column("cell"))] = np.asarray(rows.column("n"))
    table = table.reshape(-1, SYMBOLS)
    return Spelling(table[:SYMBOLS], table[SYMBOLS:], known)


class Numbers(dict):
    """Word -> id; unknown words go to hash buckets and are not remembered."""

    def __missing__(self, word: bytes) -> int:
        return SIZE - RARE + zlib.crc32(word) % RARE


class Codes(dict):
    """Word -> id, or SIZE + k for the kth word that was not known."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.new: list[bytes] = []
        self.known = len(words)

    def __missing__(self, word: bytes) -> int:
        self[word] = code = SIZE + len(self) - self.known
        self.new.append(word)
        return code


class Reader:
    """Ids of texts and what their words beyond the vocabulary cost to spell; remembers up to CACHE of these, and those of one call."""

    def __init__(self, words: list[bytes], spelt: Spelling):
        self.words, self.spelt = words, spelt
        self._forget()

    def _forget(self) -> None:
        self.codes, self.bucket, self.cost = Codes(self.words), np.zeros(0, dtype=np.int32), np.zeros(0)

    def read(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, and the sum of its words' spelling."""
        if len(self.bucket) > CACHE:
            self._forget()
        get = self.codes.__getitem__
        codes = [np.fromiter(map(get, words := split_words(t)), dtype=np.int32, count=len(words)) for t in texts]
        new, self.codes.new = self.codes.new, []
        if new:
            bucket = np.fromiter(map(zlib.crc32, new), dtype=np.int64, count=len(new)) % RARE + (SIZE - RARE)
            self.bucket = np.concatenate([self.bucket, bucket.astype(np.int32)])
            self.cost = np.concatenate([self.cost, self.spelt.log_probabilities(new)])
        ids, sums = [], np.zeros(len(texts))
        for i, own in enumerate(codes):
            rare = np.nonzero(own >= SIZE)[0]
            which = own[rare] - SIZE
            own[rare] = self.bucket[which]
            sums[i] = self.cost[which].sum()
            ids.append(own.astype("<u2"))
        return ids, sums


@dataclass
class Network:
    """Parameters by name, float32."""

    embed: np.ndarray  # (shifts, SIZE + 1, WIDTH)
    bias: np.ndarray  # (WIDTH,)
    to_class: np.ndarray  # (WIDTH, CLASSES)
    class_bias: np.ndarray  # (CLASSES,)
    to_word: np.ndarray  # (CLASSES, WIDTH, PER_CLASS)
    word_bias: np.ndarray  # (CLASSES, PER_CLASS)

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.to_class, self.class_bias, self.to_word, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, dtype=np.float32)
        return cls(draw(len(SHIFTS), SIZE + 1, WIDTH), zero(WIDTH), draw(WIDTH, CLASSES), zero(CLASSES), draw(CLASSES, WIDTH, PER_CLASS), zero(CLASSES, PER_CLASS))

    @classmethod
    def unflat(cls, values: np.ndarray) -> Network:
        out, at = [], 0
        for like in cls.fresh(0).parts():
            out.append(values[at : at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        return cls(*out)


def surprise(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities of each column, less 1 at ``at``; ``x`` is overwritten."""
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    x[at, np.arange(x.shape[1])] -= 1
    return x


def log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability at ``at`` of each column; ``x`` is overwritten."""
    x -= x.max(axis=0)
    own = x[at, np.arange(x.shape[1])]
    return own - np.log(np.exp(x, out=x).sum(axis=0))


def laid(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts with two pads between them, the positions of words, and the words of each text."""
    size = np.array([len(i) for i in ids], dtype=np.int64)
    pad = np.full(2, PAD, dtype=np.uint16)
    flat = np.concatenate([pad, *(x for i in ids for x in (i, pad))])
    return flat, np.nonzero(flat != PAD)[0], size


def stream(texts: list[str | None], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``laid`` for texts."""
    get = numbers.__getitem__
    return laid([np.fromiter(map(get, words := split_words(t)), dtype=np.uint16, count=len(words)) for t in texts])


def rows_at(table: np.ndarray, at: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of a table; ``at`` is within it."""
    return np.take(table, at, axis=0, out=out, mode="clip")


def hidden(net: Network, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What the network makes of the words around each position, one column each."""
    total = rows_at(net.embed[0], flat[at + SHIFTS[0]])
    more = np.empty_like(total)
    for k in range(1, len(SHIFTS)):
        total += rows_at(net.embed[k], flat[at + SHIFTS[k]], more)
    total += net.bias
    return np.ascontiguousarray(np.tanh(total, out=total).T)


def by_class(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """How to order the positions by their words, each one's class and place in it in that order, and (class, start, stop) of classes with words of their own."""
    ids = flat[at]
    order = np.argsort(ids, kind="stable")
    ids = ids[order].astype(np.int64)
    bounds = np.searchsorted(ids, np.arange(CLASSES) * PER_CLASS).tolist()
    spans = [(c, bounds[c], bounds[c + 1]) for c in range(CLASSES - 1) if bounds[c] < bounds[c + 1]]
    return order, ids // PER_CLASS, ids % PER_CLASS, spans


def log_probabilities(net: Network, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(word | two before, two after) at the positions; of a word beyond the vocabulary, that it is one."""
    out = np.empty(len(at), dtype=np.float64)
    for start in range(0, len(at), CHUNK):
        some = at[start : start + CHUNK]
        order, classes, words, spans = by_class(flat, some)
        h = hidden(net, flat, some[order])
        part = log_softmax_at(net.to_class.T @ h + net.class_bias[:, None], classes).astype(np.float64)
        for c, lo, hi in spans:
            part[lo:hi] += log_softmax_at(net.to_word[c].T @ h[:, lo:hi] + net.word_bias[c][:, None], words[lo:hi])
        out[start + order] = part
    return out


def train_step(net: Network, squares: list[np.ndarray], flat: np.ndarray, at: np.ndarray, rate: float) -> None:
    """One Adagrad step on the words at the positions."""
    n = np.float32(len(at))
    order, classes, words, spans = by_class(flat, at)
    at = at[order]
    h = hidden(net, flat, at)
    d_class = surprise(net.to_class.T @ h + net.class_bias[:, None], classes)
    d_class /= n
    gradients = [np.zeros_like(p) for p in net.parts()[1:]]
    d_h = net.to_class @ d_class
    gradients[1], gradients[2] = h @ d_class.T, d_class.sum(axis=1)
    for c, lo, hi in spans:
        own = h[:, lo:hi]
        d_word = surprise(net.to_word[c].T @ own + net.word_bias[c][:, None], words[lo:hi])
        d_word /= n
        gradients[3][c], gradients[4][c] = own @ d_word.T, d_word.sum(axis=1)
        d_h[:, lo:hi] += net.to_word[c] @ d_word
    h *= h
    d_h *= 1 - h
    gradients[0] = d_h.sum(axis=1)
    each = np.ascontiguousarray(d_h.T)
    sorted_rows = np.empty_like(each)
    for k, shift in enumerate(SHIFTS):  # only the rows of words that occur: the others have gradient 0
        ids = flat[at + shift]
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.nonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[0]
        g, ids = np.add.reduceat(rows_at(each, order, sorted_rows), first, axis=0), ids[first]
        own = rows_at(squares[0][k], ids)
        own += g * g
        squares[0][k][ids] = own
        net.embed[k][ids] -= rate * g / (np.sqrt(own) + np.float32(1e-6))
    for p, s, g in zip(net.parts()[1:], squares[1:], gradients):
        s += g * g
        p -= rate * g / (np.sqrt(s) + np.float32(1e-6))


def train_copy(net: Network, streams: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], every: int, turn: int, batch: int = BATCH, rate: float = 0.05) -> int:
    """Trains on one word in ``every`` of each text, by its place in the text; another choice each turn. Gives the number of words used.

    ``streams`` are texts in the form of ``laid``.
    """
    squares = [np.zeros_like(p) for p in net.parts()]
    used = 0
    rng = np.random.default_rng(turn)
    for flat, at, size in streams:
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        picked = at[place % every == turn % every]
        picked = picked[rng.permutation(len(picked))]
        for start in range(0, len(picked), batch):
            train_step(net, squares, flat, picked[start : start + batch], rate)
        used += len(picked)
    return used


def _train_round(numbered: DataFrame, net: Network, every: int, turn: int) -> Network:
    """One copy a partition, averaged in steps of FAN_IN; ``numbered`` has a column IDS."""
    context = numbered.sparkSession.sparkContext
    shared = context.broadcast(net.flat())

    def run(batches: Iterator[pa.RecordBatch]):
        own = Network.unflat(shared.value)
        streams = (laid(_ids(part.column(0))) for batch in batches for part in slices(batch))
        used = train_copy(own, streams, every, turn)
        if used:
            part = TaskContext.get().partitionId()
            pieces = np.array_split(own.flat().astype(np.float64) * used, PIECES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int64()), pa.array([used] * PIECES, pa.int64()), pa.array([p.astype("<f4").tobytes() for p in pieces])],
                ["piece", "copy", "n", "raw"],
            )

    def add(key, table):
        total = np.sum([np.frombuffer(x, dtype="<f4").astype(np.float64) for x in table.column("raw").to_pylist()], axis=0)
        n = sum(table.column("n").to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([n], pa.int64()), pa.array([total.astype("<f4").tobytes()])], ["piece", "copy", "n", "raw"])

    schema = "piece int, copy bigint, n bigint, raw binary"
    copies = materialize(numbered.select(IDS).mapInArrow(run, schema), "lm-copies")
    while (most := copies.agg(F.max("copy")).first()[0] or 0) > 0:
        copies = copies.withColumn("copy", F.floor(F.col("copy") / FAN_IN).cast("bigint")).groupBy("piece", "copy").applyInArrow(add, schema)
        if most >= FAN_IN:
            copies = materialize(copies, "lm-sums")
        else:
            break
    rows = copies.orderBy("piece").collect()  # PIECES rows: one set of parameters
    if not rows:
        return net
    return Network.unflat(np.concatenate([np.frombuffer(r["raw"], dtype="<f4").astype(np.float64) / r["n"] for r in rows]))


@dataclass
class Model:
    words: list[bytes]
    net: Network
    spelling: Spelling


IDS, COST = "lm ids", "lm cost"
NUMBERED = [T.StructField(IDS, T.BinaryType()), T.StructField(COST, T.DoubleType())]


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(raw, dtype="<u2") for raw in column.to_pylist()]


def _number(df: DataFrame, at: int, words: list[bytes], spelt: Spelling) -> DataFrame:
    """``df`` with the ids of each text and the cost of spelling its rare words; the text is column ``at``."""
    shared = df.sparkSession.sparkContext.broadcast((words, spelt.pairs, spelt.triples))

    def make(batches: Iterator[pa.RecordBatch]):
        known, pairs, triples = shared.value
        reader = Reader(known, Spelling(pairs, triples, known))
        for batch in batches:
            for part in slices(batch):
                ids, cost = reader.read(part.column(at).to_pylist())
                yield part, [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(cost)]

    return append_columns(df, make, NUMBERED)


def _fit(df: DataFrame, text_col: str, keep: list[str], rounds: int, every: int, seed: int) -> tuple[Model, DataFrame]:
    """The model, and the written table of the columns ``keep`` (as c0, c1, ...) with IDS and COST."""
    counts = materialize(count_words(narrow(df, text=text_col)), "lm-counts")
    words = vocabulary(counts)
    spelt = spelling(counts, words)
    chosen = narrow(df, **{f"c{i}": c for i, c in enumerate(keep)}, text=text_col)
    numbered = materialize(_number(chosen, len(keep), words, spelt).drop("text"), "lm-ids")
    net = Network.fresh(seed)
    for turn in range(rounds):
        net = _train_round(numbered, net, every, turn * every // max(1, rounds))
    return Model(words, net, spelt), numbered


def train(df: DataFrame, text_col: str = "text", rounds: int = 2, every: int = 2, seed: int = 5) -> Model:
    """Vocabulary and network from all texts.

    A round masks one word in ``every`` of each document (others each round).
    With as many rounds as ``every`` each word is a target once. The vocabulary of
    whole words has a fixed size, all other words are spelt; both and one
    averaged set of parameters are all that is collected.
    """
    return _fit(df, text_col, [], rounds, every, seed)[0]


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("log_probability", T.DoubleType()), T.StructField("mean_log_probability", T.DoubleType())]


def _sums(net: Network, ids: list[np.ndarray], cost: np.ndarray) -> list[pa.Array]:
    """The columns FIELDS of texts by their ids and the cost of spelling."""
    flat, where, size = laid(ids)
    ends = np.concatenate([[0], np.cumsum(size)])
    sums = np.concatenate([[0.0], np.cumsum(log_probabilities(net, flat, where))])
    total = sums[ends[1:]] - sums[ends[:-1]] + cost
    return [pa.array(size), pa.array(total), pa.array(total / np.maximum(size, 1), mask=size == 0)]


def train_and_score(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, rounds: int = 2, every: int = 2, seed: int = 5) -> DataFrame:
    """``score(df, train(df))`` for the columns ``keep`` (default: all), reading each text twice and not three times and once a round."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {f.name for f in FIELDS}]
    model, numbered = _fit(df, text_col, keep, rounds, every, seed)
    shared = df.sparkSession.sparkContext.broadcast(model.net.flat())

    def make(batches: Iterator[pa.RecordBatch]):
        net = Network.unflat(shared.value)
        for batch in batches:
            for part in slices(batch):
                yield part, _sums(net, _ids(part.column(len(keep))), part.column(len(keep) + 1).to_numpy())

    return append_columns(numbered, make, FIELDS).drop(IDS, COST).toDF(*keep, *(f.name for f in FIELDS))


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds n_words, the summed log-probability of all words and its mean.

    A null text and one without a word have sum 0 and a null mean. Repeated
    rows score alike, an empty table gives an empty one, input columns named
    like a result are replaced. Whole texts are scored, in passes of CHUNK words.
    """
    at = position(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast((model.net.flat(), model.words, model.spelling.pairs, model.spelling.triples))

    def make(batches: Iterator[pa.RecordBatch]):
        values, known, pairs, triples = shared.value
        net, reader = Network.unflat(values), Reader(known, Spelling(pairs, triples, known))
        for batch in batches:
            for part in slices(batch):
                yield part, _sums(net, *reader.read(part.column(at).to_pylist()))

    return append_columns(df, make, FIELDS)
