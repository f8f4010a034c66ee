"""SentencePiece encoding by vectorised merge rounds, and decoding by taking pieces from a table.

A text is cut at white space into words, and a word is cut again where two
neighbouring characters stand together in no piece: nothing ever merges across
such a place. All segments of a batch are one flat numpy array of symbols. In
a round every segment finds the least rank among its pairs (a segmented
minimum), merges the leftmost places that have it, and the array is compacted;
segments without a pair leave it. A worker remembers a bounded number of words.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlight.llm.common import append_columns, position, slices

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Segments above this many symbols go through a heap, as every round reads all of a segment.
LONG_SEGMENT = 512
#: Words that a worker remembers, and the longest of them.
CACHE, CACHED_LENGTH = 300_000, 64
SLOTS = 1 << 20
WORD = re.compile(r" +[^ ]+| +\Z")


@dataclass(frozen=True)
class Vocabulary:
    """What a model file holds: piece texts by id, ranks (equal scores have equal ranks), and the id of each byte."""

    pieces: list[str]
    ranks: np.ndarray  # -1 for pieces that take no part in merges
    byte_ids: np.ndarray  # by byte value
    byte_values: np.ndarray  # by id; -1 for other pieces
    silent: np.ndarray  # ids that decode to nothing


def load_model(path: str) -> Vocabulary:
    """The vocabulary of a BPE model with byte fallback and without text normalisation; ValueError for any other."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as source:
        model.ParseFromString(source.read())
    kind, norm = proto.ModelProto.SentencePiece, model.normalizer_spec
    types = np.array([p.type for p in model.pieces])
    plain = (
        model.trainer_spec.model_type == proto.TrainerSpec.BPE and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
        and not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        and not model.denormalizer_spec.precompiled_charsmap and not np.isin(types, [kind.USER_DEFINED, kind.UNUSED]).any() and (types == kind.BYTE).sum() == 256
    )
    if not plain:
        raise ValueError(f"{path} is no BPE model with byte fallback and plain white space")
    pieces = [p.piece for p in model.pieces]
    normal = types == kind.NORMAL
    if any(SPACE in p.lstrip(SPACE) for p, n in zip(pieces, normal) if n):
        raise ValueError(f"{path} has pieces that span words")
    scores = np.array([p.score for p in model.pieces])
    order = {s: i for i, s in enumerate(sorted(set(scores[normal].tolist()), reverse=True))}
    ranks = np.array([order[s] if n else -1 for s, n in zip(scores.tolist(), normal)], dtype=np.int32)
    byte_ids, byte_values = np.zeros(256, dtype=np.int32), np.full(len(pieces), -1)
    for i in np.flatnonzero(types == kind.BYTE):
        byte_values[i] = int(pieces[i][3:5], 16)  # <0x..>
        byte_ids[byte_values[i]] = i
    return Vocabulary(pieces, ranks, byte_ids, byte_values, np.isin(types, [kind.CONTROL]))


class Merger:
    """Ids of words by merge rounds over flat arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        texts = {p: i for i, (p, r) in enumerate(zip(vocabulary.pieces, vocabulary.ranks.tolist())) if r >= 0}
        self.size = len(vocabulary.pieces)
        # symbols: pieces by id, characters that only occur inside pieces after them, -1 for any other character
        inner = sorted({c for p in texts for c in p} - texts.keys())
        ids = {**texts, **{c: self.size + i for i, c in enumerate(inner)}}
        self.width = self.size + len(inner)
        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        for c in {c for p in texts for c in p}:
            self.of_char[ord(c)] = ids[c]
        pairs = [(ids[p[:k]] * self.width + ids[p[k:]], i) for p, i in texts.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.keys, self.merged = np.full(SLOTS, -1, dtype=np.int64), np.full(SLOTS, -1, dtype=np.int32)
        for key, i in pairs:
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.keys[slot], self.merged[slot] = key, i
        self.together = np.unique(np.array([ord(a) << 21 | ord(b) for p in texts for a, b in zip(p, p[1:])], dtype=np.int64))
        self.ranks = np.append(np.where(vocabulary.ranks < 0, NONE, vocabulary.ranks), NONE).astype(np.int32)  # the last one: no piece

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that each pair of symbols merges to; -1 for none."""
        keys = left.astype(np.int64) * self.width + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.merged[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers; a word is merged alone."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        cut = np.ones(len(points), dtype=bool)  # whether a segment starts here
        both = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.together, both), len(self.together) - 1)
        cut[1:] = self.together[at] != both
        ends = np.cumsum(sizes)
        starts = ends - sizes
        cut[starts[sizes > 0]] = True
        place, symbol = self.rounds(np.flatnonzero(cut), self.of_char[points])
        return self._ids(points, place, symbol, starts, ends)

    def rounds(self, starts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, symbol) of what is left of every segment when no pair remains, in order."""
        sizes = np.diff(np.append(starts, len(symbols)))
        done_at, done = [], []
        for k in np.flatnonzero(sizes > LONG_SEGMENT):
            at, left = self.by_heap(symbols[starts[k] : starts[k] + sizes[k]].tolist())
            done_at.append(np.array(at, dtype=np.int64) + starts[k])
            done.append(np.array(left, dtype=np.int32))
        usual = np.repeat(sizes <= LONG_SEGMENT, sizes)
        place = np.flatnonzero(usual)
        seg = np.repeat(np.arange(len(starts)), sizes)[usual]
        symbol = symbols[usual].astype(np.int32)
        merged = np.full(len(symbol), -1, dtype=np.int32)  # of each symbol with its next one
        inside = np.flatnonzero(seg[:-1] == seg[1:])
        merged[inside] = self.lookup(symbol[inside], symbol[inside + 1])
        rank = self.ranks[merged]
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            count = np.diff(np.append(first, len(seg)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < NONE, count)
            if not live.all():  # compaction: segments without a pair leave
                done_at.append(place[~live])
                done.append(symbol[~live])
                place, seg, symbol, merged, rank = place[live], seg[live], symbol[live], merged[live], rank[live]
                count, least = count[least < NONE], least[least < NONE]
                if not len(symbol):
                    break
            pick = np.flatnonzero(rank == np.repeat(least, count))
            # of places that share or touch a symbol only the leftmost merges in this round
            far = np.concatenate([[True], (pick[1:] - pick[:-1] > 2) | (seg[pick[1:]] != seg[pick[:-1]])])
            pick = pick[far]
            before, after = self._around(pick, seg, symbol, merged)
            # a new pair that is to come before the segment's other places sends these to a later round
            soon = np.minimum(self.ranks[before], self.ranks[after]) <= rank[pick]
            if soon.any():
                again = np.concatenate([[False], seg[pick[1:]] == seg[pick[:-1]]])
                hold = again & np.isin(seg[pick], seg[pick[soon]])
                pick, before, after = pick[~hold], before[~hold], after[~hold]
            symbol[pick] = merged[pick]
            merged[pick] = after
            left = pick > 0
            left[left] = seg[pick[left] - 1] == seg[pick[left]]
            merged[pick[left] - 1] = before[left]
            keep = np.ones(len(symbol), dtype=bool)
            keep[pick + 1] = False
            place, seg, symbol, merged = place[keep], seg[keep], symbol[keep], merged[keep]
            rank = self.ranks[merged]
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        place, symbol = np.concatenate(done_at), np.concatenate(done)
        order = np.argsort(place, kind="stable")
        return place[order], symbol[order]

    def _around(self, pick: np.ndarray, seg: np.ndarray, symbol: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What a merged place gives with the symbol before it and with the one after it; -1 for nothing."""
        new, last = merged[pick], len(symbol) - 1
        out = []
        for other, left in ((pick - 1, False), (pick + 2, True)):
            inside = (other >= 0) & (other <= last)
            inside[inside] = seg[other[inside]] == seg[pick[inside]]
            found = np.full(len(pick), -1, dtype=np.int32)
            next_to = symbol[other[inside]]
            found[inside] = self.lookup(new[inside], next_to) if left else self.lookup(next_to, new[inside])
            out.append(found)
        return out[0], out[1]

    def by_heap(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same for one long segment, pair by pair from a heap ordered by rank and place."""
        n = len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def push(lefts: list[int]) -> None:
            rights = [after[i] for i in lefts]
            found = self.lookup(np.array([symbols[i] for i in lefts]), np.array([symbols[j] for j in rights]))
            for i, j, new in zip(lefts, rights, found.tolist()):
                if new >= 0:
                    heapq.heappush(heap, (int(self.ranks[new]), i, j, symbols[i], symbols[j], new))

        heap: list[tuple[int, int, int, int, int, int]] = []
        push(list(range(n - 1)))
        while heap:
            _, i, j, a, b, new = heapq.heappop(heap)
            if symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            symbols[i], symbols[j], after[i] = new, -2, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            fresh = [k for k in (before[i], i) if k >= 0 and after[k] >= 0]
            if fresh:
                push(fresh)
        left = [i for i in range(n) if symbols[i] != -2]
        return left, [symbols[i] for i in left]

    def _ids(self, points: np.ndarray, place: np.ndarray, symbol: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Symbols as ids; a character that is no piece becomes the ids of its UTF-8 bytes."""
        ids, width = symbol.astype("<i4"), np.ones(len(symbol), dtype=np.int64)
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.size))
        if len(odd):
            raw = ["".join(map(chr, points[place[k : k + 1]].tolist())).encode("utf-8", "surrogatepass") for k in odd]
            width[odd] = [len(r) for r in raw]
            where = np.cumsum(width) - width
            out = np.empty(int(width.sum()), dtype="<i4")
            plain = np.ones(len(symbol), dtype=bool)
            plain[odd] = False
            out[where[plain]] = ids[plain]
            spread = np.repeat(where[odd], width[odd]) + np.concatenate([np.arange(len(r)) for r in raw])
            out[spread] = self.v.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            ids = out
        total = np.concatenate([[0], np.cumsum(width)]) * 4
        low, high = total[np.searchsorted(place, starts)].tolist(), total[np.searchsorted(place, ends)].tolist()
        raw_ids = ids.tobytes()
        return [raw_ids[a:b] for a, b in zip(low, high)]


class Encoder:
    """Ids of whole texts; words are merged once while they are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.merger = Merger(vocabulary)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def cut(text: str | None) -> list[str]:
        """Words of a text, each without the white space mark that every word starts with."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        parts = text.split(" ")
        return [w[1:] for w in WORD.findall(" " + text)] if "" in parts else parts

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        if len(self.words) >= CACHE:
            self.words.clear()
        found = [[*map(self.words.get, words)] for words in cut]
        gaps = [i for i, f in enumerate(found) if None in f]
        missing = [*{w for i in gaps for w, f in zip(cut[i], found[i]) if f is None}]
        fresh = dict(zip(missing, self.merger.encode([SPACE + w.replace(" ", SPACE) for w in missing])))
        for i in gaps:
            found[i] = [fresh[w] if f is None else f for w, f in zip(cut[i], found[i])]
        self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHED_LENGTH)
        return [b"".join(f) for f in found]


_workers: dict[str, object] = {}


def _worker(key: str, make):
    """One object a worker process: its tables are built once, not once a batch."""
    if key not in _workers:
        _workers.clear()
        _workers[key] = make()
    return _workers[key]


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """Adds ids (array of int) and n_tokens (long): the ids the sentencepiece library gives, without begin or end ids.

    Row-wise, no shuffle. A null or empty text has no id; a text of any length
    is encoded whole. Repeated rows are encoded alike, an empty table gives an
    empty one; input columns named ``ids`` or ``n_tokens`` (in any case) are
    replaced. The model's tables (a megabyte or two) are broadcast.
    """
    at = position(df, text_col)
    shared = df.sparkSession.sparkContext.broadcast(load_model(model_path))
    key = uuid.uuid4().hex

    def make(batches: Iterator[pa.RecordBatch]):
        encoder = _worker(key, lambda: Encoder(shared.value))
        for batch in batches:
            for part in slices(batch):
                raw = encoder.encode_batch(part.column(at).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield part, [ids, pa.array(np.diff(ends), pa.int64())]

    return append_columns(df, make, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])


class Decoder:
    """Texts of ids: the pieces of a whole batch are taken at once, then cut by text."""

    def __init__(self, vocabulary: Vocabulary):
        texts = []
        for piece, byte, silent in zip(vocabulary.pieces, vocabulary.byte_values.tolist(), vocabulary.silent.tolist()):
            texts.append(b"" if silent else bytes([byte]) if byte >= 0 else piece.replace(SPACE, " ").encode())
        unknown = int(np.flatnonzero((vocabulary.ranks < 0) & (vocabulary.byte_values < 0) & ~vocabulary.silent)[0])
        texts[unknown] = " ⁇ ".encode()  # how the library shows an unknown piece
        self.pieces = pa.array(texts, pa.binary())
        self.marked = np.array([p.startswith(SPACE) for p in vocabulary.pieces])  # the first one loses its mark
        self.silent, self.n = vocabulary.silent, len(texts)

    def decode_batch(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id is not in the vocabulary")
        taken = self.pieces.take(pa.array(ids))
        where = np.frombuffer(taken.buffers()[1], dtype=np.int32)[taken.offset : taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = taken.buffers()[2].to_pybytes() if len(ids) else b""
        mute = self.silent[ids] if len(ids) else np.zeros(0, dtype=bool)
        out = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            breaks = np.flatnonzero(mute[a:b]) + a  # byte pieces on both sides of one form no character together
            spans = list(zip([a, *(breaks + 1).tolist()], [*breaks.tolist(), b]))
            text, begun = "", False
            for low, high in spans:
                if low < high:
                    skip = 1 if not begun and self.marked[ids[low]] else 0
                    text, begun = text + self._text(data[int(where[low]) + skip : int(where[high])]), True
            out.append(text)
        return out

    @staticmethod
    def _text(raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:  # byte pieces that form no character: one mark a byte
            return _one_mark_a_byte(raw)


def _one_mark_a_byte(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at : at + error.start].decode() + "�" * (error.end - error.start))
            at += error.end
    return "".join(out)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``: the text of an array of ids, as the library's decode gives it.

    Row-wise, no shuffle. Null arrays give null, empty ones an empty text,
    null ids inside an array count for nothing. A column named ``text_col``
    is replaced.
    """
    at = position(df, ids_col)
    shared = df.sparkSession.sparkContext.broadcast(load_model(model_path))
    key = uuid.uuid4().hex

    def make(batches: Iterator[pa.RecordBatch]):
        decoder = _worker(key, lambda: Decoder(shared.value))
        for batch in batches:
            for part in slices(batch):
                column = part.column(at)
                sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = column.flatten()
                if flat.null_count:
                    owner = np.repeat(np.arange(len(sizes)), sizes)[flat.is_valid().to_numpy(zero_copy_only=False)]
                    sizes, flat = np.bincount(owner, minlength=len(sizes)), flat.drop_null()
                ends = np.cumsum(sizes).astype(np.int64)
                texts = decoder.decode_batch(flat.to_numpy(zero_copy_only=False), ends - sizes, ends)
                yield part, [pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))]

    valid = df if not df.schema.fields[at].dataType.containsNull else df.withColumn(df.columns[at], F.expr(f"filter(`{df.columns[at]}`, x -> x is not null)"))
    return append_columns(valid, make, [T.StructField(text_col, T.StringType())])
