"""Byte-level BPE: ranked merges folded over the bytes of distinct words.

Spark higher-order functions fold the merges over byte arrays, looking ranks
up in a literal rank map (``encode_word``). ``encode_texts`` folds every word
that it can not look up:

1. the texts that hold a word are counted for all words, and the most frequent
   words (at most ``HEAD``) are folded once; they and their ids are left in
   the shared folder, where a worker reads them;
2. a worker cuts texts into words and writes the ids between the places of the
   other words, listing a text's distinct other words;
3. the fold runs over these lists, and the ids go to their places.

Workers handle some megabytes of text at a time: Arrow splits them at spaces
and numbers the distinct parts, which are looked up together (``Head``), and
numpy puts the ids of all texts together.

Counting shuffles distinct words only, and the texts are never shuffled. The
share of words beyond a fixed head is a matter of the language, not of the
corpus' size. A word of more than ``FOLD_BYTES`` bytes is merged by a heap in
the worker, because arrays would cost the square of its length.

``decode_ids`` concatenates the binary pieces of the ids with higher-order
functions over a literal of all pieces.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import regex
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlight.llm.common import SLICE, append_columns, narrow, position
from cartlight.session import materialize, work_path

#: More than any token id.
SPAN_BITS = 20
SPAN = 1 << SPAN_BITS
#: Most frequent words that are folded once and read by every worker.
HEAD = 1_500_000
#: Word counts up to here are told apart exactly when the head is chosen.
EXACT = 64
#: Bytes of text that a worker cuts at a time to count and to encode words; a longer text is cut alone.
COUNTED, ENCODED = 1 << 22, 1 << 20
#: Words hashed at a time when a head is read.
HASHED = 1 << 16
#: Bytes of a word up to which merges are folded over an array; beyond, a heap avoids work that grows with the square.
FOLD_BYTES = 200
#: The rank of a pair that joins nothing, and the id of an end.
NONE = SPAN - 1
#: Characters of a plan's text that the driver keeps.
PLAN_TEXT = 1_000_000
#: A slice's length that takes all that follows.
REST = 1 << 30
#: The alternative of a pattern that makes a space and letters one piece, after others that begin with an apostrophe; such words, for Arrow.
LETTERS, LETTER_WORD = r"| ?\p{L}+|", r"^ \p{L}+$"
#: For hashes of words.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_le", T.BinaryType())]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


# --- the fold -----------------------------------------------------------------------------------


def two_tables(packed: dict[int, int]) -> tuple[list[int], list[int]]:
    """Every key in the place ``key % size`` of one of two tables, so that a lookup reads two places at most; free places hold -1."""

    def place(sizes: tuple[int, int]) -> list[list[int]] | None:
        tables = [[-1] * n for n in sizes]
        for key in packed:
            side = 0 if tables[0][key % sizes[0]] < 0 else 1
            for _ in range(500):
                at = key % sizes[side]
                key, tables[side][at] = tables[side][at], key
                if key < 0:
                    break
                side = 1 - side
            else:
                return None
        return tables

    size = len(packed) + 1
    while (tables := place((2 * size + 1, size | 1))) is None:
        size += size // 8 + 1
    first, second = ([k if k < 0 else k * SPAN + packed[k] for k in table] for table in tables)
    return first, second


def rank_tables(ranks: dict[bytes, int]) -> str:
    """The rank map as flat arrays, in JSON.

    ids of single bytes, ranks of two bytes, and for pairs of ids two tables of
    (left id, right id, id of their token) packed into one number.
    """
    packed = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                packed[left * SPAN + right] = rank
    first, second = two_tables(packed)
    single = [bytes([b]) for b in range(256)]
    table = {
        "bytes": [ranks.get(b, -1) for b in single],
        "twos": [ranks.get(a + b, NONE) for a in single for b in single],
        "first": first,
        "second": second,
    }
    return json.dumps(table, separators=(",", ":"))


def rank_literal(tables: str) -> Column:
    """The tables of a rank map as one literal."""
    return F.from_json(F.lit(tables), "bytes array<int>, twos array<int>, first array<bigint>, second array<bigint>")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def encode_word(word: Column, table: Column) -> Column:
    """Token ids of a word, an array of its bytes as integers from 0 to 255."""

    def piece(byte: Column, i: Column) -> Column:
        rank = F.coalesce(F.get(table["twos"], byte * 256 + F.get(word, i + 1)), F.lit(NONE)).cast("bigint")
        own_id = F.get(table["bytes"], byte).bitwiseAND(F.lit(SPAN - 1))
        return F.shiftleft(rank, 2 * SPAN_BITS) + F.shiftleft(i.cast("bigint"), SPAN_BITS) + own_id

    end = F.array(F.lit(NONE << 2 * SPAN_BITS | NONE).cast("bigint"))
    return fold_merges(F.concat(end, F.transform(word, piece)), table)


def fold_merges(state: Column, table: Column) -> Column:
    """Token ids of a word, folded from an array of one number a byte.

    The state is an array of one number a piece, after an end that joins
    nothing: the rank of the piece with its neighbour to the right, where the
    piece begins, and its id. An id is a rank, so every step joins the least
    number's pair: the lowest rank, the leftmost of equals.
    """
    low_bits = SPAN * SPAN - 1

    def number(value: int) -> Column:
        return F.lit(value).cast("bigint")

    def own_id(piece: Column) -> Column:
        return piece.bitwiseAND(number(SPAN - 1))

    def joined(pair: Column) -> Column:
        first = F.get(table["first"], (pair % F.size(table["first"])).cast("int"))
        second = F.get(table["second"], (pair % F.size(table["second"])).cast("int"))
        return F.when(F.shiftright(first, SPAN_BITS) == pair, own_id(first)).when(F.shiftright(second, SPAN_BITS) == pair, own_id(second)).otherwise(number(NONE))

    def join(state: Column, least: Column, i: Column) -> Column:
        """Pieces i (from 1, the end included) and i + 1 become one."""
        new, before, after = F.shiftright(least, 2 * SPAN_BITS), F.get(state, i - 2), F.get(state, i + 1)
        pairs = F.array(F.shiftleft(own_id(before), SPAN_BITS) + new, F.shiftleft(new, SPAN_BITS) + F.coalesce(own_id(after), number(NONE)))
        kept = F.array(before.bitwiseAND(number(low_bits)), least.bitwiseAND(number(low_bits - NONE)) + new)
        beside = F.transform(pairs, lambda pair, k: F.shiftleft(joined(pair), 2 * SPAN_BITS) + F.get(kept, k))
        return F.concat(F.slice(state, 1, i - 2), beside, F.slice(state, i + 2, REST))

    def step(state: Column, _: Column) -> Column:
        def at(least: Column) -> Column:
            place = F.array_position(state, least).cast("int")
            return F.when(least < number(NONE << 2 * SPAN_BITS), let(place, lambda i: join(state, least, i))).otherwise(state)

        return let(F.array_min(state), at)

    def ids(state: Column) -> Column:
        return F.transform(F.slice(state, 2, REST), lambda piece: own_id(piece).cast("int"))

    return F.aggregate(F.slice(state, 1, F.size(state) - 2), state, step, ids)


# --- long words ---------------------------------------------------------------------------------


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap, for words of any length: time in proportion to n log n."""
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here; 0 once it is joined to the one before
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i : end[j]])) is not None:
            heappush(heap, (rank, i, j, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, stop = heappop(heap)
        if end[i] != j or end[j] != stop:  # one of the two has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


# --- texts --------------------------------------------------------------------------------------


def pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<i4").tobytes()


class States:
    """Words before their first merge, as ``fold_merges`` takes them."""

    def __init__(self, ranks: dict[bytes, int]):
        single = [bytes([b]) for b in range(256)]
        self.bytes = np.array([ranks.get(b, NONE) for b in single], np.int64)
        self.twos = np.array([ranks.get(a + b, NONE) for a in single for b in single], np.int64)

    def __call__(self, words: list[bytes]) -> pa.Array:
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        places, begins = np.arange(len(raw)), bounds(lengths)[:-1]
        ranks = np.append(self.twos[raw[:-1] * 256 + raw[1:]], NONE) if len(raw) else raw
        ranks[(begins + lengths - 1)[lengths > 0]] = NONE
        out = np.full(len(raw) + len(words), NONE << 2 * SPAN_BITS | NONE, np.int64)
        starts = np.repeat(np.arange(1, len(words) + 1), lengths)
        out[places + starts] = ranks << 2 * SPAN_BITS | places - np.repeat(begins, lengths) << SPAN_BITS | self.bytes[raw]
        return list_array(bounds(lengths + 1), pa.array(out))


def pieces_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices with at most ``most`` bytes of a text column each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Texts at single spaces: where the parts of each begin (and the end of all), the number of every part, the distinct parts. A null counts as empty."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    found = lists.flatten().dictionary_encode()
    return bounds(pc.list_value_length(lists).to_numpy()), found.indices.to_numpy().astype(np.int64), found.dictionary


def after_space(parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" ", parts.type), parts, pa.scalar("", parts.type))


def letter_words(words: pa.Array, pattern: str) -> np.ndarray:
    """Which words, as strings, are a space and letters, and so one piece of the pattern."""
    return pc.match_substring_regex(words, LETTER_WORD).to_numpy(zero_copy_only=False) if LETTERS in pattern else np.zeros(len(words), bool)


def ragged(starts: np.ndarray, sizes: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of ``lists``, one after the other, and the lists' sizes; list k has sizes[k] elements from starts[k] on."""
    n = sizes[lists]
    ends = np.cumsum(n)
    return np.repeat(starts[lists] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0), n


def bounds(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums of sizes."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


class Head:
    """Known words and the sizes of their lists of ids, sorted by a hash; many words are looked up at once and compared byte by byte.

    Takes about 50 bytes a word. Of words with the same hash all but one may stay unknown.
    """

    def __init__(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes, self.starts = ids.astype(np.int32), sizes.astype(np.int32), bounds(sizes)[:-1].astype(np.int32)
        self.bytes, self.begins, self.lengths = self.flat(words)
        self.hashes = np.empty(len(words), np.uint64)
        for k in range(0, len(words), HASHED):
            self.hashes[k : k + HASHED] = self.hashed(*self.flat(words.slice(k, HASHED)))
        self.order = np.argsort(self.hashes).astype(np.int32)
        self.hashes = self.hashes[self.order]

    @staticmethod
    def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = words.cast(pa.binary())
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if offsets and len(words) else np.zeros(1, np.int32)
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
        return raw, ends[:-1] - ends[0], np.diff(ends)

    @staticmethod
    def hashed(raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, FACTOR))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(begins, lengths)], out=sums[1:])
        h = sums[begins + lengths] - sums[begins]
        return (h ^ (h >> np.uint64(29))) * MIX

    def find(self, words: pa.Array) -> np.ndarray:
        """Number of every word, -1 for unknown ones."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1, np.int64)
        raw, begins, lengths = self.flat(words)
        h = self.hashed(raw, begins, lengths)
        ordered = np.argsort(h)
        place = np.empty(len(h), np.int64)
        place[ordered] = np.searchsorted(self.hashes, h[ordered])
        place = np.minimum(place, len(self.hashes) - 1)
        number = np.where(self.hashes[place] == h, self.order[place].astype(np.int64), -1)
        number[lengths != self.lengths[number]] = -1
        hit = np.flatnonzero(number >= 0)
        own, n = ragged(begins, lengths, hit)
        other, _ = ragged(self.begins, self.lengths, number[hit])
        number[hit[np.repeat(np.arange(len(hit)), n)[raw[own] != self.bytes[other]]]] = -1
        return number


class Encoder:
    """Ids of texts by a head of known words (or word -> ids as bytes), with places for the other words.

    A space between two characters that are no white space always starts a
    piece of the pattern: every alternative that takes a space takes it first.
    So a text is cut at such spaces, and equal parts have equal ids. A text
    with an empty part, or one that begins or ends with white space, is cut by
    the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, head: Head | dict[str, bytes]):
        if isinstance(head, dict):
            sizes = np.array([len(ids) // 4 for ids in head.values()], np.int64)
            head = Head(pa.array([w.encode("utf-8", "surrogatepass") for w in head], pa.binary()), np.frombuffer(b"".join(head.values()), "<i4"), sizes)
        self.ranks, self.find, self.letters, self.head = ranks, regex.compile(pattern).findall, LETTERS in pattern, head
        words = pa.Array.from_buffers(pa.string(), len(head.sizes), [None, pa.py_buffer(bounds(head.lengths).astype(np.int32)), pa.py_buffer(head.bytes)])
        self.plain, self.states = letter_words(words, pattern), States(ranks)

    def encode(self, text: str | None) -> tuple[bytes, list[bytes]]:
        """Ids as little-endian 32-bit integers, where -1 - k is the place of word k of the list, and that list."""
        runs, _, which, numbers, words = self.encode_all(pa.array([text], pa.string()))
        runs, which = runs[0].as_py(), which[0].as_py()
        return pack([i for k, run in enumerate(runs) for i in [*run, *(-1 - w for w in which[k : k + 1])]]), [words[k] for k in numbers]

    def encode_all(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, list[int], list[bytes]]:
        """Columns of many texts, and their other words.

        Per text: the runs of ids between its other words, as lists and as
        little-endian bytes, and the place of the word after each run but the
        last among the text's distinct ones. Then these words of all texts, one
        text after the other, as places in the last list. The result of
        ``columns`` has the words' states instead.

        Words are numbers below: one known by the head, one of this batch's
        ``extra`` words (tokens and long words) after those, or -1 - k for
        other word k of this batch.
        """
        begins, parts_of, parts = split_texts(texts)
        first, size = begins[:-1], np.diff(begins)
        head, known = self.head, len(self.head.sizes)
        extra: list[list[int]] = []
        others: list[bytes] = []
        fresh: dict[str, int] = {}

        def new(word: str) -> int:
            raw = word.encode("utf-8", "surrogatepass")
            if raw in self.ranks or len(raw) > FOLD_BYTES:
                extra.append([self.ranks[raw]] if raw in self.ranks else merge_long(raw, self.ranks))
                fresh[word] = known + len(extra) - 1
            else:
                others.append(raw)
                fresh[word] = -len(others)
            return fresh[word]

        # words of the distinct parts after a space, of every text's first part, and of every irregular text
        number = head.find(after_space(parts))
        number[~self.plain[number] if known else slice(None)] = -1  # a number of -1 takes any flag and stays
        unknown = np.flatnonzero(number < 0)
        entries = np.ones(len(parts) + len(first), np.int64)
        odd, pieces = np.zeros(len(parts), bool), []
        for k, part in zip(unknown.tolist(), parts.take(pa.array(unknown)).to_pylist()):
            if self.letters and part.isalpha():
                pieces.append(" " + part)
            elif not part or part[0].isspace() or part[-1].isspace():
                odd[k], entries[k] = True, 0
            else:
                found = self.find(" " + part)
                entries[k] = len(found)
                pieces += found
        odd = np.logical_or.reduceat(odd[parts_of], first) if len(first) else np.empty(0, bool)
        begun = pc.if_else(pa.array(odd), pc.fill_null(texts, ""), parts.take(pa.array(parts_of[first])).cast(texts.type))
        for k, text in enumerate(begun.to_pylist(), len(parts)):
            found = self.find(text)
            entries[k] = len(found)
            pieces += found
        asked = head.find(pa.array([w.encode("utf-8", "surrogatepass") for w in pieces], pa.binary()))
        for k in np.flatnonzero(asked < 0).tolist():
            n = fresh.get(pieces[k])
            asked[k] = new(pieces[k]) if n is None else n
        ends = bounds(entries)
        words = np.empty(ends[-1], np.int64)
        single = np.flatnonzero(number >= 0)
        words[ends[single]] = number[single]
        rest = np.ones(len(words), bool)
        rest[ends[single]] = False
        words[rest] = asked
        parts_of[first] = len(parts) + np.arange(len(first))
        keep = np.repeat(~odd, size)
        keep[first] = True
        owner = np.repeat(np.arange(len(first)), size)[keep]

        # all words in order, their texts, and their ids
        places, n = ragged(ends[:-1], entries, parts_of[keep])
        order = words[places]
        owner = np.repeat(owner, n)
        sizes = np.concatenate([head.sizes, np.array([len(e) for e in extra], np.int32), np.zeros(1, np.int32)])
        starts = np.concatenate([head.starts, len(head.ids) + bounds(sizes[known:])[:-1]])
        ids = np.concatenate([head.ids, np.array([i for e in extra for i in e], np.int32)]) if extra else head.ids
        taken, n = ragged(starts, sizes, np.where(order < 0, len(sizes) - 1, order))
        before = bounds(n)

        # runs begin with every text and after every other word
        at = np.flatnonzero(order < 0)
        text_at = np.searchsorted(owner, np.arange(len(first)))
        cuts = np.argsort(np.concatenate([2 * text_at - 1, 2 * at]), kind="stable")
        inner = np.concatenate([np.concatenate([before[text_at], before[at]])[cuts], before[-1:]])
        per_text = np.bincount(owner[at], minlength=len(first))
        flat, outer = ids[taken], bounds(per_text + 1)
        raw = pa.Array.from_buffers(pa.binary(), len(inner) - 1, [None, pa.py_buffer((inner * 4).astype(np.int32)), pa.py_buffer(flat.astype("<i4"))])
        runs, raw = list_array(outer, list_array(inner, pa.array(flat))), list_array(outer, raw)
        listed, which = np.unique(owner[at] * (len(others) + 1) + (-1 - order[at]), return_inverse=True)
        of_text, word = np.divmod(listed, len(others) + 1)
        lists = bounds(np.bincount(of_text, minlength=len(first)))
        which = list_array(bounds(per_text), pa.array((which - lists[owner[at]]).astype(np.int32)))
        self.lists = lists
        return runs, raw, which, word.tolist(), others

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        runs, raw, which, word, others = self.encode_all(texts)
        return [runs, raw, which, list_array(self.lists, self.states([others[k] for k in word]))]


def count_words(docs: DataFrame, pattern: str, tokens: set[bytes]) -> DataFrame:
    """(word binary, n): texts by word, for words that are no token and not above FOLD_BYTES; ``docs`` has a column text.

    The counts only choose the head: where runs of white space make words differ from those of the whole text, no id changes.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        find = regex.compile(pattern).findall
        known = Head(pa.array(list(tokens), pa.binary()), np.empty(0, np.int32), np.zeros(len(tokens), np.int64))
        for batch in batches:
            for some in pieces_of(batch, 0, COUNTED):
                begins, parts_of, parts = split_texts(some.column(0))
                owner = np.repeat(np.arange(some.num_rows), np.diff(begins))
                seen = np.sort(owner * len(parts) + parts_of)
                seen = seen[np.diff(seen, prepend=-1) > 0]
                texts = np.bincount(seen % max(len(parts), 1), minlength=len(parts))
                spaced = after_space(parts)
                plain = letter_words(spaced, pattern)
                counts: dict[str, int] = {}
                for part, n in zip(spaced.filter(pa.array(~plain)).to_pylist(), texts[~plain].tolist()):
                    for word in find(part):
                        counts[word] = counts.get(word, 0) + n
                words = pa.concat_arrays([spaced.filter(pa.array(plain)).cast(pa.binary()), pa.array([w.encode("utf-8", "surrogatepass") for w in counts], pa.binary())])
                n = np.concatenate([texts[plain], np.array(list(counts.values()), np.int64)]).astype(np.int64)
                kept = (known.find(words) < 0) & (pc.binary_length(words).to_numpy() <= FOLD_BYTES)
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(kept)), pa.array(n[kept])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fold_head(docs: DataFrame, ranks: dict[bytes, int], tables: str, pattern: str, most: int) -> str | None:
    """Where (word, ids) of the most frequent words lie, at most ``most``: all those whose count is above some level. None: no word."""
    counts = materialize(count_words(docs, pattern, set(ranks)), "bpe-words")
    level = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(EXACT + F.floor(F.log2(F.col("n") / EXACT) * 4) + 1).cast("int")
    least, held = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # a few hundred levels at most
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    if least is None:
        return None
    def begin(batches: Iterator[pa.RecordBatch]):
        states = States(ranks_of.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), states(batch.column(0).to_pylist())], ["word", "state"])

    spark = docs.sparkSession
    ranks_of = spark.sparkContext.broadcast({t: r for t, r in ranks.items() if len(t) < 3})
    path = work_path(spark, "bpe-head")
    begun = counts.filter(level >= least).select("word").mapInArrow(begin, "word binary, state array<bigint>")
    begun.select("word", let(rank_literal(tables), lambda t: fold_merges(F.col("state"), t)).alias("ids")).write.parquet(path)
    return path


def read_head(path: str | None, ranks: dict[bytes, int]) -> Head:
    """The tokens that may be words, and the words left in a folder, if any."""
    tokens = [(t, r) for t, r in ranks.items() if is_text(t)]  # others are part of a character: never a word
    words, ids = [pa.array([t for t, _ in tokens], pa.binary())], [np.array([r for _, r in tokens], np.int32)]
    sizes = [np.ones(len(tokens), np.int32)]
    if path is not None:
        system, folder = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        for info in system.get_file_info(fs.FileSelector(folder)):
            if not info.base_name.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as source:
                for some in pq.ParquetFile(source).iter_batches(100_000, columns=["word", "ids"]):
                    words.append(some.column(0).cast(pa.binary()))
                    ids.append(some.column(1).flatten().to_numpy())
                    sizes.append(pc.list_value_length(some.column(1)).to_numpy())
    return Head(pa.concat_arrays(words), np.concatenate(ids), np.concatenate(sizes))


def is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _short_plans(spark: SparkSession) -> None:
    """Plan texts are cut at a million characters unless the session says otherwise: the literals would fill the driver, which keeps these texts."""
    name = "spark.sql.maxPlanStringLength"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(PLAN_TEXT))


_encoders: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Adds n_tokens, ids (array of int) and ids_le (the ids as little-endian unsigned 32-bit integers).

    Every match of ``pattern`` is encoded alone and no special token is known.
    A null or empty text has no id. ``df`` is read twice: words are counted at
    once. The rank map is broadcast; at most ``head`` words with their ids are
    read from the shared folder (spark.checkpoint.dir, by pyarrow's file
    systems). The head changes no result, only how often a word is folded.
    Repeated rows are encoded alike, an empty table gives an empty one; input
    columns named like a result are replaced.
    """
    at = position(df, text_col)
    ranks = load_ranks(rank_path)
    tables = rank_tables(ranks)
    _short_plans(df.sparkSession)
    words = fold_head(narrow(df.toDF(*map(str, range(len(df.columns)))), text=str(at)), ranks, tables, pattern, head)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key = uuid.uuid4().hex

    def make(batches: Iterator[pa.RecordBatch]):
        encoder = _encoders.get(key)
        if encoder is None:
            _encoders.clear()
            encoder = _encoders[key] = Encoder(shared.value, pattern, read_head(words, shared.value))
        for batch in batches:
            for some in pieces_of(batch, at, ENCODED):
                columns = encoder.columns(some.column(at))
                for start in range(0, some.num_rows, SLICE):
                    yield some.slice(start, SLICE), [c.slice(start, SLICE) for c in columns]
                del columns
                pa.default_memory_pool().release_unused()

    new = {f.name for f in FIELDS}
    ints = T.ArrayType(T.IntegerType())
    fields = {"runs": T.ArrayType(ints), "runs_le": T.ArrayType(T.BinaryType()), "places": ints, "words": T.ArrayType(T.ArrayType(T.LongType()))}
    cut = append_columns(df, make, [T.StructField(f"bpe {n}", t) for n, t in fields.items()])
    names = cut.columns
    cut = cut.toDF(*(f"c{i}" for i in range(len(names))))
    kept = {f"c{i}": n for i, n in enumerate(names[:-4]) if n.lower() not in new}
    runs, runs_le, places, others = (F.col(f"c{len(names) - k}") for k in (4, 3, 2, 1))
    folded = let(rank_literal(tables), lambda t: F.transform(others, lambda w: fold_merges(w, t)))
    none = F.array().cast(ints)
    after = let(folded, lambda words: F.transform(places, lambda i: F.get(words, i)))  # one word after every run but the last
    placed = cut.select(*kept, runs.alias("runs"), runs_le.alias("runs_le"), after.alias("after"))
    # a reader of ids alone folds "after" into this column: inside the lambda of the runs it would be computed for every run
    ids = let(F.col("after"), lambda words: F.flatten(F.flatten(F.transform("runs", lambda run, k: F.array(run, F.coalesce(F.get(words, k), none))))))
    hexes = F.split(F.lit(",".join(i.to_bytes(4, "little").hex() for i in range(max(ranks.values(), default=-1) + 1))), ",")
    word_hex = let(hexes, lambda t: F.transform("after", lambda w: F.array_join(F.transform(w, lambda i: F.get(t, i)), "")))
    raw = let(word_hex, lambda words: F.unhex(F.array_join(F.transform("runs_le", lambda run, k: F.concat(F.hex(run), F.coalesce(F.get(words, k), F.lit("")))), "")))
    whole = placed.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(kept)), ids.alias("ids"), raw.alias("ids_le"))
    named = (F.col(f"k{i}").alias(n) for i, n in enumerate(kept.values()))
    return whole.select(*named, F.size("ids").cast("bigint").alias("n_tokens"), "ids", "ids_le")


def decode_ids(ids: Column, rank_path: str) -> Column:
    """The bytes of an array of ids: each id's piece from a literal, concatenated. A null array gives null."""
    ranks = load_ranks(rank_path)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return let(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))
