"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One edit changes the counts of letters by a squared distance of at most two.
The letters are dealt to a few classes; a word's counts by class name its
block, so all words of a block have one length, and a near word lies in the
same block or in one that differs by one letter more, one less, or one moved
to another class. Every word visits those of the blocks around its own whose
name is greater, and is compared there with the residents: squared distances
come from NumPy products of letter counts, pairs at most two apart have their
edits verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.llm.common import slices, text_frame
from cartlight.session import cut_lineage, materialize

#: Bytes of a Latin-1 text as parts of words: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, a space for all others.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: One of so many words of a document (by a hash) loses a letter.
EVERY = 97
#: Columns of the count matrices: a letter each for a-z, the accented ones share six.
DIMENSIONS = 32
COLUMN = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)])
#: Residents that one group compares; a larger block is dealt to several groups, which all see its visitors.
BLOCK = 2048
#: Numbers of letter classes to choose from: the first whose largest block is within BLOCK, else the last.
CLASSES = (1, 2, 3, 4, 6, 8, 10, 12)
#: Partial counts a worker holds, and entries of one product.
FLUSH, PRODUCT = 500_000, 1 << 22


def count_words(docs: DataFrame, min_length: int, min_count: int) -> DataFrame:
    """(word binary in Latin-1, n) of ``docs`` (doc_id, text) after the deletions."""

    def run(batches: Iterator[pa.RecordBatch]):
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    prefix = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                    for word, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
                        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
                        if h % EVERY == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= min_length:
                            total[word] += n
                if len(total) > FLUSH:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return docs.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- blocks -------------------------------------------------------------------------------------


def letter_classes(weights: np.ndarray, classes: int) -> np.ndarray:
    """Class of each byte: letters by falling weight, each to the lightest class so far."""
    out, load = np.zeros(256, dtype=np.int64), np.zeros(classes)
    for letter in np.argsort(-weights, kind="stable"):
        out[letter] = int(load.argmin())
        load[out[letter]] += weights[letter]
    return out


def flat_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words, length of each)."""
    words = column.to_pylist()
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.fromiter(map(len, words), dtype=np.int64, count=len(words))


def counts_by(column: np.ndarray, letters: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(rows * width + column[letters], minlength=len(lengths) * width).reshape(len(lengths), width)


def names(counts: np.ndarray) -> np.ndarray:
    """Block names: counts modulo 65536 as big-endian bytes, which order like the counts."""
    return np.ascontiguousarray((counts % 65536).astype(">u2"))


def binary_array(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def moves(classes: int) -> np.ndarray:
    """Changes of the counts by one edit: a letter more, a letter less, a letter moved."""
    one = np.eye(classes, dtype=np.int64)
    return np.concatenate([one, -one, *(one[a] - one[[b for b in range(classes) if b != a]] for a in range(classes))])


def letter_weights(words: DataFrame) -> np.ndarray:
    """How often each letter occurs in the words, by byte; at most 256 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(256, dtype=np.int64)
        for batch in batches:
            total += np.bincount(flat_words(batch.column(0))[0], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], ["letter", "n"])

    weights = np.zeros(256)
    for row in words.select("word").mapInArrow(run, "letter bigint, n bigint").groupBy("letter").agg(F.sum("n").alias("n")).collect():
        weights[row["letter"]] = row["n"]
    return weights


def choose_classes(words: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(class of each byte, number of classes, words in the largest block)."""
    tables = [letter_classes(weights, c) for c in CLASSES]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            letters, lengths = flat_words(batch.column(0))
            for at, (classes, table) in enumerate(zip(CLASSES, tables)):
                name, n = np.unique(names(counts_by(table, letters, lengths, classes)).view(f"V{2 * classes}").ravel(), return_counts=True)
                rows = np.frombuffer(name.tobytes(), dtype=np.uint8).reshape(len(name), 2 * classes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), at, dtype=np.int32)), binary_array(rows), pa.array(n)], ["at", "block", "n"])

    sizes = words.select("word").mapInArrow(run, "at int, block binary, n bigint").groupBy("at", "block").agg(F.sum("n").alias("n"))
    largest = {r["at"]: r["n"] for r in sizes.groupBy("at").agg(F.max("n").alias("n")).collect()}  # a row a choice
    at = next((i for i in range(len(CLASSES)) if largest.get(i, 0) <= BLOCK), len(CLASSES) - 1)
    return tables[at], CLASSES[at], largest.get(at, 0)


def place_words(words: DataFrame, table: np.ndarray, classes: int) -> DataFrame:
    """(block, role, word, n): every word as resident (role 0) of its block and as visitor (role 2) of the greater blocks around it."""
    steps = moves(classes)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 4096):
                letters, lengths = flat_words(part.column(0))
                own = counts_by(table, letters, lengths, classes)
                home = names(own)
                yield pa.RecordBatch.from_arrays([binary_array(home), pa.array(np.zeros(len(own), dtype=np.int32)), *part.columns], ["block", "role", "word", "n"])
                around = (own[:, None, :] + steps[None]).reshape(-1, classes)
                at = np.repeat(np.arange(len(own)), len(steps))
                name = names(around)
                differ = name != home[at]
                first = differ.argmax(axis=1)
                rows = np.arange(len(at))
                greater = (name[rows, first] > home[at, first]) & differ.any(axis=1) & (around >= 0).all(axis=1)
                who = pa.array(at[greater])
                yield pa.RecordBatch.from_arrays(
                    [binary_array(name[greater]), pa.array(np.full(int(greater.sum()), 2, dtype=np.int32)), part.column(0).take(who), part.column(1).take(who)], ["block", "role", "word", "n"]
                )

    return words.select("word", "n").mapInArrow(run, "block binary, role int, word binary, n bigint")


def deal_large_blocks(placed: DataFrame) -> DataFrame:
    """Adds ``part``: the residents of a block above BLOCK are dealt by hash to parts, which all see the block's visitors.

    Residents also visit the parts after their own (role 1), so that each pair meets once.
    """
    sizes = placed.filter("role = 0").groupBy("block").count().filter(F.col("count") > BLOCK).select("block", F.ceil(F.col("count") / BLOCK).alias("parts"))
    joined = placed.join(sizes, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts"))
    roles = F.when(F.col("role") == 2, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.cast("int").alias("part"), F.lit(2).alias("role"))))
    roles = roles.otherwise(F.transform(F.sequence(own, F.col("parts") - 1), lambda p: F.struct(p.cast("int").alias("part"), F.when(p == own, 0).otherwise(1).alias("role"))))
    return joined.select("block", "word", "n", F.inline(roles))


# --- comparing ----------------------------------------------------------------------------------


class Words:
    """Words of a group as padded bytes, lengths and letter counts."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.words, self.n = words, n
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.bytes = np.zeros((len(words), int(self.length.max())), dtype=np.uint8)
        self.bytes[np.arange(self.bytes.shape[1]) < self.length[:, None]] = letters
        counts = counts_by(COLUMN, letters, self.length, DIMENSIONS)
        exact = np.float32 if counts.max() < 512 else np.float64  # sums of squares stay whole numbers
        self.counts = counts.astype(exact)
        self.norm = (self.counts * self.counts).sum(axis=1)


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of a and word j of b differ by exactly one inserted, deleted or replaced letter."""
    out = np.zeros(len(i), dtype=bool)
    la, lb = a.length[i], b.length[j]
    for lengths in sorted({*zip(la.tolist(), lb.tolist())}):
        if abs(lengths[0] - lengths[1]) > 1:
            continue
        at = np.flatnonzero((la == lengths[0]) & (lb == lengths[1]))
        size = min(lengths)
        for some in np.array_split(at, max(1, len(at) * size // PRODUCT + 1)):
            x, y = a.bytes[i[some]], b.bytes[j[some]]
            if lengths[0] == lengths[1]:
                out[some] = (x[:, :size] != y[:, :size]).sum(axis=1) == 1
                continue
            longer, shorter = (x, y) if lengths[0] > lengths[1] else (y, x)
            shorter = shorter[:, :size]
            ahead, behind = longer[:, :size] != shorter, longer[:, 1 : size + 1] != shorter
            first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), size)  # letters before it are equal
            last = np.where(behind.any(axis=1), size - 1 - behind[:, ::-1].argmax(axis=1), -1)  # letters after it are equal, one place on
            out[some] = last < first
    return out


def near_pairs(a: Words, b: Words, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of words one edit apart; with ``same`` (a is b) each pair once."""
    left, right = [], []
    step = max(1, PRODUCT // len(b.words))
    for low in range(0, len(a.words), step):
        part = a.counts[low : low + step]
        distance = a.norm[low : low + step, None] + b.norm[None, :] - 2 * (part @ b.counts.T)
        i, j = np.nonzero(distance <= 2)
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        near = one_edit(a, i, b, j)
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


def compare_blocks(placed: DataFrame) -> DataFrame:
    """(word, other, other_n), both ways, of all words one edit apart; a group's residents are held, its visitors stream by."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, group, residents, visitors = [], None, None, []

        def rows(a: Words, b: Words, same: bool):
            i, j = near_pairs(a, b, same)
            one, two = [*zip(i.tolist(), j.tolist())], []
            two = [a.words[x] for x, _ in one] + [b.words[y] for _, y in one]
            other = [b.words[y] for _, y in one] + [a.words[x] for x, _ in one]
            return pa.RecordBatch.from_arrays([pa.array(two, pa.binary()), pa.array(other, pa.binary()), pa.array(np.concatenate([b.n[j], a.n[i]]))], ["word", "other", "other_n"])

        def as_words(pairs):
            return Words([w for w, _ in pairs], np.array([n for _, n in pairs], dtype=np.int64))

        def settle(upto_visitors: bool):
            nonlocal held, residents, visitors
            if held:
                residents, held = as_words(held), []
                yield rows(residents, residents, True)
            if upto_visitors and visitors:
                if residents is not None:
                    yield rows(as_words(visitors), residents, False)
                visitors = []

        for batch in batches:
            for block, part, role, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, part) != group:
                    yield from settle(True)
                    group, residents = (block, part), None
                if role == 0:
                    held.append((word, n))
                else:
                    visitors.append((word, n))
                    if len(visitors) >= BLOCK:
                        yield from settle(True)
        yield from settle(True)

    ordered = placed.select("block", "part", "role", "word", "n").repartition("block", "part").sortWithinPartitions("block", "part", "role")
    return ordered.mapInArrow(run, "word binary, other binary, other_n bigint")


# --- operator -----------------------------------------------------------------------------------


def latin(column: Column | str) -> Column:
    return F.decode(column, "ISO-8859-1")


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that forms lead to, by doubling steps.

    A form has at least twice the count of its word, so a chain is as short as
    the logarithm of the largest count, and its doubling as that one's.
    """
    steps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = steps.join(onward, "root", "left")
        moved = cut_lineage(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of all texts with the variant they belong to.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case; by
    a hash of id and word, one in 97 loses a letter. Words of ``min_length``
    letters and ``min_count`` occurrences count. ``form`` is the near word (one
    edit) of largest n, ties to the smaller word, if its n is ``ratio`` times
    the word's or more, else null; ``root`` the last word that forms lead to.
    A null or empty text has no word, a null id is written `null` in the hash,
    repeated rows count again, an empty table gives an empty one. Words may be
    of any length. Only the two named columns are read.
    """
    if ratio < 2:
        raise ValueError("ratio below 2: forms could lead in a circle")
    words = materialize(count_words(text_frame(df, id_col, text_col), min_length, min_count), "spelling-words")
    table, classes, largest = choose_classes(words, letter_weights(words))
    placed = place_words(words, table, classes)
    placed = placed.withColumn("part", F.lit(0)) if largest <= BLOCK else deal_large_blocks(placed)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))  # bytes of Latin-1 order like code points
    nearest = compare_blocks(placed).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    has_form = form_n >= ratio * F.col("n")
    joined = words.join(nearest, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("best.other")).alias("form"), F.when(has_form, form_n).alias("form_n")
    )
    found = materialize(joined, "spelling-forms")
    out = found.join(follow_forms(found.filter("form is not null")), "word", "left")
    return out.select(latin("word").alias("word"), latin("form").alias("form"), latin(F.coalesce("root", "word")).alias("root"), "n", "n_near", "form_n")
