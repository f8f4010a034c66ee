"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending order of id, as one
stream cut into blocks of BLOCK values. A block stores its minimum, a bit
width chosen by a percentile of the differences to the minimum, the low bits
of all differences at that width, and an exception list (positions and high
bits) for the values that need more. The file's index has the byte offset of
every block and the stream offset of every document, so a reader can seek.

Layout, all little-endian: magic (8 bytes), blocks, index, footer.
Block: u32 minimum, u8 width, u24 exceptions, u32 values, packed bits (padded
to 4 bytes), u16 positions, u32 high parts (each padded to 4 bytes).
Index: u64 block offsets, i64 document ids, u8 null flags (padded to 8), u64
end of each document in the stream. Footer: u64 blocks, documents, ids, offset
of the index; magic.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlight.llm.common import slices, text_frame
from cartlight.session import materialize, work_path

MAGIC = b"PFORTOK1"
BLOCK = 8192
PERCENTILE = 95
#: Words, and parts of words, that a worker remembers before it starts anew.
CACHE, CACHE_PARTS = 1_000_000, 700_000
#: Lower-case letters that no normal form changes.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
PLAIN = re.compile(f"[{LETTERS}]+")
#: Bytes that a byte-level tokenizer does not write as the character of their number, in ascending order from 256.
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
#: A word of letters that ends in an ASCII letter and closing marks: the tokenizer always cuts between the two.
LETTERS_AND_MARKS = re.compile(rb"([A-Za-z\x80-\xff]*[A-Za-z])([.,;:!?]*)")


# --- blocks -------------------------------------------------------------------------------------


def _pad(raw: bytes, unit: int) -> bytes:
    return raw + b"\0" * (-len(raw) % unit)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The low bits of all values, highest first; a width of whole bytes needs no bit array."""
    if width in (8, 16, 32):
        return values.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack_bits(raw: np.ndarray, width: int, count: int) -> np.ndarray:
    if not width:
        return np.zeros(count, dtype=np.uint32)
    if width in (8, 16, 32):
        return raw.view(f">u{width // 8}").astype(np.uint32)
    bits = np.unpackbits(raw, count=count * width).reshape(count, width)
    whole = np.zeros((count, 32), dtype=np.uint8)
    whole[:, 32 - width :] = bits
    return np.packbits(whole, axis=1).view(">u4").reshape(-1).astype(np.uint32)


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of unsigned 32-bit ids."""
    least = int(ids.min())
    rest = (ids - np.uint32(least)).astype(np.uint32)
    width = int(np.partition(rest, k := min(len(rest) - 1, int(len(rest) * percentile / 100)))[k]).bit_length()
    outlier = np.nonzero(rest >> np.uint32(width))[0] if width < 32 else np.zeros(0, dtype=np.int64)
    low = rest & np.uint32((1 << width) - 1)
    head = np.array([least, width | len(outlier) << 8, len(ids)], dtype="<u4").tobytes()
    high = (rest[outlier] >> np.uint32(width)).astype("<u4").tobytes() if len(outlier) else b""
    return head + _pad(pack_bits(low, width), 4) + _pad(outlier.astype("<u2").tobytes(), 4) + high


def unpack_block(raw: memoryview) -> np.ndarray:
    least, mixed, count = np.frombuffer(raw[:12], dtype="<u4").tolist()
    width, n_out = mixed & 255, mixed >> 8
    size = (count * width + 7) // 8
    at = 12 + size + (-size % 4)
    values = unpack_bits(np.frombuffer(raw[12 : 12 + size], dtype=np.uint8), width, count)
    if n_out:
        where = np.frombuffer(raw[at : at + 2 * n_out], dtype="<u2").astype(np.int64)
        at += 2 * n_out + (-2 * n_out % 4)
        values[where] |= np.frombuffer(raw[at : at + 4 * n_out], dtype="<u4") << np.uint32(width)
    return values + np.uint32(least)


# --- files --------------------------------------------------------------------------------------


class Writer:
    """Streams documents into one file; holds one block and the index."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        sink.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_block(ids)
        self.offsets.append(self.at)
        self.sink.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            stream = np.concatenate(self.waiting)
            whole = len(stream) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(stream[i : i + BLOCK])
            self.waiting, self.n_waiting = [stream[whole:]], len(stream) - whole

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        null = np.array([d is None for d in self.docs], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.docs], dtype="<i8")
        index = [np.array(self.offsets, dtype="<u8").tobytes(), ids.tobytes(), _pad(null.tobytes(), 8), np.array(self.ends, dtype="<u8").tobytes()]
        self.sink.write(b"".join(index))
        self.sink.write(np.array([len(self.offsets), len(self.docs), self.n_ids, self.at], dtype="<u8").tobytes() + MAGIC)


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        foot = source.read_at(40, end - 40)
        if bytes(foot[32:]) != MAGIC:
            raise ValueError("not a token file, or cut short")
        n_blocks, n_docs, self.n_ids, at = np.frombuffer(foot[:32], dtype="<u8").tolist()
        raw = source.read_at(end - 40 - at, at)
        self.offsets = np.append(np.frombuffer(raw[: 8 * n_blocks], dtype="<u8").astype(np.int64), at)
        at = 8 * n_blocks
        ids = np.frombuffer(raw[at : at + 8 * n_docs], dtype="<i8").tolist()
        at += 8 * n_docs
        null = np.frombuffer(raw[at : at + n_docs], dtype=np.uint8)
        at += n_docs + (-n_docs % 8)
        self.docs = [None if z else d for d, z in zip(ids, null.tolist())]
        self.ends = np.frombuffer(raw[at : at + 8 * n_docs], dtype="<u8").astype(np.int64)
        self.block, self.values = -1, np.zeros(0, dtype=np.uint32)

    def _load(self, block: int) -> np.ndarray:
        if block != self.block:
            start, stop = self.offsets[block : block + 2].tolist()
            self.block, self.values = block, unpack_block(memoryview(self.source.read_at(stop - start, start)))
        return self.values

    def ids(self, doc: int) -> np.ndarray:
        """Ids of the document at a position of the file: only its blocks are read."""
        at, stop = int(self.ends[doc - 1]) if doc else 0, int(self.ends[doc])
        out = []
        while at < stop:
            block = at // BLOCK
            upto = min(stop, (block + 1) * BLOCK)
            out.append(self._load(block)[at - block * BLOCK : upto - block * BLOCK])
            at = upto
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


# --- tokens -------------------------------------------------------------------------------------


class Parts(dict):
    """Parts of words (bytes) -> their ids as bytes, found when first asked for.

    A part of plain letters, which the steps before the merges would leave as
    it is, goes to the library's merges directly, if words of all such letters
    have the same ids both ways; any other part goes through all steps.
    """

    def __init__(self, library):
        super().__init__()
        self.library, self.merge = library, library.model.tokenize
        tried = [*LETTERS, LETTERS, LETTERS[::-1]]
        same = [*map(self.whole, tried)] == [*map(self.merged, tried)]
        self.plain = PLAIN.fullmatch if same else lambda word: None

    def merged(self, word: str) -> bytes:
        """Ids of a word by the merges alone, which see a byte as a character."""
        return array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(BYTE_ALPHABET))]).tobytes()

    def whole(self, word: str) -> bytes:
        """Ids of a word by all steps of the tokenizer."""
        return array("I", self.library.encode_batch_fast([word], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, part: bytes) -> bytes:
        word = part.decode("utf-8", "replace")
        self[part] = ids = self.merged(word) if self.plain(word) else self.whole(word)
        return ids


class Words(dict):
    """Words (bytes) -> their ids as bytes: a word of letters and closing marks is cut once more and its letters lower-cased."""

    def __init__(self, parts: Parts):
        super().__init__()
        self.parts = parts

    def __missing__(self, word: bytes) -> bytes:
        cut = LETTERS_AND_MARKS.fullmatch(word)
        if cut is None:
            ids = self.parts[word]
        else:
            ids = self.parts[cut[1].lower()]
            if cut[2]:
                ids += self.parts[cut[2]]
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of texts by a tokenizer file that lower-cases and never joins across ASCII space.

    Texts are cut at ASCII space, and a new word as the tokenizer would cut
    it itself, so that the library sees each part once. A worker remembers a
    bounded number of words and parts.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.parts = Parts(Tokenizer.from_str(tokenizer_json))
        self.words = Words(self.parts)

    def encode_batch(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        if len(self.words) >= CACHE:
            self.words.clear()
        if len(self.parts) >= CACHE_PARTS:
            self.parts.clear()
        end = np.array([end_id], dtype="<u4").tobytes()
        cut = ((r if b"<|" in r else r.lower()).split() for r in raw)  # special tokens keep their case
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)) + end, dtype="<u4") for words in cut]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str, text: Callable[[], str]) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[path] = WordTokenizer(text())
    return _tokenizers[path]


# --- operator -----------------------------------------------------------------------------------


def write_token_files(df: DataFrame, tokenizer_path: str, target: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest: part, file, n_docs, n_tokens, n_bytes, start.

    Documents are dealt to files by ranges of their id and sorted within, so
    the files in order of ``part`` hold all documents in ascending order
    (null ids first, equal ids by text). A null or empty text has the end id
    alone. Every task writes under a name of its own and renames at the end:
    a retried task gives the same file again. ``target`` must be a folder
    that all executors reach through pyarrow's file systems; by default a
    fresh one below spark.checkpoint.dir. An empty table gives no file.
    ``start`` counts the ids of all files before, from the manifest alone.
    """
    spark = df.sparkSession
    target = target or work_path(spark, "token-files")
    with open(tokenizer_path, encoding="utf-8") as source:
        library = spark.sparkContext.broadcast(source.read())

    def write(batches: Iterator[pa.RecordBatch]):
        context = TaskContext.get()
        part, writer, sink = context.partitionId(), None, None
        system, folder = fs.FileSystem.from_uri(target)
        tokenizer = _tokenizer(tokenizer_path, lambda: library.value)
        own, final = f"{folder}/.part-{part:06d}-{context.taskAttemptId()}", f"{folder}/part-{part:06d}.pfor"
        for batch in batches:
            for rows in slices(batch):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    sink = system.open_output_stream(own)
                    writer = Writer(sink)
                for doc, ids in zip(rows.column(0).to_pylist(), tokenizer.encode_batch(rows.column(1).to_pylist(), end_id)):
                    writer.add(doc, ids)
        if writer is not None:
            writer.close()
            sink.close()
            system.move(own, final)
            size = system.get_file_info(final).size
            columns = [[part], [f"{target}/part-{part:06d}.pfor"], [len(writer.docs)], [writer.n_ids], [size]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "file", "n_docs", "n_tokens", "n_bytes"])

    rows = text_frame(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = rows.mapInArrow(write, "part bigint, file string, n_docs bigint, n_tokens bigint, n_bytes bigint")
    files = materialize(made, "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if wanted, ids) of every document, read back from the files of a manifest.

    ``start`` counts the ids of all documents before, over all files. All ids
    are read and checked in any case; ``with_ids`` tells whether they go on.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["file"])
                with system.open_input_file(path) as source:
                    reader = Reader(source)
                    for at in range(0, len(reader.docs), 1024):
                        span = range(at, min(at + 1024, len(reader.docs)))
                        ids = [reader.ids(i) for i in span]
                        size = np.array([len(i) for i in ids], dtype=np.int64)
                        start = row["start"] + reader.ends[span.start : span.stop] - size
                        crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
                        columns = [pa.array(reader.docs[span.start : span.stop], pa.int64()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())]
                        if with_ids:
                            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(columns, names)

    n_files = manifest.count()
    return manifest.repartition(max(1, n_files)).mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)
