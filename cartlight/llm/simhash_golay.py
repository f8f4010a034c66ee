"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments A (23 bits), B (23 bits) and C (18
bits). A 23-bit word is given the indices of all codewords of the Golay code
[23, 12, 7] within distance 4 of it: 1 or 6 of them. The code is perfect and
its extension meets every tetrad in a sextet, so two words within distance 2
always share an index. With at most 4 differing bits in all, one of these
holds, and each gives keys on which the two fingerprints meet:

* A and B differ in at most 2 bits each: an index of A with an index of B;
* else A or B differs in 3 or more, so the other one and C differ in at most
  one bit together: one of the two is equal and the other shares an index
  (C is padded with zeros to 23 bits).

Rows that meet on a key are compared in numpy, and a bucket gives a forest of
its links (at most one row for each member), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlight.llm.common import slices, text_frame
from cartlight.llm.components import connected_components
from cartlight.session import materialize

#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Members of a bucket compared with one another; larger buckets go through shared variants.
BUCKET = 16384


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator (11 bits)."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def error_patterns(within: int = 4) -> np.ndarray:
    """For each syndrome the error patterns of weight up to 4: one row of 6, the rest -1."""
    patterns = [0]
    for _ in range(within):
        patterns = sorted({p | 1 << b for p in patterns for b in range(23)} | set(patterns))
    patterns = np.array(patterns, dtype=np.int64)
    kind = syndrome(patterns)
    order = np.argsort(kind, kind="stable")
    patterns, kind = patterns[order], kind[order]
    first = np.searchsorted(kind, np.arange(2048))
    table = np.full((2048, 6), -1, dtype=np.int64)
    table[kind, np.arange(len(kind)) - first[kind]] = patterns
    return table


_table: np.ndarray | None = None


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within distance 4 of 23-bit words: six columns, -1 where there is none."""
    global _table
    if _table is None:
        _table = error_patterns()
    errors = _table[syndrome(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) pairs; equal keys of two fingerprints are of the same kind."""
    fp = fingerprints.astype(np.uint64)
    a = (fp >> np.uint64(41)).astype(np.int64)
    b = (fp >> np.uint64(18) & np.uint64(0x7FFFFF)).astype(np.int64)
    c = (fp & np.uint64(0x3FFFF)).astype(np.int64)
    ka, kb, kc = map(codeword_indices, (a, b, c))
    pairs = np.where((ka[:, :, None] >= 0) & (kb[:, None, :] >= 0), ka[:, :, None] << 12 | kb[:, None, :], -1).reshape(len(fp), -1)
    kinds = [pairs]
    for whole, near in ((a, kc), (c, ka), (b, kc), (c, kb)):
        kinds.append(np.where(near >= 0, whole[:, None] << 12 | near, -1))
    rows, keys = [], []
    for kind, table in enumerate(kinds):
        row, column = np.nonzero(table >= 0)
        rows.append(row)
        keys.append(table[row, column] | kind << 40)
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    """XXH64 of every shingle; words are split at ASCII space after A-Z were lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *(ends[: len(words) - size]).tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts, stops)]


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the hashes; no word: 0."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    table = np.array(hashes, dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(table), 1 << 16):
        ones += np.unpackbits(table[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(table)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed bigint; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                fp = np.array([fingerprint(t) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return text_frame(df, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64))


def forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of one bucket: every member once, to the first of its component."""
    left, links = np.arange(len(fp)), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            here = queue.pop()
            near = differing(fp[left], fp[here : here + 1]) <= MAX_BITS
            if near.any():
                found = left[near]
                links.extend((int(i), int(root)) for i in found)
                queue.extend(found.tolist())
                left = left[~near]
    return links


def bucket_links(keys: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Links within runs of equal keys: (a, b) arrays, and the members of runs above BUCKET."""
    a, b, over = [], [], []
    bounds = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
    sizes = np.diff(bounds)
    small = np.repeat(sizes <= 24, sizes)
    for gap in range(1, int(min(24, sizes.max(initial=1)))):
        near = (keys[gap:] == keys[:-gap]) & small[gap:]
        at = np.nonzero(near)[0]
        at = at[differing(fp[at], fp[at + gap]) <= MAX_BITS]
        a.append(fp[at + gap])
        b.append(fp[at])
    for run in np.nonzero(sizes > 24)[0]:
        members = fp[bounds[run] : bounds[run + 1]]
        if len(members) > BUCKET:
            over.append(members)
            continue
        found = np.array(forest(members), dtype=np.int64).reshape(-1, 2)
        a.append(members[found[:, 0]])
        b.append(members[found[:, 1]])
    return a, b, over


def fuzzy_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all links."""

    def explode(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 8192):
                fp = part.column(0).to_numpy()
                row, key = fuzzy_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]):
        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        far = False  # the run at the end is above BUCKET: its members go out as they come

        def out(a, b, over):
            a, b = np.concatenate([*a, *over, fps[:0]]), np.concatenate([*b, *over, fps[:0]])
            pair = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on in the next batch
            over = []
            if far:
                same = int(np.searchsorted(keys, keys[0], side="right"))
                over.append(fps[:same])
                if same == len(keys):
                    yield out([], [], over)
                    keys, fps = keys[-1:], fps[-1:]
                    continue
                keys, fps, cut, far = keys[same:], fps[same:], cut - same, False
            if cut:
                a, b, more = bucket_links(keys[:cut], fps[:cut])
                yield out(a, b, over + more)
                keys, fps = keys[cut:], fps[cut:]
            elif over:
                yield out([], [], over)
            if len(keys) > BUCKET:
                yield out([], [], [fps])
                keys, fps, far = keys[-1:], fps[-1:], True
        if len(keys) and not far:
            yield out(*bucket_links(keys, fps))

    keyed = distinct.select("fp").mapInArrow(explode, "key bigint, fp bigint")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a bigint, b bigint")
    return materialize(found, "golay-links")


def variant_links(members: DataFrame) -> DataFrame:
    """Exact links of members of very large buckets: two fingerprints within 4 bits share a variant within 2 of both.

    Each has 1 + 64 + 2016 variants, and those that share one are linked to
    the smallest of them, so the work grows in proportion to the members.
    """
    bits = F.array(*(F.shiftleft(F.lit(1).cast("bigint"), i) for i in range(64)))
    masks = F.flatten(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(i, F.lit(63)), lambda j: F.get(bits, i).bitwiseXOR(F.when(j == i, F.lit(0).cast("bigint")).otherwise(F.get(bits, j)))))
    )
    masks = F.concat(F.array(F.lit(0).cast("bigint")), masks)
    variants = members.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = variants.groupBy("variant").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return variants.join(least, "variant").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints within 4 bits are linked.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest doc_id
    reachable over links. Null and empty texts have fingerprint zero and are
    linked like any other. Rows with a null id belong to their component but
    never name it (a component of such rows only has a null id). Repeated rows
    come out as often as they are in the input; an empty table gives an empty
    one; no other column is read. No pair is dropped: buckets above ``BUCKET``
    members are linked through shared variants.
    """
    prints = materialize(fingerprints(df, id_col, text_col), "golay-fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    found = fuzzy_links(distinct)
    over = found.filter("a = b").select(F.col("a").alias("fp")).distinct()
    links = found.filter("a <> b")
    if over.head(1):
        links = links.unionByName(variant_links(over))
    nodes = connected_components(links)
    # a component is named by a fingerprint so far; its smallest document names it now
    named = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
