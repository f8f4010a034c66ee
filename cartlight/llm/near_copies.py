"""Near copies by Jaccard similarity of word shingles, with fuzzy Golay words as candidates.

A document is the set of its word shingles. MINHASHES minima over that set
give several fingerprints: each has one minimum as anchor (equal with
probability J for two sets of similarity J) and a word of 23 single bits of
other minima (each differs with probability (1 - J) / 2). The indices of the
word by the binary Golay code are its fuzzy keys, as in ``simhash_golay``:
words within distance 2 always share one. Documents that share an anchor and
an index are candidates, and only pairs whose exact similarity is large enough
are linked.

Candidates are compared with the first of their bucket at first: each document
with the most alike of its firsts, then with those of them that lie in other
groups. Then sizes and sketches travel to the buckets, where all pairs that are
not connected yet are screened; the sets of the members of such a pair follow
them, all pairs of these are compared, and only the links that join groups go
out. So a bucket of one group costs a comparison a member, no pair that could
join two groups is left out, and no step writes a row a pair.
Before shingles travel, a pair must agree in enough of SKETCH single bits, one
of each minimum: two sets of the least similarity differ in more of them than
allowed with a probability below 1e-10 (eight standard deviations).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlight.llm.common import slices
from cartlight.llm.components import connected_components
from cartlight.llm.simhash_golay import codeword_indices, shingle_hashes
from cartlight.session import materialize

MINHASHES = 128
#: Columns that hold a bit of every minimum.
SKETCH = ("bits_0", "bits_1")
#: Fingerprints of a document; one anchor and one word each.
PRINTS = 14
#: Shingles taken to all minima at a time.
CHUNK = 2048

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint32)
_ANCHORS = np.arange(PRINTS)
_WORDS = np.stack([_rng.choice(np.arange(PRINTS, MINHASHES), 23, replace=False) for _ in range(PRINTS)])


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles as sorted hashes (uint64)."""
    return np.unique(np.array(shingle_hashes(text, size), dtype=np.uint64))


def signature(shingles: np.ndarray) -> int:
    """Names the set: equal sets only, but for collisions of 64 bits. No shingle: 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64)) if len(shingles) else 0


def minima(shingles: np.ndarray) -> np.ndarray:
    short = (shingles ^ shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINHASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(short), CHUNK):
        part = _FACTORS[:, None] * short[None, at : at + CHUNK] + _SHIFTS[:, None]
        least = np.minimum(least, part.min(axis=1))
    return least


def single_bits(least: np.ndarray) -> np.ndarray:
    """One bit of every minimum, as 0 or 1."""
    mixed = least * np.uint32(0x9E3779B1)
    return (mixed ^ mixed >> np.uint32(15)).astype(np.uint8) & 1


def sketch(least: np.ndarray) -> np.ndarray:
    """The single bits of rows of minima in two 64-bit numbers a row."""
    return np.packbits(single_bits(least), axis=1).view(np.int64)


def allowed(similarity: float) -> int:
    """Bits in which sets of at least that similarity may differ: a bit differs with probability (1 - similarity) / 2."""
    p = (1 - similarity) / 2
    return int(MINHASHES * p + 8 * (MINHASHES * p * (1 - p)) ** 0.5)


def keys_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) pairs of rows of minima: fingerprint, index of its word, anchor."""
    bits = single_bits(least).astype(np.int64)
    rows, keys = [], []
    for k in range(PRINTS):
        word = (bits[:, _WORDS[k]] << np.arange(23)).sum(axis=1)
        near = codeword_indices(word)
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(k << 44 | near[row, column] << 32 | least[row, _ANCHORS[k]].astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                signs, least = [signature(s) for s in sets], [minima(s).tobytes() if len(s) else None for s in sets]
                columns = [part.column(0), pa.array(signs, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(least, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "sig", "n", "least"])

    return docs.select("row", "text").mapInArrow(run, "row bigint, sig bigint, n bigint, least binary")


def _sketches(chosen: DataFrame) -> DataFrame:
    """(sig, n, bits) of every set with a shingle; n is its size."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 4096):
                bits = sketch(np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint32).reshape(-1, MINHASHES))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], ["sig", "n", *SKETCH])

    return chosen.select("sig", "n", "least").filter("least is not null").mapInArrow(run, "sig bigint, n bigint, " + ", ".join(f"{c} bigint" for c in SKETCH))


def _in_buckets(chosen: DataFrame) -> DataFrame:
    """(key, sig, first): the members of buckets of two or more, with the smallest one; ``chosen`` has sig and least."""

    def explode(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 4096):
                signs = part.column(0).to_numpy()
                row, key = keys_of(np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(-1, MINHASHES))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signs[row])], ["key", "sig"])

    def collect(batches: Iterator[pa.RecordBatch]):
        keys = signs = np.zeros(0, dtype=np.int64)  # the last row so far: nobody knows yet whether it is alone
        first, met = 0, False  # the first row of its bucket, and whether that one has gone out already
        for batch in batches:
            if not batch.num_rows:
                continue
            carried = len(keys)
            keys, signs = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([signs, batch.column(1).to_numpy()])
            starts = np.concatenate([[True], keys[1:] != keys[:-1]])
            firsts = signs[np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))]
            if carried:
                firsts[keys == keys[0]] = first
            goes = ~starts
            goes[:-1] |= ~starts[1:]
            goes[0] |= met
            met, first = bool(goes[-1]), firsts[-1]
            goes[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(keys[goes]), pa.array(signs[goes]), pa.array(firsts[goes])], ["key", "sig", "first"])
            keys, signs = keys[-1:], signs[-1:]
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(signs), pa.array([first], pa.int64())], ["key", "sig", "first"])

    keyed = chosen.select("sig", "least").filter("least is not null").mapInArrow(explode, "key bigint, sig bigint")
    return keyed.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(collect, "key bigint, sig bigint, first bigint")


def _alike(lists: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, best, others): the firsts whose sizes fit and that differ in no more bits than allowed, the most alike one apart.

    A document's firsts travel in one row until they meet their sketches.
    """
    ends = {end: [F.col(c).alias(f"{end}_{c}") for c in ("n", *SKETCH)] for end in ("a", "b")}
    stars = lists.join(sketches, "sig").select(F.col("sig").alias("a"), *ends["a"], F.explode("firsts").alias("b")).filter("a <> b")
    pairs = stars.join(sketches.select(F.col("sig").alias("b"), *ends["b"]), "b")
    differ = sum(F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in SKETCH)
    fits = F.least("a_n", "b_n") >= F.lit(similarity - 1e-9) * F.greatest("a_n", "b_n")
    alike = pairs.filter(fits & (differ <= allowed(similarity))).select("a", F.struct(differ.alias("differ"), "b").alias("found"))
    ranked = alike.groupBy("a").agg(F.array_sort(F.collect_list("found")).getField("b").alias("found"))
    return ranked.select("a", F.get("found", F.lit(0)).alias("best"), F.slice("found", F.lit(2), F.size("found")).alias("others"))


def _apart(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, x, y): the pairs of a with each of ``others`` that are in different components x and y; ``nodes`` has sig and component."""
    left = pairs.filter(F.size("others") > 0).join(nodes.select(F.col("sig").alias("a"), F.col("component").alias("x")), "a")
    rows = left.select("a", "x", F.explode("others").alias("b"))
    return rows.join(nodes.select(F.col("sig").alias("b"), F.col("component").alias("y")), "b").filter("x <> y")


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` after the components that ``links`` connect have become one; only links between components travel."""
    ends = _apart(links.select("a", F.array("b").alias("others")), nodes).select(F.col("x").alias("a"), F.col("y").alias("b"))
    whole = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return materialize(nodes.join(whole, "component", "left").select("sig", F.coalesce("whole", "component").alias("component")), "copies-nodes")


def _joins(signs: np.ndarray, names: np.ndarray, size: np.ndarray, flat: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(a, b) of a bucket's members that are alike and whose components were still apart: a spanning forest of the bucket.

    ``names`` are the components (overwritten), ``flat`` the members' sets after each other, ``size`` their sizes.
    """
    starts = np.cumsum(size) - size
    shingles, flat = np.unique(flat, return_inverse=True)
    own, found = np.zeros(len(shingles), dtype=np.int64), []
    for i in range(len(signs) - 1):
        if (names[i + 1 :] == names[i]).all():
            continue
        at = starts[i + 1]
        mine = flat[starts[i] : at]
        own[mine] = 1
        common = np.add.reduceat(own[flat[at:]], starts[i + 1 :] - at)
        own[mine] = 0
        alike = common >= (similarity - 1e-9) * (size[i] + size[i + 1 :] - common)
        for j in np.nonzero(alike & (names[i + 1 :] != names[i]))[0] + i + 1:
            if names[j] != names[i]:
                names[names == names[j]] = names[i]
                found.append((int(max(signs[i], signs[j])), int(min(signs[i], signs[j]))))
    return found


def _strangers(names: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> np.ndarray:
    """Which of a bucket's members have one of another component that fits in size and sketch.

    Members of the largest component are compared with the others only.
    """
    found = np.zeros(len(names), dtype=bool)
    kinds, kind, many = np.unique(names, return_inverse=True, return_counts=True)
    for i in np.nonzero(kind != many.argmax())[0]:
        alike = np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64) <= allowed(similarity)
        alike &= (np.minimum(size, size[i]) >= (similarity - 1e-9) * np.maximum(size, size[i])) & (kind != kind[i])
        found |= alike
        found[i] |= alike.any()
    return found


def _mixed(members: DataFrame, similarity: float) -> DataFrame:
    """(key, sig, component) of the members that may be alike with one of another component in their bucket.

    ``members`` has key, sig, component, n and the sketch. One row a member at most goes out.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held = None
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns]) if batch.num_rows else np.zeros((batch.num_columns, 0), dtype=np.int64)
            held = rows if held is None else np.concatenate([held, rows], axis=1)
            cut = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0  # the last bucket may go on in the next batch
            if cut:
                yield from out(held[:, :cut])
                held = held[:, cut:]
        if held is not None and held.shape[1]:
            yield from out(held)

    def out(held: np.ndarray):
        keys, signs, names, size = held[:4]
        bounds = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        goes = np.zeros(len(keys), dtype=bool)
        several = np.add.reduceat(np.concatenate([names[1:] != names[:-1], [False]]) & np.concatenate([keys[1:] == keys[:-1], [False]]), bounds[:-1], dtype=np.int64) > 0
        for start, stop in zip(bounds[:-1][several], bounds[1:][several]):
            goes[start:stop] = _strangers(names[start:stop], size[start:stop], held[4:, start:stop].T, similarity)
        if goes.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[goes]) for x in (keys, signs, names)], ["key", "sig", "component"])

    rows = members.select("key", "sig", "component", "n", *SKETCH)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, sig bigint, component bigint")


def _cross_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all components with alike members in one bucket; ``members`` has key, sig, component.

    Sets travel once a member, and no pair does.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        keys = signs = names = size = flat = np.zeros(0, dtype=np.int64)

        def links(keys, signs, names, size, flat):
            bounds = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
            ends = np.concatenate([[0], np.cumsum(size)])
            for start, stop in zip(bounds[:-1], bounds[1:]):
                yield from _joins(signs[start:stop], names[start:stop].copy(), size[start:stop], flat[ends[start] : ends[stop]], similarity)

        def out(pairs: set):
            a, b = zip(*pairs)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column(3)
            rows = [batch.column(i).to_numpy() for i in range(3)] + [lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()]
            keys, signs, names, size, flat = (np.concatenate([old, new]) for old, new in zip((keys, signs, names, size, flat), rows))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on in the next batch
            if cut:
                most = int(size[:cut].sum())
                if pairs := set(links(keys[:cut], signs[:cut], names[:cut], size[:cut], flat[:most])):
                    yield out(pairs)
                keys, signs, names, size, flat = keys[cut:], signs[cut:], names[cut:], size[cut:], flat[most:]
        if len(keys) and (pairs := set(links(keys, signs, names, size, flat))):
            yield out(pairs)

    lists = members.groupBy("sig", "component").agg(F.collect_list("key").alias("keys"))
    rows = lists.join(sets, "sig").select(F.explode("keys").alias("key"), "sig", "component", "shingles")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets have at least that Jaccard similarity; ``sets`` has sig and shingles."""
    left = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("x"), F.size("shingles").alias("n"))
    right = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("y"), F.size("shingles").alias("m"))
    fits = F.least("n", "m") >= F.lit(similarity - 1e-9) * F.greatest("n", "m")
    both = pairs.join(left, "a").join(right, "b").filter(fits)
    common = both.select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).alias("common"))
    return common.filter(F.col("common") >= F.lit(similarity - 1e-9) * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, component) of every distinct ``row`` (a bigint naming its text) of ``docs`` (row, text).

    Texts whose sets of ``size``-word shingles have at least that Jaccard
    similarity are linked, if a fingerprint meets; see the README for the
    measured share. Texts of fewer words are one shingle, null texts and texts
    without a word are alike. An empty table gives an empty one.
    """
    rows = docs.select("row", "text")
    signed = materialize(_signed(rows, size), "copies-signed")
    chosen = materialize(signed.groupBy("sig").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("least").alias("least")), "copies-chosen")
    # a document's buckets in one row: what is looked up for it is looked up once
    of_sig = _in_buckets(chosen).groupBy("sig").agg(F.collect_list("key").alias("keys"), F.collect_set("first").alias("firsts"))
    lists = materialize(of_sig, "copies-buckets")
    sketches = materialize(_sketches(chosen), "copies-sketches")
    involved = chosen.select("sig", "row").join(lists.select("sig"), "sig", "left_semi")

    def hashed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, size) for t in part.column(0).to_pylist()]
                signs = pa.array([signature(x) for x in sets], pa.int64())  # not by row: two texts may share one
                yield pa.RecordBatch.from_arrays([signs, pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["sig", "shingles"])

    of_row = rows.join(involved, "row").select("text")
    sets = materialize(of_row.mapInArrow(hashed, "sig bigint, shingles array<bigint>").dropDuplicates(["sig"]), "copies-sets")
    alike = materialize(_alike(lists.select("sig", "firsts"), sketches, similarity), "copies-alike")
    nodes = sketches.select("sig", F.col("sig").alias("component"))
    best = alike.select("a", F.col("best").alias("b"))
    nodes = _merged(nodes, materialize(_verified(best, sets, similarity), "copies-links"))
    others = _apart(alike, nodes).select("a", "b")
    nodes = _merged(nodes, materialize(_verified(others, sets, similarity), "copies-links"))
    named = lists.select("sig", "keys").join(nodes.join(sketches, "sig"), "sig")
    mixed = materialize(_mixed(named.select(F.explode("keys").alias("key"), "sig", "component", "n", *SKETCH), similarity), "copies-mixed")
    more = materialize(_cross_links(mixed, sets, similarity), "copies-links")
    if more.head(1):
        nodes = _merged(nodes, more)
    found = signed.select("row", "sig").distinct().join(nodes, "sig", "left")
    return found.select("row", F.coalesce("component", "sig").alias("component"))
