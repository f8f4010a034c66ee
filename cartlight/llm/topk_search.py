"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. The k-th score
of each query is located by histograms: a round counts scores by their leading
bits inside the interval that is still open, the counts are added up over all
blocks, and the interval shrinks to the bin that holds the k-th value. A last
pass keeps scores at or above that value; ties go to smaller ids.

A block reports a bin only down to the one of its own k-th score: lower ones
cannot hold the k-th score of all. So a block sends at most k counts a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlight.llm.common import narrow
from cartlight.session import cut_lineage, materialize

SCALE = 256.0
CANDIDATES = 4096
QUERIES = 512
#: Leading bits that a round resolves.
STEP_BITS = 12
LOW = np.iinfo(np.int64).min
#: Tasks that score block pairs, at most.
TASKS = 2048
PACKED = "part int, seq int, dim int, ids binary, vectors binary, kind string, largest bigint"


def quantize(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles, held within the range of a long."""
    return np.clip(np.floor(SCALE * vectors), -(2.0**62), 2.0**62).astype(np.int64)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a vector of finite components."""
    rows = narrow(df, vec_id=id_col, embedding=vector_col).select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    limit = float("inf")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)


def pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``rows`` quantized vectors of one dimension, in the smallest integer type that holds them."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        size = np.diff(lists.offsets.to_numpy())
        flat, start = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
        for dim in np.unique(size):
            pick = np.nonzero(size == dim)[0]
            for at in range(0, len(pick), rows):
                some = pick[at : at + rows]
                block = quantize(flat[start[some][:, None] + np.arange(dim)[None, :]])
                largest = int(np.abs(block).max(initial=0))
                kind = next(k for k, most in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if largest < most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(dim)], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()]), pa.array([block.astype(kind).tobytes()]), pa.array([kind]), pa.array([largest])],
                    ["part", "seq", "dim", "ids", "vectors", "kind", "largest"],
                )
                seq += 1


def blocks(rows: DataFrame, size: int) -> DataFrame:
    return rows.select("vec_id", "embedding").mapInArrow(lambda batches: pack(batches, size), PACKED)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where they are exact, else by longs (which wrap beyond 63 bits)."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def _pairs(candidates: DataFrame, queries: DataFrame, use: Callable, schema: str) -> DataFrame:
    """``use(query ids, state, scores without own rows as LOW, candidate ids)`` of every block of queries with every block of candidates."""
    n_candidates, n_queries = (x.agg(F.max("block")).first()[0] or 0 for x in (candidates, queries))
    left = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries))))
    right = queries.select(
        F.col("block").alias("query_block"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("kind").alias("q_kind"), "state",
        F.explode(F.sequence(F.lit(0), F.lit(n_candidates))).alias("block"),
    )
    tasks = min(TASKS, (n_candidates + 1) * (n_queries + 1))
    deal = lambda side: side.repartition(tasks, "block", "query_block")  # noqa: E731  by work, not by bytes
    both = deal(left).join(deal(right), ["block", "query_block", "dim"]).select("dim", "ids", "vectors", "kind", "q_ids", "q_vectors", "q_kind", "state")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                c_ids = np.frombuffer(row["ids"], dtype="<i8")
                q_ids = np.frombuffer(row["q_ids"], dtype="<i8")
                c = np.frombuffer(row["vectors"], dtype=row["kind"]).reshape(len(c_ids), row["dim"]).astype(np.int64)
                q = np.frombuffer(row["q_vectors"], dtype=row["q_kind"]).reshape(len(q_ids), row["dim"]).astype(np.int64)
                state = np.frombuffer(row["state"], dtype="<i8").reshape(len(q_ids), -1)
                for at in range(0, len(q_ids), 128):
                    part = slice(at, at + 128)
                    table = scores(q[part], c)
                    table[q_ids[part][:, None] == c_ids[None, :]] = LOW
                    yield from use(q_ids[part], state[part], table, c_ids)

    return both.mapInArrow(run, schema)


def _count_bins(k: int, shift: int):
    """Counts of bins (score >> shift) within each query's open interval, from the top down to the bin of the block's k-th score."""

    def use(q_ids, state, table, _):
        low, high = state[:, :1], state[:, 1:2]
        table = np.where((table >= low) & (table <= high), table, LOW)
        least = np.partition(table, table.shape[1] - k, axis=1)[:, -k][:, None] if table.shape[1] > k else np.full((len(table), 1), LOW)
        row, column = np.nonzero((table != LOW) & (table >> shift >= least >> shift))
        if len(row):
            pair, count = np.unique(np.stack([row, table[row, column] >> shift], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[pair[:, 0]]), pa.array(pair[:, 1]), pa.array(count)], ["query_id", "bin", "n"])

    return use


def _keep(k: int):
    """Rows above each query's k-th value, and the k smallest ids of those equal to it."""

    def use(q_ids, state, table, c_ids):
        kth = state[:, :1]
        row, column = np.nonzero((table != LOW) & (table > kth))
        r2, c2 = np.nonzero((table != LOW) & (table == kth))
        if len(r2):
            order = np.lexsort((c_ids[c2], r2))
            r2, c2 = r2[order], c2[order]
            first = np.searchsorted(r2, r2)
            near = np.arange(len(r2)) - first < k
            row, column = np.concatenate([row, r2[near]]), np.concatenate([column, c2[near]])
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(c_ids[column]), pa.array(table[row, column])], ["query_id", "vec_id", "score"])

    return use


def _query_blocks(queries: DataFrame, parts: int) -> DataFrame:
    """Packed queries with their state (low and high end of the open interval), numbered."""

    def run(batches: Iterator[pa.RecordBatch]):
        seq = 0
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                state = np.stack([some.column(2).to_numpy(), some.column(3).to_numpy()], axis=1).astype("<i8")
                by_id = dict(zip(some.column(0).to_pylist(), state))
                rows = pa.RecordBatch.from_arrays([some.column(0), pa.array(some.column(1).to_pylist(), pa.list_(pa.float64()))], ["v", "e"])
                for block in pack(iter([rows]), QUERIES):
                    own = np.stack([by_id[i] for i in np.frombuffer(block.column("ids")[0].as_py(), dtype="<i8").tolist()])
                    block = block.set_column(1, "seq", pa.array([seq], pa.int32()))
                    seq += 1
                    yield pa.RecordBatch.from_arrays([*block.columns, pa.array([own.tobytes()])], [*block.schema.names, "state"])

    packed = queries.select("vec_id", "embedding", "low", "high").repartition(parts, "vec_id").mapInArrow(run, PACKED + ", state binary")
    return _numbered(cut_lineage(packed))


def _numbered(packed: DataFrame) -> DataFrame:
    """Blocks numbered from 0: only the places of the blocks, a row each, meet in one task."""
    places = packed.select("part", "seq").withColumn("block", F.row_number().over(Window.orderBy("part", "seq")) - 1)
    return packed.join(places, ["part", "seq"])


def top_k(df: DataFrame, k: int = 5, is_query: Callable | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, ties to smaller ids.

    Components are quantized to floor(256 x); the score is the integer inner
    product. Queries are the rows for which ``is_query(id)`` holds (by default
    all ids divisible by 50), candidates all rows but those with the query's
    own id. Rows with a null id, and vectors that are null or hold a null or
    non-finite component, take no part; vectors of different length are not
    compared. Repeated rows are candidates each; of several rows with a
    query's id the least vector is the query. Fewer than k candidates: all of
    them. An empty table gives an empty one. Other columns are not read.
    """
    rows = usable(df, id_col, vector_col)
    is_query = is_query or (lambda c: c % 50 == 0)
    candidates = materialize(blocks(rows, CANDIDATES), "topk-candidates")
    queries = materialize(rows.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "topk-queries")
    size = candidates.agg(F.max("largest"), F.max("dim")).first()
    parts = max(1, -(-queries.count() // QUERIES))
    bound = min(2**62, (size[0] or 0) ** 2 * (size[1] or 0) + 1)
    candidates = _numbered(candidates)
    shift = max(0, (2 * bound).bit_length() - STEP_BITS)
    # wanted: how many of the k lie inside the open interval; done: the interval is one value
    state = queries.select("vec_id", F.lit(-bound).cast("bigint").alias("low"), F.lit(bound).cast("bigint").alias("high"), F.lit(k).cast("bigint").alias("wanted"))
    while True:
        packed = _query_blocks(queries.join(state, "vec_id"), parts)
        counts = _pairs(candidates, packed, _count_bins(k, shift), "query_id bigint, bin bigint, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        ranked = counts.join(state, F.col("query_id") == F.col("vec_id")).withColumn("upto", F.sum("n").over(down))
        # the first bin from the top that reaches the wanted number; if none does, all candidates are taken
        hit = ranked.filter(F.col("upto") >= F.col("wanted")).groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("wanted") - F.col("upto") + F.col("n")).alias("rest")), "bin").alias("hit"))
        width = 1 << shift
        state = cut_lineage(
            state.join(hit, F.col("vec_id") == F.col("query_id"), "left").select(
                "vec_id",
                F.greatest("low", F.coalesce(F.col("hit.bin") * width, F.lit(-bound))).cast("bigint").alias("low"),
                F.least("high", F.coalesce(F.col("hit.bin") * width + (width - 1), F.lit(-bound))).cast("bigint").alias("high"),
                F.coalesce("hit.rest", F.lit(0)).cast("bigint").alias("wanted"),
            )
        )
        if not shift:
            break
        shift = max(0, shift - STEP_BITS)
    packed = _query_blocks(queries.join(state, "vec_id"), parts)
    found = _pairs(candidates, packed, _keep(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
