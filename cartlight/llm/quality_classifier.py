"""Ordinal quality classifier on graded ratings.

A cumulative-link (proportional odds) model: one weight for each hashed text
feature, shared by all grades, and ordered thresholds between the grades.
P(grade <= k) = sigmoid(threshold_k - score). It is fitted in numpy on a
bounded sample of rated documents and applied row-wise to whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlight.llm.common import append_columns, narrow, position, slices

BITS = 18
#: Words whose bucket a worker remembers before it starts anew.
CACHE = 1 << 19
NOT_LETTERS = re.compile(r"[\W_]+")
SYMBOLS = "#*$%&|<>"
#: Words of a text among which distinct ones are counted, so that their share does not fall with its length.
WINDOW = 200
_buckets: dict[str, tuple[int, int]] = {}


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def features(text: str | None) -> list[int]:
    """Buckets of the distinct words (letters and digits, lower case), their first four letters and the text's shape."""
    text = text or ""
    words = text.split()
    if len(_buckets) > CACHE:
        _buckets.clear()
    found = set()
    for word in set(words):
        at = _buckets.get(word)
        if at is None:
            plain = NOT_LETTERS.sub("", word).lower()
            at = _buckets[word] = bucket(f"w:{plain}"), bucket(f"p:{plain[:4]}")
        found.update(at)
    n = max(1, len(words))
    shape = {
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "shouts": text.count("!") / n,
        "capitals": sum(map(str.isupper, words)) / n,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "variety": 1 - sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)) / n,
        "stops": text.count(".") / n,
    }
    for name, value in shape.items():
        found.add(bucket(f"s:{name}:{min(10, int(value * 10))}"))
    found.add(bucket(f"s:length:{len(words).bit_length()}"))
    return sorted(found)


@dataclass
class OrdinalModel:
    weights: np.ndarray  # by bucket
    thresholds: np.ndarray  # ascending, one less than the grades

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one column a threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit_ordinal(
    flat: np.ndarray, size: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = 12, batch: int = 256, rate: float = 0.03, sparse: float = 6e-3, least: float = 0.002
) -> OrdinalModel | None:
    """Fits documents given by their buckets, one after the other (``flat``), and their numbers of buckets (``size``).

    Adam on the likelihood, weights drawn towards 0 by ``sparse`` a step; None if fewer than two grades occur.

    Buckets in a smaller share than ``least`` of the sample (or fewer than 4
    of its documents) keep weight 0: they would only learn the noise of rare words.
    """
    if len(set(grades.tolist())) < 2:
        return None
    start = np.concatenate([[0], np.cumsum(size)])
    known = np.bincount(flat, minlength=1 << BITS) >= max(4, least * len(size))
    index = np.full(1 << BITS, -1, dtype=np.int64)
    index[known] = np.arange(known.sum())
    n_known = int(known.sum())
    share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(0.01, 0.99)
    first = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    # parameters: weights, first threshold, logarithms of the gaps between thresholds
    p = np.concatenate([np.zeros(n_known), first[:1], gaps])
    mean, square, step = np.zeros_like(p), np.zeros_like(p), 0
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(size))
        for at in range(0, len(size), batch):
            pick = order[at : at + batch]
            ids = index[np.concatenate([flat[start[i] : start[i + 1]] for i in pick])]
            owner = np.repeat(np.arange(len(pick)), size[pick])
            owner, ids = owner[ids >= 0], ids[ids >= 0]
            score = np.bincount(owner, p[ids], len(pick))
            gap = np.exp(p[n_known + 1 :])
            cuts = np.concatenate([[-np.inf], p[n_known] + np.concatenate([[0], np.cumsum(gap)]), [np.inf]])
            y = grades[pick]
            with np.errstate(over="ignore"):
                upper = 1 / (1 + np.exp(-(cuts[y + 1] - score)))
                lower = 1 / (1 + np.exp(-(cuts[y] - score)))
            inside = np.maximum(upper - lower, 1e-12)
            d_upper, d_lower = upper * (1 - upper) / inside, lower * (1 - lower) / inside
            gradient = np.zeros_like(p)
            gradient[:n_known] = np.bincount(ids, (d_upper - d_lower)[owner], n_known) / len(pick)
            cut = np.zeros(n_grades + 1)
            np.add.at(cut, y + 1, -d_upper)
            np.add.at(cut, y, d_lower)
            inner = cut[1:-1] / len(pick)
            gradient[n_known] = inner.sum()
            gradient[n_known + 1 :] = [inner[k + 1 :].sum() * g for k, g in enumerate(gap)]
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            square = 0.999 * square + 0.001 * gradient**2
            p -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            p[:n_known] = np.sign(p[:n_known]) * np.maximum(np.abs(p[:n_known]) - sparse, 0)
    weights = np.zeros(1 << BITS)
    weights[known] = p[:n_known]
    return OrdinalModel(weights, p[n_known] + np.concatenate([[0], np.cumsum(np.exp(p[n_known + 1 :]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null if either rating is missing."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


def train(
    docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_train: int = 12000, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade"
) -> OrdinalModel | None:
    """Fits on at most ``max_train`` rated documents, those with the smallest hash of their id.

    Only their bucket numbers come to the driver. Rows with a null id or
    grade, or a grade outside 0 .. n_grades - 1, take no part; an id that is
    rated several times counts with its lowest grade.
    """
    rated = narrow(ratings, doc_id=id_col, grade=grade_col).filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    rated = rated.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    order = F.xxhash64(F.lit("train"), F.col("doc_id"))
    sample = rated.orderBy(order, "doc_id").limit(max_train)
    texts = narrow(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                ids = pa.array([features(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids], ["doc_id", "grade", "ids"])

    found = texts.select("doc_id", "text", "grade").mapInArrow(hashed, "doc_id bigint, grade int, ids array<int>").toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    ids = found.column("ids").combine_chunks()
    flat, size, grades = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()), np.asarray(found.column("grade"))
    model = fit_ordinal(flat, size, grades, n_grades)
    del found, ids, flat, size, grades
    pa.default_memory_pool().release_unused()  # the driver goes on with other work
    return model


FIELDS = [T.StructField("expected_grade", T.DoubleType()), T.StructField("p_tail", T.DoubleType()), T.StructField("kept", T.BooleanType())]


def classify(df: DataFrame, model: OrdinalModel | None, tail: int = 2, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Adds the expected grade, P(grade >= ``tail``) and ``kept`` (that probability is at least ``least``).

    A null text is judged like an empty one. Without a model both numbers are
    null and every row is kept. Repeated rows are judged alike, an empty table
    gives an empty one, input columns named like a result are replaced.
    """
    at = position(df, text_col)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                if model is None:
                    yield part, [pa.nulls(part.num_rows, pa.float64())] * 2 + [pa.array([True] * part.num_rows)]
                    continue
                scores = np.array([model.weights[features(t)].sum() for t in part.column(at).to_pylist()])
                above = model.above(scores)
                p_tail = above[:, tail - 1]
                yield part, [pa.array(above.sum(axis=1)), pa.array(p_tail), pa.array(p_tail >= least)]

    return append_columns(df, make, FIELDS)
