"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cartlight.llm import piece_bpe, queries
from cartlight.llm.queries import PIECES
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def vocabulary():
    return piece_bpe.load_model(PIECES)


def odd_texts(vocabulary, n=400):
    rng = random.Random(3)
    pieces = [p for p in vocabulary.pieces if len(p) > 1]
    letters = ["aba", "ab", "  ", " ", "\t\t", "\n", "==", "---", "\\", ";;", "é", "🙂", "中", "▁", "<0x0A>", "\x00"]
    out = ["", " ", "  ", "a ", " a  b   c" + " " * 40 + "d", "aaaa" * 2000, "ab" * 700 + " " + " " * 1500 + "x", "word " * 20_000, "中文字" * 300]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(n)]
    return out + ["".join(rng.choice("etaonish") for _ in range(rng.randint(400, 700))) for _ in range(20)]


def test_rounds_equal_the_library(library, vocabulary):
    texts = odd_texts(vocabulary)
    encoder = piece_bpe.Encoder(vocabulary)
    for _ in range(2):  # the second time from remembered words
        got = [np.frombuffer(r, "<i4").tolist() for at in range(0, len(texts), 100) for r in encoder.encode_batch(texts[at : at + 100])]
        assert got == [library.encode(t) for t in texts]


def test_heap_equals_rounds(vocabulary, monkeypatch):
    texts = odd_texts(vocabulary, 100)
    usual = piece_bpe.Encoder(vocabulary).encode_batch(texts)
    monkeypatch.setattr(piece_bpe, "LONG_SEGMENT", 1)
    assert piece_bpe.Encoder(vocabulary).encode_batch(texts) == usual


def test_a_better_new_pair_comes_first():
    """Merging the first ``ab`` makes ``abx``, which is to come before the second ``ab`` and leaves it no partner for ``xab``."""
    names = ["a", "b", "x", "▁", "abx", "xab", "ab", "▁▁"]
    v = piece_bpe.Vocabulary(names, np.array([9, 9, 9, 9, 0, 1, 2, 3], dtype=np.int32), np.zeros(256, np.int32), np.full(len(names), -1), np.zeros(len(names), bool))
    merger = piece_bpe.Merger(v)
    [ids] = merger.encode(["abxab"])
    assert [names[i] for i in np.frombuffer(ids, "<i4")] == ["abx", "ab"]


def test_decoding_any_ids(library, vocabulary):
    rng = random.Random(5)
    rows = [[rng.choice([rng.randrange(32_000), rng.randint(3, 258), 28705, 1, 2, 0]) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    ends = np.cumsum([len(r) for r in rows])
    flat = np.concatenate([np.array(r, dtype=np.int32) for r in rows])
    got = piece_bpe.Decoder(vocabulary).decode_batch(flat, ends - [len(r) for r in rows], ends)
    assert got == [library.decode(r) if r else "" for r in rows]


def test_tables(spark, docs_of, library):
    """Nulls, empty, blank and long texts, repeated rows, clashing names (``ids``), an empty table."""
    docs = docs_of(ROWS).withColumn("N_tokens", F.lit("x")).withColumn("decoded", F.lit(1))
    rows = piece_bpe.decode_ids(piece_bpe.encode_texts(docs, PIECES), PIECES)
    assert rows.columns == ["doc_id", "text", "source", "KEPT", "copy", "ids", "n_tokens", "decoded"]
    for r in rows.collect():
        expected = library.encode(r.text or "")
        assert (r.ids, r.n_tokens, r.decoded) == (expected, len(expected), library.decode(expected) if expected else "")
    assert piece_bpe.decode_ids(piece_bpe.encode_texts(docs.limit(0), PIECES), PIECES).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [1, None, 264, None, 2]), (4, [None])], "k long, ids array<int>")
    assert {r.k: r.decoded for r in piece_bpe.decode_ids(ids, PIECES).collect()} == {1: None, 2: "", 3: library.decode([1, 264, 2]), 4: ""}


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *digests]
