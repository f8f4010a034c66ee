"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cartlight.llm import queries, spelling
from tests.llm.conftest import ROWS

SF = "/root/testdata/sf0.001"


def plain_counts(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    words = plain_counts(rows)
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), form[w] and words[form[w]])
    return out


def result(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made_rows():
    """Words with variants in chains and ties, accented letters, letters beyond U+00FF, very long words."""
    rng = random.Random(8)
    rows = list(ROWS) + [(50, "×÷abc× Étéés Étéés Étéés étéés ābcdefg中bcdefg")]
    long = "".join(rng.choice("abcde") for _ in range(70_000))
    rows += [(51, " ".join([long] * 7)), (52, " ".join([long[:-1]] * 3)), (53, " ".join([long[:100] + "z" + long[101:]] * 3))]
    for k in range(80):
        word = "".join(rng.choice("abcdéÿ") for _ in range(rng.randint(5, 7)))
        for n in (40, 18, 8, 3):
            rows.append((100 + len(rows), " ".join([word] * n)))
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :] + "x", word[:at] + rng.choice("abcdé") + word[at:], word[:at] + rng.choice("abcd") + word[at + 1 :]])
    return rows


@pytest.mark.parametrize("block", [2048, 20])
def test_against_all_pairs(docs_of, monkeypatch, block):
    """With small blocks every choice of classes is too coarse, so blocks are dealt to parts."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    if block < 2048:
        monkeypatch.setattr(spelling, "CLASSES", (1, 2))
    rows = made_rows()
    expected = plain_variants(rows)
    assert sum(v[0] is not None for v in expected.values()) > 50 and any(len(w) > 60_000 and v[0] for w, v in expected.items())
    assert result(spelling.spelling_variants(docs_of(rows))) == expected


def test_many_classes_give_the_same(docs_of, monkeypatch):
    rows = made_rows()
    monkeypatch.setattr(spelling, "BLOCK", 1)
    assert result(spelling.spelling_variants(docs_of(rows))) == plain_variants(rows)


def test_edits_of_all_short_words():
    words = sorted({"".join(t).encode() for n in range(1, 5) for t in np.array(np.meshgrid(*[list("abc")] * n)).T.reshape(-1, n)})
    held = spelling.Words(words, np.ones(len(words), dtype=np.int64))
    i, j = spelling.near_pairs(held, held, True)
    texts = [w.decode() for w in words]
    assert {*zip(i.tolist(), j.tolist())} == {(a, b) for b in range(len(texts)) for a in range(b) if one_edit(texts[a], texts[b])}


def test_edges(docs_of):
    assert spelling.spelling_variants(docs_of([])).count() == 0
    assert spelling.spelling_variants(docs_of([(1, None), (2, ""), (None, "abcd 12 中")])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs_of([]), ratio=1)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = queries.op12_spelling_variants(spark, SF)
    assert df.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert result(df) == plain_variants(rows)
