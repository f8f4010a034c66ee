"""Line-first quality rules.

Every line is judged alone by punctuation, navigation and boilerplate rules;
lines that fail are removed, and a document that loses too much of its text is
rejected. Row-wise: no shuffle, memory bounded by one slice of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlight.llm.common import append_columns, position, slices

ASCII_SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
#: Marks between the entries of menus and breadcrumbs.
SEPARATORS = "|»›•·>"
BOILERPLATE = re.compile(
    r"all rights reserved|copyright|©|released under the|licensed under|terms of (?:use|service)|privacy policy|cookie"
    r"|click here|sign (?:in|up)\b|log ?in\b|subscribe|newsletter|enable javascript|lorem ipsum|read more|share this",
    re.IGNORECASE,
)
#: A word that ends a sentence: its mark may be followed by closing quotes or brackets.
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?=\s|$)")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; shares are of the line's words."""

    words_per_sentence: int = 80  # punctuation: a line needs a sentence end per so many words
    max_sentence_ends: float = 0.6  # punctuation: most words ending a sentence is shouting
    max_symbols: float = 0.3  # navigation: symbol characters per word
    max_separators: float = 0.2  # navigation: separator characters per word
    max_repeats: float = 0.3  # navigation: words equal to the one before
    max_capitals: float = 0.6  # boilerplate: words in capitals
    boilerplate_words: int = 40  # boilerplate phrases count in lines up to so many words
    max_loss: float = 0.5  # share of the text a document may lose


def line_fails(line: str, words: list[str], rules: LineRules) -> bool:
    """The verdict on one line that has a word."""
    n = len(words)
    ends = len(SENTENCE_END.findall(line))
    if ends * rules.words_per_sentence < n and not (n < 3 and ends):
        return True
    if n >= 5 and ends > rules.max_sentence_ends * n:
        return True
    if sum(map(line.count, SYMBOLS)) > rules.max_symbols * n or sum(map(line.count, SEPARATORS)) > rules.max_separators * n:
        return True
    if n >= 5 and sum(map(eq, words, words[1:])) > rules.max_repeats * n:
        return True
    if n >= 5 and sum(map(str.isupper, words)) > rules.max_capitals * n:
        return True
    return n <= rules.boilerplate_words and BOILERPLATE.search(line) is not None


def repeated_words(words: list, size: int = 5) -> int:
    """Words covered by windows of ``size`` words that occur at least twice; exact for any length."""
    if len(words) <= size:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    vocabulary = len(known)
    if vocabulary == len(words):
        return 0
    if vocabulary**size < 2**63:
        key = ids[: len(ids) - size + 1].copy()
        for k in range(1, size):
            key = key * vocabulary + ids[k : len(ids) - size + 1 + k]
    else:  # number the windows of 2, 3, ... words instead, so that numbers stay below the length
        key = ids
        for k in range(1, size):
            _, key = np.unique(key[:-1] * vocabulary + ids[k:], return_inverse=True)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(size):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def judge(text: str | None, rules: LineRules) -> tuple:
    """All columns of one document."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, ASCII_SPACE))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    kept: list[str] = []
    n_dup = n_lines = n_removed = total = left = 0
    for line in text.split("\n"):
        if not line.strip(ASCII_SPACE):
            if kept:
                kept.append(line)
            continue
        n_lines += 1
        if line in seen:
            n_dup += 1
        seen.add(line)
        tokens = line.split()
        size = len(line.strip())
        total += size
        if tokens and line_fails(line, tokens, rules):
            n_removed += 1
        else:
            left += size
            kept.append(line)
    n_repeat = repeated_words(words)
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    share = left / total if total else 0.0
    ok = not failed and share >= 1 - rules.max_loss
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, ok, n_lines, n_removed, share, "\n".join(kept)


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_lines_removed", T.LongType()),
    T.StructField("kept_share", T.DoubleType()),
    T.StructField("clean_text", T.StringType()),
]
ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64(), pa.string()]


def quality_rules(df: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """Adds counts, verdict (``kept``) and the text without failed lines (``clean_text``).

    Null and empty texts have no word: all counts are 0, ``base_failed`` is
    true and ``clean_text`` is empty. Repeated rows are judged alike; an empty
    table gives an empty one. Columns of the input that have the name of a
    result are replaced; all others, null or not, stay as they are.
    """
    at = position(df, text_col)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                rows = [judge(t, rules) for t in part.column(at).to_pylist()]
                yield part, [pa.array(column, kind) for column, kind in zip(zip(*rows), ARROW)]

    return append_columns(df, make, FIELDS)
