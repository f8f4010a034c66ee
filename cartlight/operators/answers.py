"""Answer scoring over tables (N family) and the scorer registry (S1).

Scorers are functions ``(solution, truth) -> score`` of columns. Backslashes
below are single characters of the text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.text import normalize_space, occurrences

Scorer = Callable[[Column, Column], Column]
SCORERS: dict[str, Scorer] = {}

# fixed values: substitutions of a final answer, in order
SUBSTITUTIONS = [
    ("an ", ""),
    ("a ", ""),
    (".$", "$"),
    ("\\$", ""),
    ("\\ ", ""),
    (" ", ""),
    ("mbox", "text"),
    (",\\text{and}", ","),
    ("\\text{and}", ","),
    ("\\text{m}", "\\text{}"),
]
# fixed values: units and markup removed from a final answer, in order
REMOVED = [
    "square",
    "ways",
    "integers",
    "dollars",
    "mph",
    "inches",
    "hours",
    "km",
    "units",
    "\\ldots",
    "sue",
    "points",
    "feet",
    "minutes",
    "digits",
    "cents",
    "degrees",
    "cm",
    "gm",
    "pounds",
    "meters",
    "meals",
    "edges",
    "students",
    "childrentickets",
    "multiples",
    "\\text{s}",
    "\\text{.}",
    "\\text{\ns}",
    "\\text{}^2",
    "\\text{}^3",
    "\\text{\n}",
    "\\text{}",
    "\\mathrm{th}",
    "^\\circ",
    "^{\\circ}",
    "\\;",
    ",\\!",
    "{,}",
    '"',
    "\\dots",
]
# fixed values: replacements before two formulas are compared, in order
FORMULA_REPLACEMENTS = [
    ("\n", ""),
    ("\\!", ""),
    ("\\\\", "\\"),
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("^{\\circ}", ""),
    ("^\\circ", ""),
    ("\\$", ""),
]


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def register_scorer(*sources: str):
    """Route sources to a scorer; a source can be taken once."""

    def wrap(fn: Scorer) -> Scorer:
        for source in sources:
            if source in SCORERS:
                raise ValueError(f"source {source} has a scorer already")
            SCORERS[source] = fn
        return fn

    return wrap


def score_table(df: DataFrame, *, source: str = "source", solution: str = "solution", truth: str = "truth") -> DataFrame:
    """Score every row by its source in one CASE; an unknown source is an error."""
    name = F.col(source)
    case = None
    for key, fn in SCORERS.items():
        branch = fn(F.col(solution), F.col(truth))
        case = F.when(name == key, branch) if case is None else case.when(name == key, branch)
    unknown = F.raise_error(F.concat(F.lit("no scorer for source "), F.coalesce(name, F.lit("null")))).cast("double")
    return df.withColumn("score", unknown if case is None else case.otherwise(unknown))


def last_number(text: Column, *, strict: bool = True) -> Column:
    """Number after the last ``####``, or (not strict) the last number of the text."""
    pattern = r"#### (-?[0-9.,]+)" if strict else r"(-?[0-9.,]+)"
    found = F.regexp_extract_all(text, F.lit(pattern), 1)
    if strict:
        return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit(""))
    # a lone dot is not a number unless there is nothing else
    real = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(F.try_element_at(real, F.lit(-1)), F.try_element_at(found, F.lit(1)))


def score_last_number(solution: Column, truth: Column, *, strict: bool = True, format_score: float = 0.0) -> Column:
    answer = last_number(solution, strict=strict)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(format_score)


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    # letters of all languages are parts of words
    return normalize_space(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def tagged_answer(solution: Column) -> Column:
    found = F.regexp_extract_all(solution, F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return F.trim(F.try_element_at(found, F.lit(-1)))


def _qa(solution: Column, matched: Column, answer: Column, full: Column, format_score: float) -> Column:
    return F.when(answer.isNull(), 0.0).when(matched, full).otherwise(format_score)


def score_qa_em(solution: Column, truth: Column, *, format_score: float = 0.0) -> Column:
    """Last tagged answer equals any truth (array); more than ten tags quarter the score."""
    answer = tagged_answer(solution)
    given = normalize_answer(answer)
    matched = F.exists(truth, lambda g: normalize_answer(g) == given)
    many = (occurrences(solution, "<answer>") > 10) | (occurrences(solution, "</answer>") > 10)
    return _qa(solution, matched, answer, F.when(many, 0.25).otherwise(1.0), format_score)


def score_qa_subem(solution: Column, truth: Column, *, format_score: float = 0.0) -> Column:
    """Last tagged answer contains any truth."""
    answer = tagged_answer(solution)
    given = normalize_answer(answer)
    matched = F.exists(truth, lambda g: F.contains(given, normalize_answer(g)))
    return _qa(solution, matched, answer, F.lit(1.0), format_score)


def normalize_final(answer: Column) -> Column:
    """Final answer text cleaned of units and markup."""
    text = F.substring_index(answer, "=", -1)
    text = _replace_all(text, SUBSTITUTIONS + [(r, "") for r in REMOVED])
    text = F.regexp_replace(text, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for macro in ("text", "textbf", "overline"):
        text = F.regexp_replace(text, r"\\" + macro + r"\{(.*?)\}", "$1")
    text = F.regexp_replace(text, r"\\boxed\{(.*)\}", "$1")
    text = F.regexp_replace(text, r"frac([^{])(.)", "frac{$1}{$2}")
    text = F.regexp_replace(text, r"sqrt([^{])", "sqrt{$1}")
    text = F.replace(text, F.lit("$"), F.lit(""))
    digits = F.replace(text, F.lit(","), F.lit(""))
    return F.trim(F.when(digits.rlike(r"^[0-9]+$"), digits).otherwise(text))


def score_answer_line(solution: Column, truth: Column) -> Column:
    """1 when the last ``Answer: ...`` line equals the truth after cleaning, else -1."""
    found = F.regexp_extract_all(solution, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), 1)
    given = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))
    return F.when(normalize_final(given) == normalize_final(truth), 1.0).otherwise(-1.0)


def last_boxed(text: Column, *, tail: int | None = None) -> Column:
    """Inside of the last ``\\boxed{...}`` with balanced braces, else null."""
    seen = text if tail is None else F.right(text, F.lit(tail))
    opener = "\\boxed{"
    rest = F.when(F.contains(seen, F.lit(opener)), F.substring_index(seen, opener, -1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("pos"), F.lit(-1).alias("end"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closed = (acc["end"] < 0) & (depth == 0)
        return F.struct(
            depth.alias("depth"), (acc["pos"] + 1).alias("pos"), F.when(closed, acc["pos"]).otherwise(acc["end"]).alias("end")
        )

    end = F.aggregate(F.split(rest, ""), start, step)["end"]
    return F.when(end >= 0, F.substr(rest, F.lit(1), end))


def score_boxed(solution: Column, truth: Column, *, tail: int | None = 100) -> Column:
    """1 when the last boxed text equals the truth, else -1."""
    return F.when(F.coalesce(last_boxed(solution, tail=tail) == truth, F.lit(False)), 1.0).otherwise(-1.0)


def normalize_formula(text: Column) -> Column:
    """Fixed clean-up rules before two formulas are compared."""
    text = _replace_all(text, FORMULA_REPLACEMENTS)
    text = F.substring_index(text, "\\text{ ", 1)
    text = _replace_all(text, [("\\%", ""), (" .", " 0."), ("{.", "{0.")])
    text = F.when(text.startswith("."), F.concat(F.lit("0"), text)).otherwise(text)
    sides = F.split(text, "=", -1)
    short = (F.size(sides) == 2) & (F.length(F.get(sides, F.lit(0))) <= 2)
    text = F.when(short, F.get(sides, F.lit(1))).otherwise(text)
    text = F.regexp_replace(text, r"\\sqrt([^{])", r"\\sqrt{$1}")
    text = F.replace(text, F.lit(" "), F.lit(""))
    text = F.regexp_replace(text, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    text = F.regexp_replace(text, r"\\frac([^{])\{", r"\\frac{$1}{")
    text = F.when(text == "0.5", F.lit("\\frac{1}{2}")).otherwise(text)
    return F.regexp_replace(text, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def score_boxed_equiv(solution: Column, truth: Column) -> Column:
    """1 when the last boxed formula equals the truth after the clean-up rules, else 0."""
    spaced = F.when(
        F.contains(solution, F.lit("\\boxed ")), F.substring_index(F.substring_index(solution, "\\boxed ", -1), "$", 1)
    )
    given = F.coalesce(spaced, last_boxed(solution))
    same = normalize_formula(given) == normalize_formula(truth)
    return F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(0.0)
