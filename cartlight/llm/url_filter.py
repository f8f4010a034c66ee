"""URL filter: host and path rules first, a learned model for the rest.

The model is a logistic regression on hashed character n-grams of host and
path, fitted in numpy on a small labelled table of URLs. Row-wise: no shuffle;
the weights (256 KB) travel with the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartlight.llm.common import append_columns, position, slices

BITS = 15
SIZES = (2, 3, 4, 5)
ASCII_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}

#: The labelled table (host, path, block).
LABELLED = [
    ("en.wikipedia.org", "/wiki/Astronomy", 0), ("docs.python.org", "/3/library/json.html", 0), ("www.nature.com", "/articles/physics", 0),
    ("news.bbc.co.uk", "/world/europe", 0), ("arxiv.org", "/abs/1706.03762", 0), ("www.gutenberg.org", "/ebooks/1342", 0),
    ("stackoverflow.com", "/questions/tagged/sql", 0), ("www.nasa.gov", "/missions", 0), ("blog.museum.org", "/history/2019", 0),
    ("library.university.edu", "/catalog/item/22", 0), ("www.who.int", "/health-topics/nutrition", 0), ("weather.city.gov", "/forecast", 0),
    ("recipes.kitchen.com", "/soup/lentil", 0), ("www.school.edu", "/courses/algebra", 0), ("developer.company.com", "/guide/install", 0),
    ("www.journal.net", "/science/article/12", 0), ("shop.books.com", "/novels/classic", 0), ("m.example.org", "/en/about", 0),
    ("forum.garden.net", "/thread/tomatoes", 0), ("archive.paper.com", "/2004/05/story", 0), ("www.travel.org", "/fr/paris", 0),
    ("blog.example.com", "/de/artikel/4", 0), ("magazine.example.net", "/es/noticias/9", 0), ("www.example.org", "/en/page/100", 0),
    ("best-casino-bonus.xyz", "/free-spins", 1), ("poker-online-win.biz", "/jackpot/bonus", 1), ("cheap-viagra-pills.info", "/buy-now", 1),
    ("xxx-adult-cams.tv", "/live/nude", 1), ("hot-porn-videos.club", "/xxx/watch", 1), ("payday-loans-fast.top", "/apply-now", 1),
    ("win-free-iphone.click", "/prize/claim", 1), ("crack-keygen-warez.ru", "/download/serial", 1), ("torrent-pirate-movies.to", "/download", 1),
    ("seo-backlinks-cheap.xyz", "/buy/links", 1), ("replica-watches-sale.biz", "/rolex-cheap", 1), ("sex-dating-tonight.club", "/adult/meet", 1),
    ("slots-casino-777.com", "/casino/slots", 1), ("bet-sports-odds.net", "/betting/bonus", 1), ("diet-pills-miracle.info", "/weight-loss-trick", 1),
    ("make-money-fast.top", "/crypto/giveaway", 1), ("free-download-crack.org", "/keygen/full", 1), ("escort-girls.example.com", "/xxx", 1),
    ("online-casino.example.net", "/bonus/casino", 1), ("viagra.example.org", "/pills/cheap", 1), ("click-track-ads.click", "/redirect/ad", 1),
    ("spam-mail-lists.biz", "/buy-emails", 1), ("hacked-accounts.ru", "/warez/dump", 1), ("lottery-winner.top", "/claim-prize", 1),
]

#: (host, path, action); a rule also holds for subdomains of its host.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:]
    ends = [i for i in map(path.find, "?#") if i >= 0]
    return rest[:cut].translate(ASCII_LOWER), path[: min(ends, default=len(path))]


def ngrams(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and of path, each with its bounds marked."""
    found = set()
    for name, part in (("h", f"^{host}$"), ("p", f"^{path.lower()}$")):
        for size in SIZES:
            for i in range(len(part) - size + 1):
                found.add(zlib.crc32(f"{name}{part[i:i + size]}".encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1))
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


def score(features: np.ndarray, weights: np.ndarray) -> float:
    """Log-odds of block; the mean over n-grams, so that length alone decides nothing."""
    return float(weights[-1] + weights[features].sum() / np.sqrt(max(1, len(features))))


def fit(rows: Sequence[tuple[str, str, int]], steps: int = 1500, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Full-batch gradient descent; weights by bucket, the bias last. No rows: all zero (nothing is blocked)."""
    weights = np.zeros((1 << BITS) + 1)
    if not rows:
        return weights
    features = [ngrams(h, p) for h, p, _ in rows]
    flat = np.concatenate(features)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in features])
    value = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(rows))))
    target = np.array([y for *_, y in rows], dtype=float)
    for _ in range(steps):
        logit = weights[-1] + np.bincount(owner, weights[flat], len(rows)) * value
        error = (1 / (1 + np.exp(-logit)) - target) / len(rows)
        gradient = np.bincount(flat, (error * value)[owner], len(weights)) + decay / len(rows) * weights
        gradient[-1] = error.sum()
        weights -= rate * len(rows) ** 0.5 * gradient
    return weights


class RuleTable:
    """Rules by host; a url is looked up under its host and every parent domain."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, action in rules:
            self.by_host.setdefault(host, []).append((path, action))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest rule that fits; of equal ones the first in order of text."""
        best = None
        while host:
            for prefix, action in self.by_host.get(host, ()):
                if path.startswith(prefix):
                    name = f"{host}{prefix}"
                    key = (-len(name), name, action)
                    best = min(best or key, key)
            host = host.partition(".")[2]
        return best and (best[1], best[2])


FIELDS = [
    T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("p_block", T.DoubleType()),
]


def filter_urls(
    df: DataFrame,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    labelled: Sequence[tuple[str, str, int]] = LABELLED,
    threshold: float = 0.5,
) -> DataFrame:
    """Adds host, path, rule, verdict and the model's probability of block.

    A null url and one without ``://`` have empty host and path; no rule fits
    an empty host, so the model decides. Both tables are small parameters that
    travel with the task (rules: some thousands at most). Repeated rows get
    equal results; input columns named like a result are replaced.
    """
    at = position(df, url_col)
    weights = fit(list(labelled))
    table = RuleTable(rules)

    def judge(url: str | None) -> tuple:
        host, path = split_url(url)
        p_block = 1 / (1 + np.exp(-score(ngrams(host, path), weights)))
        hit = table.match(host, path)
        return (host, path, *(hit or (None, "block" if p_block > threshold else "allow")), float(p_block))

    def make(batches: Iterator[pa.RecordBatch]):
        kinds = [pa.string()] * 4 + [pa.float64()]
        for batch in batches:
            for part in slices(batch, 2048):
                rows = [judge(u) for u in part.column(at).to_pylist()]
                yield part, [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]

    return append_columns(df, make, FIELDS)
