"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The classifier is trained from a small labelled table of URLs (at most
``MAX_LABELLED`` rows, checked). An n-gram falls in one of 4,096 cells, named by
the first three hex digits of its md5, so Spark and any SQL engine agree on it.
Judging is column expressions only: the weights are one constant array.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no rule, and is judged by the bias alone; an empty labelled table or one with a
single verdict gives a constant verdict.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 4096
SIZES = (3, 4, 5)
MAX_LABELLED = 20_000

#: (url, is it unwanted): the labelled table used where the caller gives none.
LABELLED: tuple[tuple[str, bool], ...] = tuple(
    (url, True) for url in (
        "http://casino-win.example.com/en/12", "https://www.casino-royal.example.org/en/play.html", "http://best-casino.example.net/fr/4",
        "https://blog.win-casino.example.com/de/910/", "http://cheap-pills.example.com/en/33.html", "https://m.cheap-pills.example.org/es/7",
        "http://pills-online.example.net/en/buy", "https://www.cheap-meds.example.com/fr/81", "http://free-bets.example.com/en/5",
        "https://bets-free.example.net/de/62.html", "http://m.free-spins.example.org/en/41/", "https://blog.sports-bets.example.com/en/9",
        "http://ads-track.example.com/en/77", "https://track-ads.example.net/fr/3", "http://www.ads-click.example.org/de/15.html",
        "https://m.click-track.example.com/en/208/", "http://adult-x.example.com/en/18", "https://www.adult-cams.example.net/es/69.html",
        "http://x-adult.example.org/en/4/", "https://blog.adult-video.example.com/fr/55", "http://spam-farm.example.org/en/1",
        "https://m.link-farm.example.com/de/320", "http://www.spam-links.example.net/en/6.html", "https://farm-spam.example.com/es/11/",
        "http://payday-loans.example.com/en/90", "https://quick-loans.example.org/en/2.html", "http://warez-free.example.net/en/14",
        "https://cracked-warez.example.com/de/5/", "http://replica-watch.example.org/fr/66", "https://seo-backlinks.example.com/en/27",
    )
) + tuple(
    (url, False) for url in (
        "http://news.example.com/en/12", "https://www.thenews.example.org/en/story.html", "http://library.example.net/fr/4",
        "https://blog.garden.example.com/de/910/", "http://city-museum.example.com/en/33.html", "https://m.weather.example.org/es/7",
        "http://recipes-online.example.net/en/soup", "https://www.open-maths.example.com/fr/81", "http://free-software.example.com/en/5",
        "https://history.example.net/de/62.html", "http://m.trains.example.org/en/41/", "https://blog.sports-club.example.com/en/9",
        "http://thother.example.com/en/77", "https://thenth.example.net/fr/3", "http://www.thering.example.org/de/15.html",
        "https://m.tionsh.example.com/en/208/", "http://therea.example.com/en/18", "https://www.thonand.example.net/es/69.html",
        "http://enther.example.org/en/4/", "https://blog.thanes.example.com/fr/55", "http://astronomy.example.org/en/1",
        "https://m.translation.example.com/de/320", "http://www.school-links.example.net/en/6.html", "https://farmers.example.com/es/11/",
        "http://university.example.com/en/90", "https://quick-start.example.org/en/2.html", "http://wiki.example.net/en/14",
        "https://hospital.example.com/de/5/", "http://bird-watch.example.org/fr/66", "https://docs.example.com/en/27",
        "http://m.thth.example.net/en/5501?page=2", "https://ththat.example.org/de/700", "http://www.erin.example.com/es/31/",
        "https://blog.honest.example.net/fr/8#top", "http://on.example.org/en/64.html", "https://parliament.example.com/en/3",
    )
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(found, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The name of the longest rule that fits, or null. A rule holds for its host and all subdomains."""
    def fits(rule: Rule) -> Column:
        return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)

    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(r), F.lit(r.name)) for r in ordered])


def _cells(text: str) -> list[int]:
    return [int(hashlib.md5(text[i:i + n].encode()).hexdigest()[:3], 16)
            for n in SIZES for i in range(len(text) - n + 1)]


def train(labelled: Sequence[tuple[str, bool]] = LABELLED, rounds: int = 400, rate: float = 1.0,
          penalty: float = 1e-3) -> tuple[float, np.ndarray]:
    """Bias and weight per cell, by full gradient steps from zero; features are n-gram shares."""
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"at most {MAX_LABELLED} labelled URLs")
    weights, bias = np.zeros(CELLS), 0.0
    if not labelled:
        return bias, weights
    x = np.zeros((len(labelled), CELLS))
    for row, (url, _) in zip(x, labelled, strict=True):
        after = url.split("://", 1)[1] if "://" in url else ""
        after = after.split("#", 1)[0].split("?", 1)[0]
        host, slash, rest = after.partition("/")
        cells = _cells(_marked(host.lower(), slash + rest))
        np.add.at(row, cells, 1.0)
        row *= 10.0 / max(1, len(cells))
    y = np.array([bad for _, bad in labelled], dtype=float)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ weights + bias))) - y
        weights -= rate * (x.T @ error / len(y) * 10 + penalty * weights)
        bias -= rate * error.mean()
    return float(bias), np.round(weights, 6)


def _marked(host: str, path: str) -> str:
    return f"^{host}|{path}$"


def logit(host: Column, path: Column, bias: float, weights: np.ndarray) -> Column:
    """Log odds that a URL is unwanted."""
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    # Characters side by side, not substrings, which would count from the start of the URL each time.
    letters = F.split(text, "")

    def total(n: int) -> Column:
        grams = letters
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(letters, k + 1, F.greatest(F.size(letters) - k, F.lit(0))), lambda a, b: F.concat(a, b))
        parts = F.transform(F.filter(grams, lambda g: g.isNotNull()), lambda g: F.get(
            table, F.conv(F.substring(F.md5(g.cast("binary")), 1, 3), 16, 10).cast("int")))
        return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)

    n_grams = reduce(lambda a, b: a + b, [F.greatest(F.length(text) - (n - 1), F.lit(0)) for n in SIZES])
    return F.lit(bias) + 10.0 * reduce(lambda a, b: a + b, map(total, SIZES)) / F.greatest(n_grams, F.lit(1))


def judge(pages: DataFrame, keep: list[str], url: str, rules: Sequence[Rule],
          labelled: Sequence[tuple[str, bool]] = LABELLED) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule``, ``verdict`` and ``logit`` of each URL.

    The rule's verdict holds where one fits, else the classifier's: block from log odds of 0.
    """
    bias, weights = train(labelled)
    verdicts = {r.name: r.verdict for r in rules}
    parts = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = parts.withColumns({"rule": rule_for(host, path, rules), "logit": logit(host, path, bias, weights)})
    by_rule = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col("rule") == n, F.lit(v)) for n, v in verdicts.items()])
    return judged.select(*keep, "host", "path", "rule",
                         F.coalesce(by_rule, F.when(F.col("logit") >= 0, "block").otherwise("allow")).alias("verdict"),
                         F.round("logit", 6).alias("logit"))


def duck_sql(rules: Sequence[Rule], labelled: Sequence[tuple[str, bool]] = LABELLED) -> str:
    """The same judgement of ``pages`` as DuckDB SQL."""
    bias, weights = train(labelled)
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
                    for r in ordered)
    verdict = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in ordered)
    cell = "CAST('0x' || md5(substr(marked, i, {n}))[1:3] AS INTEGER)"
    sums = " + ".join(
        f"coalesce(list_sum(list_transform(range(1, greatest(length(marked) - {n - 1}, 0) + 1), lambda i: w[1 + {cell.format(n=n)}])), 0.0)"
        for n in SIZES)
    count = " + ".join(f"greatest(length(marked) - {n - 1}, 0)" for n in SIZES)
    table = ", ".join(f"{w:.6g}" for w in weights)
    return f"""
WITH parts AS (
    SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw_host,
           coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), hosts AS (
    SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), model AS (
    SELECT CAST([{table}] AS DOUBLE[]) AS w
), scored AS (
    SELECT page_id, host, path, CASE {rule} END AS rule,
           {bias!r} + 10.0 * ({sums}) / greatest({count}, 1) AS logit
    FROM (SELECT *, '^' || host || '|' || path || '$' AS marked FROM hosts), model
)
SELECT page_id, host, path, rule,
       coalesce(CASE rule {verdict} END, CASE WHEN logit >= 0 THEN 'block' ELSE 'allow' END) AS verdict,
       round(logit, 6) AS logit
FROM scored
"""
