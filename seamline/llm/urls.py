"""URL filter: rules on hosts and paths, and boosted trees on lexical features for the urls that no rule covers.

Rules name a verdict, a host and the start of a path; a rule fits its host and all its subdomains, the longest one wins.
They are expressions, so they cost a scan of the url column. Urls that a rule covers are the labelled ones the trees learn
from: lengths, depths, share of digits, entropy of characters, number of parameters, and how often urls of a suffix
(last label, last two labels, whole host) or of a first path segment are blocked. A url's own label never enters these
shares: they come from the half of the fitting sample that the url is not in; urls to be judged get both halves.

Spark: the trees are fitted on a sample of about ``fit_rows`` labelled rows at most, chosen by hash; their histograms are aggregates over
tasks. The shares' table has at most ``fit_rows`` / ``SEEN`` entries a kind, so what tasks get with the model is bounded. All
urls are judged in one narrow pass of Arrow batches; nothing but the sample is shuffled.

Defined cases: a null url, or one without ``://``, has an empty host and path; urls that no rule covers are blocked when the
trees' log-odds are over 0; without labelled urls everything else is allowed, with labels of one kind that kind is the verdict; repeated rows
get one verdict; an empty table gives an empty result; urls of any length are whole; input columns named like an added one are replaced, all others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators import boosting

#: Bound on labelled rows that the trees are fitted on.
FIT_ROWS = 65_536
#: Least number of labelled urls behind a share; what a share of fewer urls would be drawn to.
SEEN, PRIOR = 8, 4.0
SHAPE = boosting.Shape(loss="logistic", trees=16, depth=3, bins=32, rate=0.4)
FEATURES = (
    "length", "host_length", "host_depth", "path_depth", "path_length", "query_length", "digit_ratio", "host_digits", "hyphens",
    "host_entropy", "path_entropy", "parameters", "last_label", "last_two", "whole_host", "first_segment",
)
ADDED = ("host", "path", "rule", "verdict", "score")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits; ``rules``: (verdict, host/path), first of equals wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last one tested stands outermost
        name, start = text.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def entropy(text: str) -> float:
    """Bits per character, rounded so that the order of addition does not show."""
    n = len(text)
    return round(-sum(k / n * math.log2(k / n) for k in sorted(Counter(text).values())), 9) if n else 0.0


def suffixes(host: str, path: str) -> tuple[str, str, str, str]:
    labels = host.split(".")
    return "1" + labels[-1], "2" + ".".join(labels[-2:]), "h" + host, "p" + path.split("/", 2)[1] if path.startswith("/") else "p"


def lexical(url: str, host: str, path: str) -> list[float]:
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(map(str.isdigit, url))
    return [
        len(url), len(host), len(host.split(".")) if host else 0, sum(map(bool, path.split("/"))), len(path), len(query), digits / len(url) if url else 0.0,
        sum(map(str.isdigit, host)), host.count("-"), entropy(host), entropy(path + query), len([p for p in re.split("[&;]", query) if p]),
    ]


def share(seen: dict, suffix: str) -> float:
    """Share of blocked urls, drawn to a half; suffixes seen too seldom are a half."""
    blocked, n = seen.get(suffix, (0, 0))
    return (blocked + PRIOR / 2) / (n + PRIOR)


def _suffix_counts(sample: DataFrame) -> list[dict]:
    """Per half of the sample, and for all of it: {suffix: (blocked, urls)}, of suffixes with ``SEEN`` urls or more in it."""
    names = F.pandas_udf(lambda host, path: pd.Series([list(suffixes(h, p)) for h, p in zip(host, path, strict=True)]), "array<string>")
    rows = sample.select("half", "blocked", F.explode(names("host", "path")).alias("suffix"))
    counted = rows.groupBy("suffix").agg(*[F.sum(F.when(F.col("half") == k, v).otherwise(0)).alias(f"{n}{k}") for k in (0, 1) for n, v in (("n", F.lit(1)), ("b", F.col("blocked")))])
    out: list[dict] = [{}, {}, {}]
    for r in counted.where(f"n0 + n1 >= {SEEN}").collect():
        sums = (r["b0"], r["n0"]), (r["b1"], r["n1"]), (r["b0"] + r["b1"], r["n0"] + r["n1"])
        for seen, pair in zip(out, sums, strict=True):
            if pair[1] >= SEEN:
                seen[r["suffix"]] = pair
    return out


def _features(url, host, path, seens) -> np.ndarray:
    return np.array([lexical(u, h, p) + [share(seen, s) for s in suffixes(h, p)] for u, h, p, seen in zip(url, host, path, seens, strict=True)], float).reshape(len(url), len(FEATURES))


class Judge:
    """Trees and shares; a callable from urls to log-odds of being blocked."""

    def __init__(self, model: boosting.Boosted, seen: dict):
        self.model, self.seen = model, seen

    def log_odds(self, url: pd.Series, host: pd.Series, path: pd.Series) -> np.ndarray:
        return self.model.predict(_features(url.fillna(""), host, path, [self.seen] * len(url)))

    def column(self, url: Column, host: Column, path: Column) -> Column:
        return F.pandas_udf(lambda u, h, p: pd.Series(self.log_odds(u, h, p)), "double")(url, host, path)


def learn(labelled: DataFrame, fit_rows: int = FIT_ROWS, shape: boosting.Shape = SHAPE) -> Judge:
    """Fit on (nth, url, host, path, blocked 0 or 1): all rows, or a sample of about ``fit_rows`` rows by hash of nth and url."""
    rows = labelled.select("nth", F.coalesce("url", F.lit("")).alias("url"), "host", "path", F.col("blocked").cast("int").alias("blocked"))
    most, n = 1 << 30, rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("url", "nth"), F.lit(most)) < int(most * (fit_rows / n)))
    sample = boosting.durable(rows.select("url", "host", "path", "blocked", F.pmod(F.xxhash64("nth", "url"), F.lit(2)).cast("int").alias("half")))
    first, second, both = _suffix_counts(sample)
    other = (second, first)

    def features(url, host, path, half):
        return pd.DataFrame(_features(url, host, path, [other[k] for k in half]), columns=FEATURES)

    schema = ", ".join(f"{c} double" for c in FEATURES)
    data = sample.select("blocked", F.pandas_udf(features, schema)("url", "host", "path", "half").alias("f")).select("blocked", "f.*")
    return Judge(boosting.fit(data, FEATURES, "blocked", shape=shape), both)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", key: str = "page_id", fit_rows: int = FIT_ROWS, shape: boosting.Shape = SHAPE) -> DataFrame:
    """Add host, path, rule (null if none fits), verdict (allow or block) and score (log-odds of the trees, null where a rule decides)."""
    host, path = parts(F.col(url))
    rule, said = rule_for(host, path, rules)
    labelled = pages.select(F.col(url).alias("url"), F.col(key).alias("nth"), host.alias("host"), path.alias("path"), (said == "block").cast("int").alias("blocked"))
    found = learn(labelled.where("blocked is not null"), fit_rows, shape)
    base = pages.drop(*ADDED) if url not in ADDED else pages.drop(*(set(ADDED) - {url}))
    score = F.when(rule.isNull(), found.column(F.coalesce(F.col(url), F.lit("")), host, path))
    out = base.withColumns({"host": host, "path": path, "rule": rule, "score": score})
    return out.withColumn("verdict", F.when(F.col("rule").isNotNull(), said).when(F.col("score") > 0, "block").otherwise("allow"))
