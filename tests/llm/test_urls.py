"""URL filter: rules against a plain version, trees by held-out accuracy."""

import re

import numpy as np

from seamline.llm import urls
from seamline.llm.q_urls import RULES


def plain(url):
    """(host, path, rule, verdict by rule)."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "https://example.net/en", "https://example.net/en/", "https://net/", "https://a.net", "https://a.net?q=/en/", "http://anet/",
    "http://xexample.net/en/1", "http://example.com/de/1", "http://b.example.com/de", "http://www.org/fr/ü?a=1&b=2;c", "http://o.org/FR/", "http://u@h.net:80/", "a://b://c.net/d", "http://É.NET/x", "http://a.net/" + "p" * 100_000,
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(URLS * 2)], "page_id long, url string, score string")
    got = urls.judge(pages, RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = plain(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert (r.score is None) == (rule is not None)
    assert len({(r.url, r.verdict) for r in got}) == len(URLS)  # copies agree


def test_extra_columns_stay(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "mine", "h")], "page_id long, url string, blocked string, half string")
    r = urls.judge(pages, RULES).first()
    assert (r.blocked, r.half, r.verdict) == ("mine", "h", "block")


def test_without_labels_or_with_one_kind(spark):
    none = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(none, RULES).collect()} == {"allow"}
    one = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.net/y"), (3, "http://a.com/z")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(one, RULES).orderBy("page_id").collect()] == ["block", "block", "block"]
    assert urls.judge(none.where("false"), RULES).collect() == []


def made(n):
    """Blocked urls have many digits and hyphens, and hosts under one suffix; a tenth of the labels are wrong."""
    pick = np.random.default_rng(1)
    for i in range(n):
        bad = bool(pick.integers(2))
        name = "".join(pick.choice(list("abcdefgh"), 8))
        host = f"{name}-{i}-x.{'spam' if bad and pick.random() < 0.7 else 'shop'}.test" if bad else f"{name}.{pick.choice(['shop', 'news'])}.test"
        yield i, f"https://{host}/{'p' * int(pick.integers(1, 9))}/{i if bad else 'a'}?{'&'.join(['k=1'] * int(pick.integers(0, 3)))}", int(bad != (pick.random() < 0.1)), bad


def test_trees_hold_out(spark):
    rows = list(made(3000))
    df = spark.createDataFrame([r[:3] for r in rows], "nth long, url string, blocked int")
    host, path = urls.parts(df.url)
    df = df.withColumns({"host": host, "path": path})
    judge = urls.learn(df.where("nth % 3 > 0"))
    test = df.where("nth % 3 = 0").withColumn("score", judge.column(df.url, host, path)).collect()
    right = sum((r.score > 0) == rows[r.nth][3] for r in test) / len(test)
    assert right > 0.97
    again = urls.learn(df.where("nth % 3 > 0").repartition(7))  # not by partitions
    assert np.allclose([r.score for r in test], [r.score for r in df.where("nth % 3 = 0").withColumn("score", again.column(df.url, host, path)).collect()])


def test_fit_is_on_a_bounded_sample(spark):
    df = spark.range(4000).selectExpr("id as nth", "concat('http://h', id % 50, '.net/', id) as url", "cast(id % 50 < 20 as int) as blocked")
    host, path = urls.parts(df.url)
    judge = urls.learn(df.withColumns({"host": host, "path": path}), fit_rows=500)
    assert sum(n for s, (_, n) in judge.seen.items() if s.startswith("1")) < 800
