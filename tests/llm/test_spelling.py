"""Spelling variants against all pairs, and the defined cases."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from seamline.llm import spelling


def edit(a, b):
    """One inserted, deleted or replaced code point parts two different words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage, least=6, often=5, factor=5):
    n = Counter()
    for who, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if who is None else who}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    near = {w: [v for v in n if v != w and edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n), key=str)


def got(df):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()), key=str)


def family():
    """Words by edits of a few, so that every kind of edit, shared vectors and chains of forms occur."""
    texts, k = [], 0
    for base in ("kitten", "sitting", "naïveté", "aaaaaa", "abcdefgh", "hgfedcba"):
        words = {base, base + "s", base[1:], base[:-1] + "z", base[:2] + "x" + base[2:], base[:2] + base[3:], base[::-1], "é" + base[1:], base[1] + base[0] + base[2:], base.upper(), base.capitalize() + "Š"}
        for w in sorted(words):
            k += 1
            texts.append((k, " ".join([w] * (5 * k % 37 + 1))))
    texts += [(900, "kitten " * 700 + "kittenz " * 130 + "kittenzz " * 20), (901, None), (902, ""), (903, "x" * 5000 + " " + "x" * 4999 + " 12"), (904, "sitting1sitting_Sitting")]
    return texts + [(903, "x" * 5000 + " " + "x" * 4999 + " 12")] * 4 + [(None, "kitten")]


@pytest.mark.parametrize(("depth", "full", "leaf"), [(0, 16384, 16), (1, 3, 1), (3, 2, 2), (16, 16384, 1)])
def test_near_words_equal_all_pairs(spark, monkeypatch, depth, full, leaf):
    monkeypatch.setattr(spelling, "FULL", full)
    monkeypatch.setattr(spelling, "depth_for", lambda n: depth)
    rows = family()
    docs = spark.createDataFrame([(a, b, "k", 1) for a, b in rows], "doc_id long, text string, key string, n int")
    assert got(spelling.group_variants(docs)) == brute(rows, 0)
    assert got(spelling.group_variants(docs, damage=3)) == brute(rows, 3)


def test_trie_descent_meets_every_pair_once(monkeypatch):
    words = sorted({w for _, t in family() if t and len(t) < 4000 for w in t.split()})
    items = [(w, 1, spelling.vector(w)) for w in words]
    for leaf in (1, 4, 100):
        monkeypatch.setattr(spelling, "LEAF", leaf)
        found = []
        for left in ("same", "less"):
            by_size = defaultdict(list)
            for i in items:
                by_size[len(i[0])].append(i)
            for size, seekers in list(by_size.items()):
                spelling.descend(spelling.grow(by_size[size - (left == "less")], 0), 0, seekers, left, found)
        pairs = [frozenset((a[0], b[0])) for a, b in found]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {frozenset((a, b)) for a in words for b in words if a < b and edit(a, b)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert got(spelling.group_variants(docs)) == []


def test_long_chains_of_forms(spark):
    n = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in spelling.last_of(n, 5**10).collect()} == {"w9"}
