"""Conversation repair against a plain version: dynamic programming over (cost, edits)."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from seamline.llm import q_repair, repair

INSERTS = ((0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2))


def plain(rows):
    """Least (cost, edits); every prefix of the least string is least for its node, as strings of one node and cost are no prefixes of each other."""

    def close(best):
        out = dict(best)
        for was, now, n in INSERTS:
            if was in best:
                out[now] = min(out.get(now, (9e9, "")), (best[was][0] + 3 * n, best[was][1] + "I" * n))
        return out

    best = {0: (0, "")}
    for r in rows:
        new = {}
        for s, (c, a) in close(best).items():
            more, i = 3 * r.isupper(), r.lower()
            ways = [(s, c + 4, "D")]
            if r != "x":
                ways.append((3 if s == 2 else 2, c + 3 + more, "R"))
                ways += [(t, c + more, "K") for t in (1, 2, 3) if "_sua"[t] == i and s in ((), (0,), (0, 1, 3), (2,))[t]]
            for t, cost, edit in ways:
                new[t] = min(new.get(t, (9e9, "")), (cost, a + edit))
        best = new
    return min(v for s, v in close(best).items() if s in (0, 3))


def test_all_short_conversations():
    for n in range(4):
        for w in itertools.product("xsuaoSUAO", repeat=n):
            assert repair.repair("".join(w)) == plain(w)


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_long_conversations_in_blocks(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    pick = random.Random(block)
    for _ in range(400):
        w = "".join(pick.choices("xsuaoSUAuauaua", k=pick.randint(0, 70)))
        assert repair.repair(w) == plain(w)


def test_prices_stay_under_costs_and_meet_at_the_least():
    graph = repair.arcs("uXaSua".replace("X", "x"), (1, 9, 5, 0), False)
    prices = [0] * len(graph)
    for origin in range(4):
        repair.auction(graph, prices, origin)
        assert all(prices[at] <= cost + prices[to] for at, out in enumerate(graph) for _, cost, to in out)


def brute(rows, damage):
    """All columns of the query for (conv_id, turn, role, text) rows."""
    convs, name = {}, lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = name(role), name(text)
        h = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20 if damage else 19
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        kept += [(turn, role, text)] * (2 if h == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, letters = set(), ""
        for _, role, text in kept:
            i = role[:1] if role[:1] in ("s", "u", "a") else "o"
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            letters += "b" if not last else "r" if (role, text) in seen else i if last in ".!?" else i.upper()
            seen.add((role, text))
        cost, audit = plain(letters.replace("b", "x").replace("r", "x"))
        said, at, role = [], 0, None
        for edit in audit:
            then = "assistant" if role == "u" else "user"
            if edit == "I":
                said.append((then, ""))
            else:
                _, own, text = kept[at]
                at += 1
                if edit == "D":
                    continue
                said.append((own if edit == "K" else then, text))
            role = said[-1][0][0]
        turns = [t for t, *_ in kept if t is not None]
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(kept, kept[1:], strict=False)]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, letters.count("b"), letters.count("r"), sum(c.isupper() for c in letters), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=str)


def rows():
    out = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (2, None, None, None), (2, None, "user", "a?"), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 5, "tool", "b.")]
    out += [(None, 1, "system", "s."), (None, 2, "user", "u."), (3, 7, "user", " \t\n"), (3, 3, "", "x."), (4, None, "user", None), (5, 0, "assistant", "Long " * 60_000 + "."), (6, -3, "user", "é…"), (6, 9, "assistant", "ok.  \n")]
    pick = random.Random(4)
    for conv in range(10, 60):
        out += [(conv, t, pick.choice(["user", "assistant", "assistant", "system", "Other"]), pick.choice(["a.", "b", "c?", "", "d. ", " "])) for t in range(pick.randint(1, 9))]
    return out + [(70, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(500)]


@pytest.mark.parametrize("damage", [True, False])
def test_query_equals_plain_version(spark, damage):
    docs = spark.createDataFrame([(*r, False, 1, "z", 3) for r in rows()], "conv_id long, turn long, role string, text string, live boolean, copy int, code string, audit int")
    if damage:
        got = q_repair.repaired_digests(q_repair.damaged(docs)).collect()
    else:  # columns named like internal ones count for nothing
        found = repair.audits(docs)
        shas = {r.conv_id: r.repaired_sha256 for r in q_repair.digests(repair.repaired(docs, found)).collect()}
        got = [(*r, shas.get(r.conv_id, q_repair.NOTHING)) for r in found.collect()]
    assert sorted((tuple(r) for r in got), key=str) == brute(rows(), damage)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    found = repair.audits(docs)
    assert found.collect() == [] and repair.repaired(docs, found).collect() == []
