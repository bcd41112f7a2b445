"""Repeated passages, near-duplicates, embeddings: comparisons with brute force on small cases, and edge cases."""

import hashlib
import random

import numpy as np
import pytest

from seamline.llm import caps, graph, minhash, repeats
from seamline.llm.rolling import mix
from seamline.llm.suffix_array import suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(600):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 3, 20])
        s = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.3:
            s = (s[: max(1, n // 5)] * 9)[:n]
        assert suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])  # noqa: B023


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        new = []
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            new.append(w)
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([99, 100, 101, 150, 400]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice([rng.choice(passage), "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200))), rng.choice(["ab", "x", "abcab"]) * rng.randint(1, 120)]))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = [*corpus(seed), (None, "null id " * 30), (1000, None), (1001, ""), (1002, "z" * 6000), (1003, "q" + "z" * 300)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_bytes string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(df).collect()), key=str)
    assert got == brute_repeats(rows)


def test_repeats_of_many_regions_are_sliced(monkeypatch):
    """Stages run in this process, so that the bound on regions of an anchor can be lowered."""
    monkeypatch.setattr(repeats, "MANY", 2)
    rng = random.Random(5)
    some = lambda k, of="abcdefgh": "".join(rng.choice(of) for _ in range(k))
    common = some(130)
    rows = [(i, some(60) + common + some(60, "ab")) for i in range(25)]
    assert staged(rows) == sorted((i, gone, spans) for i, _, gone, spans, _ in brute_repeats(rows))


def staged(rows, n=3):
    """(doc_id, bytes removed, spans) by the stages in this process, so that bounds can be lowered."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["_id", "_text"])
    by = lambda rs: [pa.Table.from_pylist([r for r in rs if r["bucket"] == b], schema=repeats._STAGE) for b in range(n)]
    flat = lambda bs: [r for b in bs for r in b.to_pylist()]
    met = [r for t in by(flat(repeats._scan(n, 100)([batch]))) for r in repeats._compare(n)(None, t).to_pylist()]
    of = lambda i, c: [r[c] for r in met if r["doc"] == i and r[c]]
    asked = [{"_doc": i, "_fp": repeats.fingerprint(t.encode()), "spans": of(i, "spans"), "asks": of(i, "block"), "_z": repeats.zstandard.compress(t.encode())} for i, t in rows]
    kinds = pa.schema([("_doc", pa.int64()), ("_fp", pa.int64()), ("spans", pa.list_(pa.binary())), ("asks", pa.list_(pa.binary())), ("_z", pa.binary())])
    # Two tasks answer.
    answers = [r for k in (0, 1) for r in flat(repeats._answer(n, 100)(pa.Table.from_pylist(asked[k::2], schema=kinds).to_batches()))]
    found = [r for t in by(answers) for r in repeats._search(n, 100)(None, t).to_pylist()]
    out = []
    for i, _ in rows:
        mine = [np.frombuffer(r["spans"], np.int64).reshape(-1, 2) for r in found if r["doc"] == i and r["spans"]]
        cuts = repeats.merge(np.concatenate(mine)) if mine else np.zeros((0, 2), int)
        out.append((i, int((cuts[:, 1] - cuts[:, 0]).sum()), len(cuts)))
    return sorted(out)


def lines_once_and_twice(seed, n=40):
    """A common line in varied contexts, once or twice in a string's reach, and rules of dashes of many lengths."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    line, after = some(40), [some(90) for _ in range(4)]
    rows = []
    for i in range(n):
        twice = rng.random() < 0.5
        rule = "-" * rng.randint(32, 400)
        rows.append((i, some(70) + (line + some(rng.randint(0, 25)) if twice else "") + line + rng.choice(after) + some(20) + rule + rng.choice(after) + some(30)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_a_common_line_held_once_and_twice(monkeypatch, seed):
    monkeypatch.setattr(repeats, "MANY", 2)
    rows = lines_once_and_twice(seed)
    assert staged(rows) == sorted((i, gone, spans) for i, _, gone, spans, _ in brute_repeats(rows))


def test_repeats_of_hot_periodic_regions_share_no_suffix_array(monkeypatch):
    """Runs of one character in all documents: strings are filed one by one, and a task sends each once."""
    monkeypatch.setattr(repeats, "MANY", 8)
    periodic, met = repeats._periodic, []
    monkeypatch.setattr(repeats, "_periodic", lambda place, *a: met.append(len(place)) or periodic(place, *a))
    rng = random.Random(3)
    some = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    rows = [(i, some(80) + "-" * rng.randint(170, 900) + some(80)) for i in range(60)]
    assert staged(rows) == sorted((i, gone, spans) for i, _, gone, spans, _ in brute_repeats(rows))
    assert not met


def thue_morse_pair(seed=3):
    """Two documents without a common string whose regions collide under any polynomial hash modulo a power of two."""
    rng = random.Random(seed)
    some = lambda k: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    fill = lambda block, turn: bytes(b"AB"[(bin(block * 16 + i).count("1") + turn) % 2] for i in range(16))
    around = [some(8) for _ in range(64)]
    while True:  # until the anchor has the smallest hash of all windows
        anchor = some(32)
        texts = [b"".join(anchor + around[k] + fill(k, turn) + around[-k] for k in range(64)) for turn in (0, 1)]
        hashes = [repeats.windows(np.frombuffer(t, np.uint8), repeats.GRAM) >> np.uint64(7) for t in texts]
        if all((h[::64] == h.min()).all() for h in hashes):
            return [(i, t.decode()) for i, t in enumerate(texts, 1)]


def test_repeats_of_texts_that_collide_in_polynomial_hashes(spark):
    rows = thue_morse_pair()
    own = [{t[i : i + 100] for i in range(len(t) - 99)} for _, t in rows]
    assert not own[0] & own[1]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_repeats(rows)
    assert got[1][2] == 0


def test_repeats_of_a_text_over_a_segment_and_long_regions(spark):
    """1.1 MB of aperiodic text with a passage on both sides of the segment's edge, and a region over REGION bytes."""
    rng = random.Random(11)
    some = lambda k: rng.getrandbits(4 * k).to_bytes(k // 2, "big").hex()
    passage = some(5000)
    long = some(1 << 20)[: (1 << 20) - 2000] + passage + some(60_000)
    flat = "-" * 9000  # one hash throughout: a region that is cut
    rows = [(1, passage[100:400] + flat), (2, long), (3, some(300) + long[-700:] + flat)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_repeats(rows)


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (3, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in repeats.remove(df).collect())
    assert got == [(1, 0), (1, 0), (2, 300), (3, 0)]
    kept = repeats.remove(df, give_text=True)
    assert sorted((r.doc_id, r.text) for r in kept.collect())[2:] == [(2, ""), (3, "short")]
    assert repeats.remove(df.limit(0)).count() == 0


def sets(text):
    from collections import Counter

    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 150))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 4)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = f"v{rng.randint(0, 5000)}"
            rows.append((len(rows), " ".join(c)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (905, "one two three four five six"), (None, "null id here and now"), (906, rows[0][1]), (906, rows[0][1])]
    distinct = list(dict.fromkeys(rows))
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(range(len(distinct)), key=lambda i: (distinct[i][0] is not None, distinct[i][0] or 0))
    for n, i in enumerate(order):
        for j in order[:n]:
            a, b = sets(distinct[i][1]), sets(distinct[j][1])
            if a and b and sum((a & b).values()) >= 0.8 * (sum(a.values()) + sum(b.values()) - sum((a & b).values())):
                x, y = find(i), find(j)
                if x != y:
                    first, last = sorted((x, y), key=order.index)
                    parent[last] = first
    want = sorted(((distinct[i][0], distinct[find(i)][0]) for i in range(len(distinct))), key=str)
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string")
    out = minhash.classify(df)
    long = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, 60_000))) for i in (1, 2, 9)], "doc_id long, text string")
    assert {r.component_id for r in minhash.classify(long).collect()} == {1}
    assert sorted(((r.doc_id, r.component_id) for r in out.collect()), key=str) == want
    stay = minhash.keep_first(df)
    assert stay.columns == df.columns
    assert stay.select("doc_id").distinct().count() == len({c for _, c in want})
    assert minhash.classify(df.limit(0)).count() == 0


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    wa, wb = rng.integers(1, 4, 400).astype(float), rng.integers(1, 4, 400).astype(float)
    wa[:50], wb[-50:] = 0.5, 2.25
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a, b = minhash.darts(elements, wa, 2048), minhash.darts(elements[::-1], wb[::-1], 2048)
    assert abs((a == b).mean() - want) < 0.04
    assert (minhash.darts(elements[:1], np.ones(1), 64) != 0).all()


def test_forest_reaches_all_members_of_a_chain():
    rng = np.random.default_rng(0)
    rows = [rng.integers(0, 256, 128)]
    for i in range(6):
        r = rows[-1].copy()
        r[i * 20 : i * 20 + 24] = rng.integers(0, 256, 24)
        rows.append(r)
    links = minhash.forest(np.array(rows, dtype=np.uint8))
    assert {x for e in links for x in e} == set(range(7)) and len(links) == 6


def test_rivals_of_other_components_are_paired():
    sig = np.zeros((4, 128), dtype=np.uint8)
    sig[1, :30] = sig[2, 30:64] = sig[3, 64:] = 1
    sizes, degree = np.full(4, 100), np.array([0, 0, 5, 0])
    assert minhash.rivals(sig, sizes, np.array([0, 0, 1, 1]), degree, None) == ({(0, 2)}, False)
    assert minhash.rivals(sig, sizes, np.arange(4), degree, None) == ({(0, 1), (0, 2)}, False)
    assert minhash.rivals(sig, sizes, np.array([0, 1, 2, 0]), 0 * degree, 1) == ({(0, 1), (0, 2)}, True)
    assert minhash.rivals(sig, np.array([100, 79, 100, 100]), np.arange(4), degree, None) == ({(0, 2)}, False)
    at = np.array([True, False, True, False])  # 1 and 3 visit
    alike = np.zeros((4, 128), dtype=np.uint8)
    assert minhash.rivals(alike, sizes, np.arange(4), degree, None, home=at) == ({(0, 1), (0, 2), (0, 3), (1, 2), (2, 3)}, False)
    assert minhash.rivals(alike, sizes, np.arange(4), degree, None, home=at, first=False) == ({(0, 1), (0, 3), (1, 2), (2, 3)}, False)


def test_rivals_emit_a_forest_of_short_texts_and_drop_unlike_long_ones():
    def sets(sizes, shared):
        every = [np.concatenate((mix(np.arange(shared, dtype=np.uint64)), mix(np.arange(k * 10**6, k * 10**6 + n - shared, dtype=np.uint64)))) for k, n in enumerate(sizes, 1)]
        return np.array(sizes), [minhash.unpack(minhash.pack(x)) for x in every]

    sig = np.zeros((6, 128), dtype=np.uint8)
    for shared, linked in ((90, True), (85, False)):  # 90 / 110 = 0.82, 85 / 115 = 0.74
        sizes, packed = sets([100] * 6, shared)
        links, short = minhash.rivals(sig, sizes, np.arange(6), sizes, 1, bottoms=[minhash.bottom(x) for x in packed])
        assert (len(links), short) == (5 * linked, False)
        assert minhash.closeness(*[minhash.unpack(minhash.bottom(x)) for x in packed[:2]], (100, 100)) == (minhash.similarity(*packed[:2]), True)
    for shared, linked in ((18_000, True), (14_000, False)):  # 0.82 and 0.54, of texts that the smallest hashes only estimate
        sizes, packed = sets([20_000] * 6, shared)
        links, _ = minhash.rivals(sig, sizes, np.arange(6), sizes, None, bottoms=[minhash.bottom(x) for x in packed])
        assert len(links) == 15 * linked
    twice = minhash.unpack(minhash.bottom(np.sort(np.repeat(packed[0][:50], 2))))
    once = minhash.unpack(minhash.bottom(packed[0][:50]))
    assert minhash.closeness(twice, once, (100, 50)) == (0.5, True)


def test_few_rivals_need_no_further_round():
    """Long texts of an estimate near the bound: all pairs go at once where they are few, and the likeliest of each where not."""
    sig, sizes = np.zeros((30, 128), dtype=np.uint8), np.full(30, 1000)
    every = {(i, j) for i in range(30) for j in range(i + 1, 30)}
    assert minhash.rivals(sig, sizes, np.arange(30), 0 * sizes, 8, slack=15) == (every, False)
    links, short = minhash.rivals(sig, sizes, np.arange(30), 0 * sizes, 8, slack=14)
    assert short and links < every and {k for e in links for k in e} == set(range(30))
    assert minhash.SLACK * 30 >= len(every)  # so the operator's first later round is its last here


def test_near_duplicates_of_bands_over_many_blocks(spark, monkeypatch):
    """Blocks of four rows: families that lie in many blocks, and strays that visit them, end as brute force has them."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(8)
    rows = []
    for f in range(4):
        base = [f"f{f}w{i}" for i in range(120)]
        for _ in range(25):
            c = list(base)
            for _ in range(rng.choice([1, 2, 3, 4])):
                c[rng.randrange(120)] = f"v{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(c)))
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sum((own[i] & own[j]).values()) >= 0.8 * sum((own[i] | own[j]).values()) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = {r.doc_id: r.component_id for r in minhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == root


def test_pairs_that_meet_in_no_block_of_the_first_round(spark, monkeypatch):
    """With blocks of one row no link is found at first: all are left to the later rounds."""
    monkeypatch.setattr(minhash, "BLOCK", 1)
    rows = []
    for f in range(150):
        words = [f"p{f}w{i}" for i in range(112)]
        rows += [(2 * f, " ".join(words)), (2 * f + 1, " ".join([*words[:40], f"x{f}", *words[41:80], f"y{f}", *words[81:]]))]
    own = [sets(t) for _, t in rows[:2]]
    assert 0.8 < sum((own[0] & own[1]).values()) / sum((own[0] | own[1]).values()) < 0.85
    got = {r.doc_id: r.component_id for r in minhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(300)}


def test_near_duplicates_of_a_large_family(spark):
    """Copies of 0.81 to their base, each under 0.8 to all others: nearly always another's estimate beats the base's."""
    base = [f"w{i}" for i in range(254)]
    rows = [(0, " ".join(base))]
    for i, (p, q) in enumerate([(p, q) for p in range(4, 106, 3) for q in range(130, 232, 3)][:1100], 1):
        c = list(base)
        for at in (p, q):
            c[at : at + 9] = [f"v{i}x{at + j}" for j in range(9)]
        rows.append((i, " ".join(c)))
    own = [sets(t) for _, t in rows]
    alike = lambda a, b: sum((a & b).values()) >= 0.8 * sum((a | b).values())
    assert all(alike(own[0], c) for c in own[1:]) and not any(alike(a, b) for a in own[1:20] for b in own[1:] if a is not b)
    got = minhash.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are seen to be; one round more is one write and ten shuffles more."""
    written, durable = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: written.append(1) or durable(df))
    star = spark.createDataFrame([(1, k) for k in range(2, 9)] + [(20, 30)], "a long, b long")
    assert {r.vertex: r.root for r in graph.components(star).collect()} == {k: 1 for k in range(2, 9)} | {30: 20}
    assert len(written) == 1
    written.clear()
    path = spark.createDataFrame([(3, 1), (3, 2)], "a long, b long")
    assert {r.vertex: r.root for r in graph.components(path).collect()} == {2: 1, 3: 1}
    assert len(written) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (7, 7)]
    got = {r.vertex: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[60] == 0 and got[159] == 100 and got[201] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 32))
    rows = []
    for c in centres:
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (c + rng.standard_normal(32) * 0.18).tolist()))
    rows += [(len(rows) + i, rows[3][1]) for i in range(5)] + [(2000, [float(3 * x) for x in rows[0][1]])]
    bad = [(3000, None), (3001, []), (3002, [0.0] * 32), (3003, [float("nan")] * 32), (3004, [None] * 32), (3005, [float("inf")] + [1.0] * 31), (3006, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, i % 3) for i, r in enumerate(rows + bad)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in caps.link(df).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [r[0] for r in rows]
    root = np.arange(len(ids))
    while True:
        new = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1))
        if (new == root).all():
            break
        root = new
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= int(near[k].sum()) for k, i in enumerate(ids))
    assert found >= 0.99 * near.sum()
    assert sum(got[i].component_id == ids[root[k]] for k, i in enumerate(ids)) >= 0.99 * len(ids)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in bad)
    odd = spark.createDataFrame([(None, rows[0][1]), (1, rows[0][1]), (1, rows[0][1]), (1, [-x for x in rows[0][1]])], "vec_id long, embedding array<double>")
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in caps.link(odd).collect()), key=str) == [(1, 0, 1), (1, 1, None), (None, 1, None)]
    assert caps.link(df.limit(0)).count() == 0


def test_closeness_of_a_block_is_that_of_its_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000, dtype=np.int64).astype(np.uint64)
    sets = []
    for k in range(30):
        own = base[: (3, 40, 300, 512, 513, 900, 2000)[k % 7]].copy()
        edited = rng.random(len(own)) < rng.random() * 0.3
        own[edited] = rng.integers(0, 2**63, edited.sum(), dtype=np.int64).astype(np.uint64)
        sets.append(np.sort(np.concatenate((own, own[: k % 3]))))
    bottoms, sizes = [minhash.bottom(minhash.unpack(minhash.pack(x))) for x in sets], np.array([len(x) for x in sets])
    block = minhash.Closeness(bottoms, sizes)
    for i in range(30):
        others = np.array([j for j in range(30) if j != i])
        for j, close, whole in zip(others, *block(i, others), strict=True):
            pair = [minhash.unpack(bottoms[x]) for x in (i, j)]
            assert (close, whole) == minhash.closeness(*pair, (sizes[i], sizes[j]))
