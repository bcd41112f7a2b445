"""Mixing and language model: targets, bounds, probabilities, held-out gain, edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seamline.llm import hmm, mixing

SF = "/root/testdata/sf0.001"


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def filled(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rest, total = budget - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: rest * w[s] / total for s in free}
        for s in over:
            fixed[s] = cap * sizes[s]
            free.discard(s)
    return fixed


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 5}" if i % 11 else None) for i in range(600)]
    rows += [(9000, None, "s1"), (9001, "", "empty"), (None, "a b", "s2"), (1, rows[1][1], rows[1][2]), (9002, "x " * 4000, "big")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, source string, taken string")
    got = mixing.mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = filled(dict(sizes), (3, 1, 2), 1.5, 2)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], abs=1e-6)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= max(20, 0.01 * goal)
    key = lambda rs: sorted(((r.doc_id, r.text, r.copies) for r in rs), key=str)
    assert key(got) == key(mixing.mix(df.repartition(7)).collect())
    assert mixing.mixed(df).columns == df.columns
    twins = spark.createDataFrame([(1, "a b c", "s", k) for k in range(40)] + [(2, "a b", "t", 0)], "doc_id long, text string, source string, more int")
    taken = lambda d: sorted((r.more, r.copies) for r in mixing.mix(d).collect())
    assert taken(twins) == taken(twins.orderBy("more", ascending=False).coalesce(1)) == taken(twins.repartition(6))
    assert mixing.mix(df.limit(0)).count() == 0


def test_newton_solves_the_dual(spark):
    """Rates differ within a source: the one tilt by size that meets the target, found here by bisection."""
    rows = [("a", 10, 5), ("a", 3, 7), ("b", 4, 100), ("c", 1, 50), ("c", 400, 3), ("c", 20_000, 1), ("d", 7, 9), ("d", 0, 4), ("e", 0, 3), ("f", 5, 2), ("f", 50, 2)]
    goals = [("a", 71, 35.5), ("b", 400, 800.0), ("c", 21_250, 30_000.0), ("d", 63, 63.0), ("e", 0, 0.0), ("f", 110, 1.0)]
    cells = spark.createDataFrame(rows, "src string, size long, n long")
    got = {r.src: r.lam for r in mixing.solve_dual(cells, spark.createDataFrame(goals, "src string, source_size long, target double")).collect()}
    for src, _, goal in goals:
        own = [(z, n) for s, z, n in rows if s == src]
        take = lambda lam: sum(n * z * min(2.0, math.exp(min(50, lam * z))) for z, n in own)  # noqa: E731, B023
        if src in "be":
            assert got[src] is None
            continue
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if take(mid) < goal else (low, mid)
        assert take(got[src]) == pytest.approx(goal, rel=1e-8) and got[src] == pytest.approx(low, rel=1e-6, abs=1e-9)
    assert math.exp(got["a"] * 10) != pytest.approx(math.exp(got["a"] * 3))


def test_targets_of_many_sources(spark):
    rows = [(f"n{i:05d}", f"n{i:05d}" if i else None, (i * 37) % 101) for i in range(2500)]
    got = {r.src: r.target for r in mixing.targets(spark.createDataFrame(rows, "src string, source string, source_size long").repartition(5)).collect()}
    want = filled({s: z for _, s, z in rows}, (3, 1, 2), 1.5, 2)
    assert got == pytest.approx({n: want[s] for n, s, _ in rows})


def test_query_takes_near_the_targets(spark):
    """The query over its whole table against targets filled by hand, and its documents against their bounds."""
    from seamline.llm import registry

    source = {r.doc_id: (r.source, size(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken = Counter(), Counter()
    for s, z in source.values():
        sizes[s] += z
    want = filled(dict(sizes), (3, 1, 2), 1.5, 2)
    for r in registry.queries()["op3_mix_sources"](spark, SF).collect():
        s, z = source[r.doc_id]
        assert (r.size, r.source_size) == (z, sizes[s]) and r.target == pytest.approx(want[s])
        assert r.taken == r.copies * z and 0 <= r.copies <= 2
        taken[s] += r.taken
    least = {s: min(z for t, z in source.values() if t == s) for s in want}
    assert all(abs(taken[s] - goal) <= max(least[s], 0.01 * goal) for s, goal in want.items())


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def test_scores_on_the_small_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in hmm.score(df).collect()}
    words = {r.doc_id: tokens(r.text) for r in df.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in words.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
    out = [d for d in words if held[d]]
    assert sum(got[d].score for d in out) > sum(got[d].base_score for d in out)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "A b"), (3, "A b"), (4, "b " * 20_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = hmm.score(df).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 3, 3, 3, 20_001]
    assert hmm.score(df.limit(0)).count() == 0


def model(k, c, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, ax: x / x.sum(axis=ax, keepdims=True)
    emit = np.full((hmm.CLASSES + 1, k), 1e-12)
    emit[:c] = rng.random((c, k)) + 0.1
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(emit, 0))


def sequences(lengths, c, seed=1):
    flat = np.random.default_rng(seed).integers(0, c, sum(lengths)).astype(np.int32)
    length = np.array(lengths)
    return flat, hmm.InStep(flat, np.cumsum(length) - length, length)


def test_forward_is_the_sum_over_paths():
    from itertools import product

    m = model(2, 4)
    flat, seqs = sequences([3, 5, 1], 4)
    got, at = hmm.likelihood(m, seqs), 0
    for x, n in zip(got, [3, 5, 1], strict=True):
        s = flat[at : at + n]
        at += n
        total = sum(m.start[p[0]] * m.emit[s[0], p[0]] * np.prod([m.move[p[i - 1], p[i]] * m.emit[s[i], p[i]] for i in range(1, n)]) for p in product(range(2), repeat=n))
        assert x == pytest.approx(math.log(total))


def test_expected_counts_conserve_and_raise_the_likelihood():
    m = model(3, 6)
    flat, seqs = sequences([40, 7, 100, 1], 6)
    share = np.full(hmm.CLASSES + 1, 1 / (hmm.CLASSES + 1))
    last = -math.inf
    for _ in range(5):
        starts, moves, emits, fit = hmm.expect(m, seqs)
        assert starts.sum() == pytest.approx(4, rel=1e-3)
        assert moves.sum() == pytest.approx(len(flat) - 4, rel=1e-3)
        assert emits.sum() == pytest.approx(len(flat), rel=1e-3)
        assert fit == pytest.approx(hmm.likelihood(m, seqs).sum(), rel=1e-4)
        assert fit >= last - 1e-3
        last = fit
        m = hmm.Model(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), (emits + 1e-12 * share[:, None]) / (emits + 1e-12 * share[:, None]).sum(axis=0))


def test_stretches_change_no_number():
    """A text of 20,000 tokens is trained and scored whole, whatever the stretch."""
    m = model(3, 6)
    _, seqs = sequences([20_000, 3, 500, 1], 6)
    whole, cut = hmm.expect(m, seqs, 1 << 30), hmm.expect(m, seqs, 777)
    for a, b in zip(whole, cut, strict=True):
        assert np.allclose(a, b, rtol=1e-9)
    assert whole[1].sum() == pytest.approx(20_000 + 3 + 500 + 1 - 4)
    assert np.allclose(hmm.likelihood(m, seqs, 1 << 30), hmm.likelihood(m, seqs, 777))


def test_words_of_blocks_are_those_of_bytes():
    """Arrow's split at white space takes the same words as that of bytes, in the same order."""
    import pyarrow as pa

    texts = [None, "", " ", "a", "  Ab\tc\n\x0bD\x0c\re ", "\u00c9\u00c0 x\u00a0y\u0085z\u2028w\x1cq\x00", "a a A \U0001f600\n"]
    words, n = hmm._words(pa.array(["left out", *texts], pa.string())[1:])
    want = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want] and [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws]


def test_blocks_cost_less_than_numbering_words_one_by_one(monkeypatch):
    """Before, each word was an object of Python, and blocks took more CPU time than this loop alone."""
    import time

    import pyarrow as pa

    monkeypatch.setattr(hmm, "TaskContext", type("Context", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    drawn = np.random.default_rng(0).zipf(1.3, 400_000) % 2_000
    texts = [" ".join(f"word{i}" for i in part) for part in np.array_split(drawn, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    def loop():
        known: dict = {}
        return [[known.setdefault(w, len(known)) for w in t.as_py().encode().lower().split()] for t in batch.column("text")]

    def cost(f):
        spent = []
        for _ in range(5):
            began = time.process_time()
            f()
            spent.append(time.process_time() - began)
        return min(spent)

    (block,) = hmm._blocks([batch])
    *_, flat, classes = hmm._read_docs(block.column("data")[0].as_py(), hmm.CLASSES)
    assert flat.tolist() == [w for ws in loop() for w in ws] and len(classes) == len(block.column("words")[0])
    assert cost(lambda: list(hmm._blocks([batch]))) < cost(loop)


def test_a_pass_goes_forward_once_over_its_last_stretches(monkeypatch):
    """Before, only the last stretch was still there on the way back."""
    seen, forward = [], hmm._forward
    monkeypatch.setattr(hmm, "_forward", lambda m, s, lo, *a: seen.append(lo) or forward(m, s, lo, *a))
    _, seqs = sequences([4000], 6)
    hmm.expect(model(3, 6), seqs, 1000)
    assert seen == [0, 1000, 2000, 3000, 0]


def test_rounds_read_blocks_and_no_rows_of_words(spark, monkeypatch):
    """The table that every round reads again has a row per block; before, the rows of all words were read past each time."""
    seen, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda blocks, *a: seen.append(blocks) or train(blocks, *a))
    rows = [(i, f"word{i} word{i % 7} other") for i in range(60)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60
    assert "Filter" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_in_one_window(spark, monkeypatch):
    """Before, a second window in another order numbered the rows of each word."""
    seen, durable = [], hmm.durable
    monkeypatch.setattr(hmm, "durable", lambda df: seen.append(df) or durable(df))
    rows = [(i, f"word{i} word{i % 7} other") for i in range(60)]
    assert hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60
    assert seen[1]._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_query_scores_are_the_forward_sums_of_its_model(spark, monkeypatch):
    """Each score of the query against a plain forward pass, word by word, under the model that it trained."""
    import xxhash

    from seamline.llm import registry

    train, kept = hmm.train, []
    monkeypatch.setattr(hmm, "train", lambda blocks, share, *a: kept.append((train(blocks, share, *a), share)) or kept[-1][0])
    got = {r.doc_id: r.score for r in registry.queries()["op4_hmm_scoring"](spark, SF).collect()}
    m, share = kept[0]
    words = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    end = len(share) - 1
    symbol = lambda w: xxhash.xxh64_intdigest(w, seed=42) % hmm.CLASSES % end if w else end
    mass = Counter({c: 1 for c in range(end + 1)})
    for w, n in counts.items():
        mass[symbol(w)] += n + 1 if w else n
    for d, ws in words.items():
        state, total = None, 0.0
        for w in ws:
            z = symbol(w)
            state = (m.start if state is None else state @ m.move) * m.emit[z] * ((counts[w] + 1) / mass[z])
            total += math.log10(state.sum())
            state = state / state.sum()
        assert got[d] == pytest.approx(total, rel=1e-9)
    assert np.allclose([mass[c] for c in range(end + 1)], share * sum(mass.values()))
