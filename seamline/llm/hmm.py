"""Hidden Markov language model: distributed Baum-Welch, exact likelihood by scaled forward recursion.

Tokens are words and one end per text. Hidden states emit word classes: a word's class is its hash, the end has a class of
its own, and within a class words share the class's probability by their training counts plus one, an unknown word having
one count in each class. So the states' tables have a bounded size, whatever the vocabulary, while all word counts of the
corpus enter the probabilities; and these sum to one over all known words and the classes' unknown ones. Small vocabularies
get fewer classes (one for each ``TYPES`` words), lest the classes' unknown words take a share of their own.

1. Documents become blocks of token numbers, each a row with its words, which the rounds then need not read past. Counts of
   words are sums over a row per block and word, of which each block has one, so no task ever holds the vocabulary and none is broadcast.
2. Baum-Welch: each task runs scaled forward and backward passes over its blocks' training texts and adds up expected
   counts, which are summed across tasks in two steps and give the next parameters. Texts are whole, however long: a pass keeps
   the states at the edges of stretches of ``ROWS`` tokens and goes back over a stretch from its edge (those of the last
   ``KEPT`` stretches are still there), which bounds memory and changes no number. The first ``WARM`` rounds take one shard of the training texts each, in turn, to part the states
   from their random start; then rounds take all training texts, until one adds less than ``GAIN`` to the mean
   log-likelihood of a token.
3. Each whole text is scored by the forward recursion.

Defined cases: a null text is the empty one, whose only token is the end; a null doc_id counts as empty text for the
split; rows are scored one by one, so repeated rows keep a row each and count each time; without training texts all
counts are 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import arrow_map, durable

#: Classes are hashes below CLASSES, folded to a smaller power of two where the vocabulary is small.
STATES, CLASSES, LEAST_CLASSES, TYPES = 12, 1 << 14, 1 << 8, 4
FOLDS, HELD = 7, 2
SHARDS, WARM = 32, 10
#: Nats a token (log-likelihood of the training texts) that a round over all of them has to add for another to follow.
GAIN = 0.005
#: Tokens that a shard should have; with fewer there are fewer shards.
SHARD_TOKENS = 200_000
#: Tokens whose states are held at once, and steps after which states are scaled.
ROWS, EVERY = 1 << 16, 8
#: Last stretches whose states a pass keeps.
KEPT = 3
#: Weight of the corpus' class shares in each state's emissions, of a flat count in moves, and the start's staying rate.
SMOOTH, FLAT, STAY = 2000.0, 1.0, 0.9
BLOCK = 16 << 20
#: A word's place: its block's number, and in the lower bits its own.
BITS = 24
#: Rows in which tasks send their expected counts, and tasks whose rows are added up first.
PIECES, FAN = 64, 256
SEED = 7
#: Spark's own seed of xxhash64, so that tasks and SQL agree on a word's class.
HASH_SEED = 42

_STAGE = "place long, data binary, words array<string>, counts array<long>"
_SCHEMA = pa.schema([("place", pa.int64()), ("data", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<Q", a.nbytes) + a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(raw: bytes, *dtypes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(raw), 0, []
    for t in dtypes:
        (n,) = struct.unpack_from("<Q", raw, at)
        out.append(np.frombuffer(raw, t, count=n // np.dtype(t).itemsize, offset=at + 8))
        at += 8 + n
    return out


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def _words(texts: pa.Array):
    """Words of all texts in a row, lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)  # white space at an end leaves an empty word there
    upto = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    return words.filter(full), np.diff(upto[ends], prepend=0)


def _blocks(batches):
    """Documents to blocks: a row with the block's texts as word numbers, its words and their counts in training texts."""
    home, number = TaskContext.get().partitionId() << 16, 0
    met, lengths, docs, size = [], [], [], 0

    def flush():
        coded = pa.chunked_array(met).dictionary_encode().combine_chunks()
        flat, words = coded.indices.to_numpy().astype(np.int32, copy=False), coded.dictionary.cast(pa.string())
        length = np.array(lengths, dtype=np.int64)
        doc, crc, null = (np.array([d[i] for d in docs], dtype=np.int64) for i in range(3))
        train = crc % FOLDS != HELD
        counts = np.bincount(flat[np.repeat(train, length)], minlength=len(words))
        raw = words.cast(pa.binary()).to_numpy(zero_copy_only=False)
        classes = np.fromiter((xxhash.xxh64_intdigest(w, HASH_SEED) % CLASSES for w in raw), np.uint16, count=len(raw))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(counts, pa.int64()))]
        cols = [pa.array([(home + number) << BITS]), pa.array([_pack(doc, crc, null, length, flat, classes)], pa.binary()), *lists]
        return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)

    for batch in batches:
        words, n = _words(batch.column("text"))
        begin = end = 0
        for d, k in zip(batch.column("doc_id").to_pylist(), n.tolist(), strict=True):
            docs.append((0 if d is None else d, fold(d), d is None))
            lengths.append(k)
            end += k
            size += 8 * k + 16
            if size >= BLOCK:
                met.append(words.slice(begin, end - begin))
                yield flush()
                met, lengths, docs, size, number, begin = [], [], [], 0, number + 1, end
        met.append(words.slice(begin))
    if docs:
        yield flush()


class Model:
    """start (K), move (K, K) and, by class, emit (C + 1, K)."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def begin(cls, share: np.ndarray, states: int = STATES):
        rng = np.random.Generator(np.random.PCG64(SEED))
        emit = share[:, None] * np.exp(rng.standard_normal((len(share), states)))
        move = np.full((states, states), (1 - STAY) / max(1, states - 1))
        np.fill_diagonal(move, STAY if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @classmethod
    def fit(cls, start, move, emit, share):
        emit = emit + SMOOTH * share[:, None]
        move = move + FLAT
        start = start + FLAT
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class InStep:
    """Sequences in step: symbols by time, then by sequence, longest first, so that those that still run are a leading part."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        start, length = start[self.order], length[self.order]
        steps = int(length[0]) if len(length) else 0
        self.running = np.append(np.searchsorted(-length, -np.arange(steps), side="left"), 0)
        self.first = np.concatenate(([0], np.cumsum(self.running)))  # of each step: its first row
        self.steps, self.at, self.flat, self.start = steps, self.first.tolist(), flat, start

    def stretches(self, rows: int):
        """Ranges of steps that have some ``rows`` rows."""
        edges = np.unique(np.append(np.searchsorted(self.first, np.arange(0, self.first[-1], rows)), self.steps))
        return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def most(self, ways: list) -> int:
        """Rows of the largest of some stretches. All stretches fill the same arrays: new ones cost about as much as what fills them."""
        return max((self.at[hi] - self.at[lo] for lo, hi in ways), default=0)

    def symbols(self, lo: int, hi: int):
        """Symbols of the rows of a range of steps."""
        n = self.running[lo:hi]
        step = np.repeat(np.arange(lo, hi), n)
        who = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)
        return self.flat[self.start[who] + step]


def _emissions(model: Model, symbols: np.ndarray, room: np.ndarray) -> np.ndarray:
    return np.take(model.emit, symbols, axis=0, out=room[: len(symbols)], mode="clip")  # all symbols are classes; other modes copy


def _forward(model: Model, seqs: InStep, lo: int, hi: int, state, emit: np.ndarray, logs: np.ndarray | None, room: np.ndarray) -> np.ndarray:
    """States of steps lo to hi, from those before. States are scaled now and then; ``logs`` gets the logarithms."""
    at, base, move = seqs.at, seqs.at[lo], model.move
    out = room[: len(emit)]
    for t in range(lo, hi):
        a, b = at[t] - base, at[t + 1] - base
        now = out[a:b]
        if t:
            np.matmul(state[: b - a], move, out=now)
            now *= emit[a:b]
        else:
            np.multiply(model.start, emit[a:b], out=now)
        if t % EVERY == EVERY - 1:
            scale = now.sum(axis=1)
            now /= scale[:, None]
            if logs is not None:
                logs[: b - a] += np.log(scale)
        n = at[t + 2] - at[t + 1]
        if logs is not None and n < b - a:  # sequences that end here
            logs[n : b - a] += np.log(now[n:].sum(axis=1))
        state = now
    return out


def likelihood(model: Model, seqs: InStep, rows: int = ROWS) -> np.ndarray:
    """Natural log-likelihood of each sequence, in the order it was given in."""
    logs, state, ways = np.zeros(len(seqs.order)), None, seqs.stretches(rows)
    given, found = (np.empty((seqs.most(ways), len(model.start))) for _ in range(2))
    for lo, hi in ways:
        states = _forward(model, seqs, lo, hi, state, _emissions(model, seqs.symbols(lo, hi), given), logs, found)
        state = states[seqs.at[hi - 1] - seqs.at[lo] :].copy()
    back = np.empty_like(logs)
    back[seqs.order] = logs
    return back


def expect(model: Model, seqs: InStep, rows: int = ROWS):
    """Expected counts of starts, moves and emissions, and the log-likelihood."""
    k = len(model.start)
    at, ways = seqs.at, seqs.stretches(rows)
    most = seqs.most(ways)
    given, behind, ahead = np.empty((most, k)), np.empty((most, k)), np.empty((2 * most, k))
    kept = [np.empty((most, k)) for _ in ways[:KEPT]]  # states of stretches, in turn
    logs, state, edges, met = np.zeros(len(seqs.order)), None, [], []
    for i, (lo, hi) in enumerate(ways):
        edges.append(state)
        met.append(seqs.symbols(lo, hi))
        states = _forward(model, seqs, lo, hi, state, _emissions(model, met[i], given), logs, kept[i % KEPT])
        state = states[at[hi - 1] - at[lo] :].copy()
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(model.emit)))
    later = np.zeros((0, k))  # emission times backward state, of the first step of the stretch behind
    back = np.ascontiguousarray(model.move.T)
    for i, (lo, hi) in reversed(list(enumerate(ways))):
        symbols, base = met.pop(), at[lo]
        size = len(symbols)
        emit = _emissions(model, symbols, given)
        if i >= len(ways) - KEPT:
            states = kept[i % KEPT][:size]
        else:
            states = _forward(model, seqs, lo, hi, edges[i], emit, None, kept[i % KEPT])
        beta, told = behind[:size], ahead[: size + len(later)]
        told[size:] = later
        for t in range(hi - 1, lo - 1, -1):
            a, b, n = at[t] - base, at[t + 1] - base, at[t + 2] - at[t + 1]
            if n:
                np.matmul(told[b : b + n], back, out=beta[a : a + n])
            beta[a + n : b] = 1  # sequences that end here
            own = told[a:b]
            np.multiply(emit[a:b], beta[a:b], out=own)
            if t % EVERY == 0:
                own /= own.sum(axis=1)[:, None]
        later = told[: at[lo + 1] - base].copy()
        beta *= states
        weight = 1 / (beta @ np.ones(k))[:, None]
        states *= weight
        beta *= weight
        # Over steps with as many sequences, a row and the next of its sequence lie equally far apart.
        n = seqs.running[lo : hi + 1].tolist()
        edge = [0, *(np.flatnonzero(np.diff(n[:-1])) + 1).tolist(), hi - lo]
        for t, u in zip(edge[:-1], edge[1:], strict=True):
            a, b = at[lo + t] - base, at[lo + u - 1] - base + n[u]
            moves += states[a:b].T @ told[a + n[t] : b + n[t]]
        if lo == 0:
            starts = beta[: at[1]].sum(axis=0)
        symbols, share = symbols.astype(np.intp), given.reshape(-1)[: k * size].reshape(k, size)  # emissions are done with
        share[:] = beta.T
        for z in range(k):
            emits[z] += np.bincount(symbols, weights=share[z], minlength=len(model.emit))
    return starts, moves * model.move, np.ascontiguousarray(emits.T), float(logs.sum())


def _read_docs(data: bytes, folded: int):
    """(doc ids, crc, null, lengths with the end, flat classes with the ends, flat word numbers, word classes) of a block.

    Flat classes are folded to ``folded``, which is also the end's class; word classes are not folded.
    """
    doc, crc, null, length, flat, classes = _unpack(data, np.int64, np.int64, np.int64, np.int64, np.int32, np.uint16)
    ends = np.cumsum(length) + np.arange(1, len(length) + 1) - 1
    symbols = np.full(len(flat) + len(length), folded, dtype=np.int32)
    inner = np.ones(len(symbols), dtype=bool)
    inner[ends] = False
    symbols[inner] = (classes % folded)[flat]
    return doc, crc, null, length + 1, symbols, flat, classes


def _expect(model: Model, shard: int | None, shards: int):
    """Blocks to this task's expected counts, in PIECES rows and one with starts, moves and likelihood."""

    def run(batches):
        k = len(model.start)
        starts, moves, emits, fit = np.zeros(k), np.zeros((k, k)), np.zeros((len(model.emit), k)), 0.0
        for batch in batches:
            for data in batch.column("data"):
                _, crc, _, length, symbols, _, _ = _read_docs(data.as_py(), len(model.emit) - 1)
                begin = np.cumsum(length) - length
                own = crc % FOLDS != HELD
                if shard is not None:
                    own &= crc // FOLDS % shards == shard
                if own.any():
                    got = expect(model, InStep(symbols, begin[own], length[own]))
                    starts, moves, emits, fit = starts + got[0], moves + got[1], emits + got[2], fit + got[3]
        rows = [(i, part.tobytes()) for i, part in enumerate(np.array_split(emits, PIECES))]
        rows.append((PIECES, np.concatenate((starts, moves.reshape(-1), [fit])).tobytes()))
        few = TaskContext.get().partitionId() // FAN
        yield pa.RecordBatch.from_arrays([pa.array([few] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["few", "piece", "data"])

    return run


def _add(key, table):
    total = np.sum([np.frombuffer(x.as_py(), np.float64) for x in table.column("data")], axis=0)
    return pa.table({"piece": pa.array([key[-1].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def train(blocks: DataFrame, share: np.ndarray, tokens: int, states: int = STATES) -> Model:
    """Baum-Welch over the blocks. What reaches the driver in a round has the model's size, which is fixed."""
    model = Model.begin(share, states)
    shards = min(SHARDS, max(1, tokens // SHARD_TOKENS))
    # A shard is one of some texts of some blocks, so that its round need not read all blocks where there are many.
    apart = min(shards, max(1, blocks.count() // SHARDS))
    within = -(-shards // apart)
    warm, last = [i % (apart * within) for i in range(WARM)], None
    while True:
        shard = warm.pop(0) if warm else None
        own = blocks if shard is None else blocks.where(F.pmod(F.shiftright("place", BITS), F.lit(apart)) == shard % apart)
        sent = arrow_map(own.select("data"), _expect(model, None if shard is None else shard // apart, within), "few int, piece int, data binary", rows=1)
        piece = "piece int, data binary"
        got = sent.groupBy("few", "piece").applyInArrow(_add, piece).groupBy("piece").applyInArrow(_add, piece).collect()
        if not got:
            return model
        rows = [np.frombuffer(r["data"], np.float64) for r in sorted(got)]
        rest = rows[-1]
        model = Model.fit(rest[:states], rest[states:-1].reshape(states, states), np.concatenate(rows[:-1]).reshape(-1, states), share)
        if shard is None:
            if last is not None and rest[-1] - last < GAIN * tokens:
                return model
            last = rest[-1]


def _score(model: Model, tokens: int, types: int, ends: int, class_mass: np.ndarray):
    """A block and its words' counts to a row per document."""
    floor = math.log10(tokens + types + 1)
    log_mass = np.log10(class_mass)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())])

    def run(block, counts):
        doc, crc, null, length, symbols, flat, classes = _read_docs(block.column("data")[0].as_py(), len(class_mass) - 1)
        count = np.zeros(len(classes) + 1, dtype=np.int64)
        count[counts.column("place").to_numpy() & ((1 << BITS) - 1)] = counts.column("total").to_numpy()
        count[-1] = ends
        begin = np.cumsum(length) - length
        number = np.full(len(symbols), len(classes), dtype=np.int64)
        number[symbols != len(class_mass) - 1] = flat
        c = count[number]
        logs = np.log10(c + 1.0)
        add = lambda x: np.add.reduceat(x, begin)
        own = add(logs)
        base = own - length * floor
        score = likelihood(model, InStep(symbols, begin, length)) / math.log(10) + own - add(log_mass[symbols])
        cols = [pa.array(doc, mask=null.astype(bool)), pa.array(crc % FOLDS == HELD), length, add((c > 0).astype(np.int64)), np.full(len(doc), tokens), base, score]
        return pa.table([pa.array(x) for x in cols], schema=schema)

    return run


def score(docs: DataFrame, text: str = "text", states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    met = durable(arrow_map(source, _blocks, _STAGE, rows=256))
    blocks = met.select("place", "data")
    # A word has a row for each block that knows it: no key is hotter than the number of blocks.
    same = Window.partitionBy("word")
    words = met.select("place", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    words = words.select((F.col("place") + F.col("at")).alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = words.select("place", "word", F.sum("n").over(same).alias("total"), F.min("place").over(same).alias("first"))
    counted = durable(words.select("place", "total", F.when((F.col("place") == F.col("first")) & (F.col("total") > 0), F.pmod(F.xxhash64("word"), F.lit(CLASSES))).alias("class")))

    def ends(batches):
        for batch in batches:
            n = [int((_unpack(x.as_py(), np.int64, np.int64)[1] % FOLDS != HELD).sum()) for x in batch.column("data")]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n"])

    known = counted.where("class is not null").groupBy("class").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("types")).collect()  # CLASSES rows at most
    n_ends = arrow_map(blocks.select("data"), ends, "n long", rows=1).agg(F.sum("n")).first()[0] or 0
    tokens = sum(r["n"] for r in known) + n_ends
    types = sum(r["types"] for r in known) + (n_ends > 0)
    folded = min(CLASSES, max(LEAST_CLASSES, 1 << max(0, (types // TYPES).bit_length() - 1)))
    mass = np.ones(folded + 1)
    for r in known:
        mass[r["class"] % folded] += r["n"] + r["types"]
    mass[folded] = n_ends + 1
    model = train(blocks, mass / mass.sum(), tokens, states)
    told = counted.select("place", "total", F.shiftright("place", BITS).alias("of"))
    blocks = blocks.select("data", F.shiftright("place", BITS).alias("block"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_score(model, tokens, types, n_ends, mass), schema)
