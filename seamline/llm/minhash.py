"""Near-duplicates by DartMinHash: weighted minwise signatures, banded joins, exact verification.

A text is the multiset of its five-word shingles; the similarity of two texts is the weighted Jaccard index of these.
Darts fall into the plane of weight and rank over each shingle, one for each unit of area, at places that only the
shingle's hash decides. A dart that lies under the shingle's weight counts; it belongs to one of the signature's
coordinates, and each coordinate keeps its dart of lowest rank. Two texts agree in a coordinate with a probability equal
to their similarity. Ranks are searched only as far as some ``n ln n`` darts reach, so a signature costs the size of the
text plus the size of the signature, not their product.

Texts with one multiset are one class before anything is joined. Bands of coordinates file the classes; a band met by very
many is dealt into blocks, by hashes of its own, so that its members meet others in each band. A block first emits no more
links than members: a spanning forest by estimated similarity. Links are then verified on the whole shingle multisets. As
a link can fail while another one of its member would hold, and as no two blocks of a band have met yet, bands are met
again with the components of verified links: members of different components are paired, the likeliest pairs first, until
every such pair of every band was verified. The smallest hashes of both multisets decide there which pairs are worth it:
exactly for short texts, of which a block then emits a forest only, and by a second, finer estimate for long ones. Members of a band's largest component stay in their block, those of all others
visit every block, so that copies of a row number as many as there is left to compare. Connected components of verified links
give each document its class.

Defined cases: a null text is the empty one; a text without words is like no other; a text under five words is one
shingle; rows that share doc_id and text are one document and share its fate; rows that share only doc_id are told apart
by a hash of their text; a null doc_id comes before all others; an empty table gives an empty result; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import NULL_ID, arrow_map, aside, durable, release, width
from seamline.llm.graph import components
from seamline.llm.rolling import mix

SHINGLE = 5
COORDINATES, BANDS = 128, 25
SIMILAR = 0.8
#: Estimates from 128 coordinates deviate by 0.035. A pair of similarity 0.8 falls under MAYBE, and is not verified, once in
#: 13 million (the bands miss it once in 20,000); one over SURE needs no rival at first.
MAYBE, SURE = 0.6, 0.91
#: Pairs with other components that each member of a group emits, round by round; None: all.
ROUNDS = (8, None)
#: Pairs a member, over a whole group, within which a round holds none back, so that no further one has to follow.
SLACK = 32
#: Smallest hashes of a multiset that stand for it where components meet; a multiset of no more is compared exactly there.
BOTTOM = 512
#: Deviations that an estimate from these may lie under the least similarity before its pair is left out: once in 300,000.
DEVIATIONS = 4.5
#: Members of a band that are compared in one task, and visitors of a block that are compared with it at once.
BLOCK = 1024
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


#: Words whose hashes a task remembers, some 40 MB: Python workers stay for later stages, and keep what they once took.
KNOWN = 1 << 18


class WordHashes(dict):
    """Hash of each word, computed once; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    words = (text or "").encode("utf-8").split()
    h = np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))
    if len(h) == 0:
        return h
    if len(h) < SHINGLE:
        h = np.concatenate((h, np.full(SHINGLE - len(h), len(h), dtype=_U)))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, dtype=_U)
    for j in range(SHINGLE):
        total += mix(h[j : j + n] + _U(j)) * _ODD[j]
    return mix(total)


def darts(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Signature of ``k`` dart hashes of a weighted set."""
    whole = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(elements)), whole)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    cell = mix(elements[owner] + level.astype(_U) * _ODD[1])
    room = weights[owner] - level  # weight of the element in this unit of the weight axis
    signature = np.zeros(k, dtype=_U)
    missing = np.ones(k, dtype=bool)
    reach = (k * np.log(k) + 2 * k) / weights.sum()
    while missing.any():
        throws = int(reach + 4 * np.sqrt(reach) + 4)
        got: list[tuple[np.ndarray, np.ndarray]] = []
        at, rank, step = np.arange(len(cell)), np.zeros(len(cell)), 0
        while len(at):
            # Gaps between ranks over a cell of unit weight are exponential.
            dart = mix(cell[at][:, None] + (np.arange(step + 1, step + throws + 1, dtype=_U) * _ODD[2])[None, :])
            gap = -np.log(((mix(dart) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
            ranks = rank[:, None] + np.cumsum(gap, axis=1)
            ok = ranks < reach
            part = room[at]
            if (part < 1).any():
                ok &= (mix(dart ^ _ODD[3]) >> _U(11)).astype(np.float64) * 2.0**-53 < part[:, None]
            got.append((ranks[ok], dart[ok]))
            more = ranks[:, -1] < reach
            at, rank, step = at[more], ranks[more, -1], step + throws
            throws = 4
        ranks, dart = (np.concatenate([g[i] for g in got]) for i in (0, 1))
        order = np.argsort(-ranks, kind="stable")
        dart = dart[order]
        coordinate = (dart >> _U(32)) % _U(k)
        signature[coordinate] = dart  # the last one written has the lowest rank
        missing[:] = True
        missing[coordinate] = False
        reach *= 2
    return signature


_SIGNED = "_id long, _fp long, digest binary, sig binary, bands array<long>, n_shingles long"


def _sign(batches):
    known = WordHashes()
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for t in batch.column("_text"):
            s = shingles(t.as_py(), known)
            cols[3].append(len(s))
            if len(s) == 0:
                for c in cols[:3]:
                    c.append(None)
                continue
            elements, counts = np.unique(s, return_counts=True)
            sig = darts(elements, counts.astype(np.float64))
            cols[0].append(xxhash.xxh3_128_digest(elements.tobytes() + counts.astype(np.int64).tobytes()))
            cols[1].append((sig & _U(0xFF)).astype(np.uint8).tobytes())
            rows = sig[: COORDINATES // BANDS * BANDS].reshape(BANDS, -1)
            cols[2].append([xxhash.xxh64_intdigest(r.tobytes(), seed=b) - (1 << 63) for b, r in enumerate(rows)])
        ids = [NULL_ID if i is None else i for i in batch.column("_id").to_pylist()]
        types = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), batch.column("_fp"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]],
            ["_id", "_fp", "digest", "sig", "bands", "n_shingles"],
        )


def _agree(sig: np.ndarray, sizes: np.ndarray | None, i: int, rows: np.ndarray | slice, similar: float) -> np.ndarray:
    """Coordinates in which rows agree with row ``i``; none where sizes alone keep them apart."""
    n = (sig[rows] == sig[i]).sum(axis=1)
    if sizes is not None:
        n[np.minimum(sizes[rows], sizes[i]) < similar * np.maximum(sizes[rows], sizes[i])] = 0
    return n


def forest(sig: np.ndarray, sizes: np.ndarray | None = None, similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links of a group: all that surely resemble the first member to it, the others by a maximum spanning forest.

    Rows are byte-wide coordinates, of which unlike ones agree once in 256.
    """
    k = sig.shape[1]
    least, sure = MAYBE * k, SURE * k
    best = _agree(sig, sizes, 0, slice(None), similar)
    inside = best >= sure
    inside[0] = True
    links = [(0, int(i)) for i in np.flatnonzero(inside)[1:]]
    out = np.flatnonzero(~inside)
    if not len(out):
        return links
    parent = np.zeros(len(out), dtype=np.int64)
    best = best[out]
    for i in np.flatnonzero(inside)[1:]:  # nearest of the members that are in
        now = _agree(sig, sizes, i, out, similar)
        better = now > best
        best[better], parent[better] = now[better], i
    while len(out):
        j = int(best.argmax())
        i = int(out[j])
        if best[j] >= least:
            links.append((int(parent[j]), i))
        rest = np.arange(len(out)) != j
        out, best, parent = out[rest], best[rest], parent[rest]
        if len(out):
            now = _agree(sig, sizes, i, out, similar)
            better = now > best
            best[better], parent[better] = now[better], i
    return links


def bottom(hashes: np.ndarray) -> bytes:
    """The ``BOTTOM`` smallest hashes of a sorted multiset, five bytes each; equal elements are told apart by their count."""
    elements, counts = np.unique(hashes, return_counts=True)
    level = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return pack(mix(np.repeat(elements, counts) + level.astype(_U) * _ODD[4]))[: 5 * BOTTOM]


def closeness(a: np.ndarray, b: np.ndarray, sizes: tuple[int, int]) -> tuple[float, bool]:
    """Similarity of two multisets by their smallest hashes, and whether it is exact: what ``Closeness`` gives for a block."""
    whole = max(sizes) <= BOTTOM
    times = np.unique(np.concatenate((a, b)), return_counts=True)[1]
    return float(((times if whole else times[:BOTTOM]) > 1).mean()), whole


class Closeness:
    """Similarity of each member of a block to several others at once, by their smallest hashes.

    Hashes are numbered in their order, so a multiset is a row of a padded matrix, and what a row shares with others is
    one look-up in a mask. Of two multisets of which one is cut, only the smallest hashes of the union count.
    """

    def __init__(self, bottoms: list[bytes], sizes: np.ndarray):
        hashes = [np.unique(unpack(x)) for x in bottoms]
        self.lengths = np.array([len(h) for h in hashes])
        values, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        self.whole = np.asarray(sizes) <= BOTTOM
        self.codes = np.full((len(hashes), int(self.lengths.max())), len(values), dtype=np.int32)
        self.codes[np.arange(self.codes.shape[1]) < self.lengths[:, None]] = codes
        self.mask = np.zeros(len(values) + 1, dtype=bool)
        self.rank = np.zeros(len(values) + 1, dtype=np.int32)

    def __call__(self, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Similarities, and which of them are exact."""
        own, theirs = self.codes[i, : self.lengths[i]], self.codes[others]
        self.mask[own] = True
        common = self.mask[theirs]
        self.mask[own] = False
        shared = common.sum(axis=1)
        union = self.lengths[i] + self.lengths[others] - shared
        whole = self.whole[others] & self.whole[i]
        cut = np.flatnonzero(~whole)
        if len(cut):  # place of each common hash in the union, which the common ones before it shorten
            c = common[cut]
            self.rank[own] = np.arange(len(own))
            place = np.arange(c.shape[1], dtype=np.int32) + self.rank[theirs[cut]] - (np.cumsum(c, axis=1, dtype=np.int32) - c)
            shared[cut] = (c & (place < BOTTOM)).sum(axis=1)
            union[cut] = np.minimum(union[cut], BOTTOM)
        return shared / union, whole


def likeliest(a: np.ndarray, b: np.ndarray, n: np.ndarray, degree: np.ndarray, most: int) -> tuple[np.ndarray, bool]:
    """Which of the pairs (a, b) are among the ``most`` of either member with the largest ``n``, or with the best linked other
    member; and if any is not."""
    who, other, pair = np.concatenate((a, b)), np.concatenate((b, a)), np.tile(np.arange(len(a)), 2)
    n = np.tile(n.astype(np.int64), 2)
    size = np.bincount(who)
    begin = np.cumsum(size) - size
    keep = np.zeros(len(a), dtype=bool)
    for order in (np.lexsort((other, -n, who)), np.lexsort((other, -n, -degree[other], who))):
        keep[pair[order[np.arange(len(order)) - begin[who[order]] < most]]] = True
    return keep, bool((size > most).any())


def rivals(
    sig: np.ndarray,
    sizes: np.ndarray,
    root: np.ndarray,
    degree: np.ndarray,
    most: int | None,
    similar: float = SIMILAR,
    home: np.ndarray | None = None,
    first: bool = True,
    bottoms: list[bytes] | None = None,
    slack: int = 0,
) -> tuple[set[tuple[int, int]], bool]:
    """Pairs of a block's members in different components; and if any were held back.

    A visitor (not at ``home``) is paired with members at home only, and these with each other in the ``first`` crowd only. If
    there are over ``slack`` pairs a member, of each member go the ``most`` likeliest, and as many that most links were verified
    of: the base of many copies. With the members' smallest hashes, a pair of short texts that surely links joins the components
    of both in this block, and further pairs of these are not needed.
    """
    least, links, short = MAYBE * sig.shape[1], set(), False
    compare = Closeness(bottoms, sizes) if bottoms else None
    lowest = similar - DEVIATIONS * (similar * (1 - similar) / BOTTOM) ** 0.5
    root = np.array(root)
    home = np.ones(len(sig), dtype=bool) if home is None else home
    held: list[tuple[np.ndarray, ...]] = []
    for i in range(len(sig) - 1):  # each pair is met at its smaller member
        meets = (home if first else np.zeros(len(sig), dtype=bool)) | ~home if home[i] else home
        other = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & meets[i + 1 :])
        n = _agree(sig, sizes, i, other, similar)
        near = np.flatnonzero(n >= least)
        if compare is not None and len(near):
            near = near[np.argsort(-n[near], kind="stable")]
            close, whole = compare(i, other[near])
            for j in other[near[whole & (close >= similar)]].tolist():
                if root[i] != root[j]:
                    links.add((i, j))
                    root[root == root[j]] = root[i]
            near = near[~whole & (close >= lowest)]
        held.append((np.full(len(near), i, np.int32), other[near].astype(np.int32), n[near].astype(np.int16)))
    if held:
        a, b, n = map(np.concatenate, zip(*held, strict=True))
        apart = root[a] != root[b]
        if most is not None and apart.sum() > slack * len(sig):
            a, b, n = a[apart], b[apart], n[apart]
            apart, short = likeliest(a, b, n, degree, most)
        links.update(zip(a[apart].tolist(), b[apart].tolist(), strict=True))
    return links, short


def _group(similar: float, most: int | None = 0):
    """Rows sorted by band, block and crowd to links; a group may run over batches.

    At first (``most`` 0) by forests, then by rivals; a row without ends tells that links were held back.
    """
    names = ["a", "b"]
    pair = pa.struct([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        held: list[tuple] = []
        last = None

        def flush(out):
            if len(held) > 1:
                own = sorted(set(held))
                sig = np.frombuffer(b"".join(r[2] for r in own), np.uint8).reshape(len(own), -1)
                sizes = np.array([r[3] for r in own])
                if most == 0:
                    links, short = forest(sig, sizes, similar), False
                else:
                    known: dict[tuple, int] = {}
                    root = np.array([known.setdefault(r[7:], len(known)) for r in own])
                    degree, home = np.array([r[5] for r in own]), np.array([r[4] for r in own])
                    links, short = rivals(sig, sizes, root, degree, most, similar, home, last[2] == 0, [r[6] for r in own], SLACK)
                out += [(own[min(e)][:2], own[max(e)][:2]) for e in links]
                if short:
                    out.append((None, None))
            held.clear()

        def emit(out):
            cols = [pa.array([e[s] and {"id": e[s][0], "fp": e[s][1]} for e in out], pair) for s in (0, 1)]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            out: list = []
            cols = [batch.column(c).to_pylist() for c in batch.schema.names]
            for band, block, crowd, *member in zip(*cols, strict=True):
                if (band, block, crowd) != last:
                    flush(out)
                    last = (band, block, crowd)
                held.append(tuple(member))
            yield emit(out)
        out = []
        flush(out)
        yield emit(out)

    return run


def pack(hashes: np.ndarray) -> bytes:
    """Sorted multiset of the hashes' upper 40 bits, five bytes each: even in a text of a million words, hardly one collides."""
    return np.sort(hashes >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _sets(batches):
    known = WordHashes()
    for batch in batches:
        sets = [pack(shingles(t.as_py(), known)) for t in batch.column("_text")]
        least = [bottom(unpack(s)) for s in sets]
        ids = [NULL_ID if i is None else i for i in batch.column("_id").to_pylist()]
        vertex = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), batch.column("_fp").cast(pa.int64())], ["id", "fp"])
        yield pa.RecordBatch.from_arrays([vertex, pa.array(sets, pa.binary()), pa.array(least, pa.binary())], ["v", "shingles", "bottom"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard index of two sorted multisets."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both)


def _verify(least: float):
    def run(batches):
        for batch in batches:
            ok = [
                similarity(unpack(x.as_py()), unpack(y.as_py())) >= least
                for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


_VERTEX = "struct<id: long, fp: long>"
_LINK = f"a {_VERTEX}, b {_VERTEX}"


def _met(members: DataFrame, parts: int) -> DataFrame:
    """Rows of the groups that share a band: some ``BLOCK`` rows at home in a block, and as many visitors at most.

    At first each row is at home in one block of its band. Where components are known (root), only bands that more than one
    meets are left, and rows outside the band's largest component also visit its other blocks, where they are dealt into
    crowds; a block's own rows are there for each crowd. The join by band is one that adaptive execution splits where a
    band has very many rows.
    """
    known = [c for c in ("degree", "bottom", "root") if c in members.columns]
    rows = members.select("rep", *known[2:], F.posexplode("bands").alias("n", "band"))
    several = lambda n: F.ceil(n / BLOCK).cast("int")
    if known:
        met = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("own"))
        met = met.groupBy("band").agg(F.sum("own").alias("members"), F.max(F.struct("own", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
        blocks = several(F.col("members"))
        crowds = F.when(blocks > 1, several(F.col("members") - F.col("main.own"))).otherwise(1)
        met = met.where("roots > 1").select("band", F.col("main.root").alias("main"), blocks.alias("blocks"), crowds.alias("crowds"))
    else:
        met = rows.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        met = met.select("band", several(F.col("members")).alias("blocks"), F.lit(1).alias("crowds"))
    dealt = lambda n, *salt: F.pmod(F.xxhash64("rep", "band", *map(F.lit, salt)), n).cast("int")
    rows = rows.join(met, "band").withColumn("home", dealt(F.col("blocks")))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    places = F.transform(upto(F.col("crowds")), lambda c: F.struct(F.col("home").alias("block"), c.alias("crowd"), F.lit(True).alias("own")))
    if known:
        away = F.filter(upto(F.col("blocks")), lambda x: (x != F.col("home")) & (F.col("root") != F.col("main")))
        places = F.concat(places, F.transform(away, lambda x: F.struct(x.alias("block"), dealt(F.col("crowds"), 1).alias("crowd"), F.lit(False).alias("own"))))
    rows = rows.select("rep", "band", F.explode(places).alias("at")).select("rep", "band", "at.*")
    rows = rows.join(members.select("rep", "sig", "n_shingles", *known), "rep")
    own = [F.col("rep.id").alias("_id"), F.col("rep.fp").alias("_fp"), "sig", "n_shingles", "own", *known[:2], *[F.col(f"root.{c}").alias(f"_root_{c}") for c in ("id", "fp") if known]]
    key = ["band", "block", "crowd"]
    return rows.select(*key, *own).repartition(parts, *key).sortWithinPartitions(*key)


def _hold(links: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The links that hold on the whole shingle multisets."""
    pairs = links.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa")), "a")
    pairs = pairs.join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb")), "b")
    return arrow_map(pairs.select("a", "b", "sa", "sb"), _verify(similar), _LINK, rows=256)


def classify(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, _fp, n_shingles, component_id (smallest doc_id of its class), kept.

    ``kept`` holds for the first document of a class, and for documents that resemble no other.
    """
    spark = docs.sparkSession
    parts = width(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_fp"), F.col(text).alias("_text"))
    signed = durable(arrow_map(base, _sign, _SIGNED, rows=512).dropDuplicates(["_id", "_fp"]))
    vertex = F.struct(F.col("_id").alias("id"), F.col("_fp").alias("fp"))
    reps = signed.where("digest is not null").groupBy("digest").agg(F.min(vertex).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    reps = durable(reps)

    links = durable(arrow_map(_met(reps, parts), _group(similar), _LINK, rows=4096).distinct())
    ends = links.select(F.col("a").alias("v")).union(links.select("b"))
    # A class with a pair to verify in a later round has a link in the first, or is in a band of several blocks, of which it met one.
    banded = reps.select("rep", F.explode("bands").alias("band"))
    large = durable(banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > BLOCK).select("band"))
    release(spark)
    if not large.isEmpty():
        ends = ends.union(banded.join(large, "band").select(F.col("rep").alias("v")))
    ends = ends.distinct()
    sets = durable(arrow_map(base, _sets, f"v {_VERTEX}, shingles binary, bottom binary", rows=512).dropDuplicates(["v"]).join(ends, "v"))
    edges = durable(_hold(links, sets, similar))
    release(spark)
    roots = components(edges)
    for most in ROUNDS:
        root = roots.select(F.col("vertex").alias("rep"), "root")
        degree = edges.select(F.col("a").alias("rep")).union(edges.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
        members = reps.join(sets.select(F.col("v").alias("rep"), "bottom"), "rep").join(root, "rep", "left").join(degree, "rep", "left")
        members = durable(members.withColumns({"root": F.coalesce("root", "rep"), "degree": F.coalesce("degree", F.lit(0))}))
        pairs = durable(arrow_map(_met(members, parts), _group(similar, most), _LINK, rows=4096).distinct())
        release(spark)
        fresh = durable(pairs.where("a is not null").join(links, ["a", "b"], "left_anti"))
        found = durable(_hold(fresh, sets, similar))
        release(spark)
        if not found.isEmpty():
            edges = edges.union(found)
            roots = components(edges)
        if pairs.where("a is null").isEmpty():
            break
        links = links.union(fresh)

    named = reps.select("digest", "rep").join(roots.select(F.col("vertex").alias("rep"), "root"), "rep", "left")
    named = named.select("digest", F.coalesce("root", "rep").alias("root"))
    out = signed.select("_id", "_fp", "digest", "n_shingles").join(named, "digest", "left")
    root = F.coalesce(F.col("root"), vertex)
    clean = lambda c: F.when(c != NULL_ID, c)
    return out.select(clean(F.col("_id")).alias("doc_id"), "_fp", "n_shingles", clean(root["id"]).alias("component_id"), (root == vertex).alias("kept"))


def keep_first(docs: DataFrame, text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The documents of ``docs``, all columns, without those that resemble an earlier one of their class."""
    gone = classify(docs, text, similar).where("not kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), "_fp")
    plain, back = aside(docs, "doc_id", text)
    keyed = plain.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_fp": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return keyed.join(gone, ["_id", "_fp"], "left_anti").select(*back(docs.columns))
