"""Embedding near-duplicates with spherical-cap filters.

Filter directions are random product codes: after a random rotation a vector is cut in two blocks, each block has its own
random code words, and every pair of words is a direction. A vector is filed under all directions whose inner product with
it exceeds a bound; the list is decoded from the two short score lists, so its cost follows the code's size per block and
the length of the list, not the number of directions. Close vectors share directions, are met in a join on directions and
then verified by cosine in double precision. The number of code words follows the number of vectors (a direction gets
some ``LOAD`` of them at any size), and the bound follows from the number of shared directions that two vectors just close
enough are to have (``SHARED``): recall is a matter of these two, not of the input's size. Lists of a product code vary in
length from vector to vector; so there are several codes, with rotations of their own, and where a list is shorter than
its expected length, the bound of that vector is lowered until it is that long.

Exact copies are one class with a multiplicity before anything is filed. A row under a direction carries the vector in the
precision it came in and its lower directions as 32-bit numbers, and is shuffled once: which directions need dealing is
known from counts alone, made before. A direction met by very many vectors is dealt into blocks, joined in pairs. Groups
emit one row per member, its links counted by multiplicity in matrix products, and a spanning forest of its links; a
pair that shares several directions counts under the lowest of them alone.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing and is its own
component; vectors of unlike length do not link; rows that share vec_id and vector are one vector, rows that share only
vec_id are told apart by a hash of the vector; a null vec_id comes before all others; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import uuid
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import NULL_ID, arrow_map, durable, shared_folder, width
from seamline.llm.graph import components

CLOSE = 0.95
LOAD, SHARED = 64, 15
CODES = 3
BLOCK = 1024
#: Directions whose members are compared at once.
COLUMNS = 4096
SEED = 20240229


def parameters(n: int, close: float = CLOSE) -> tuple[int, float, int]:
    """Code words per block, the bound in standard deviations, and a list's least length, of each code for ``n`` vectors."""
    normal, words, z, listed = NormalDist(), 2, 1.0, 1.0
    for _ in range(30):
        tail = z + 1 / max(z, 0.5)  # mean score of a vector that exceeds the bound
        both = normal.cdf((close * tail - z) / math.sqrt(1 - close * close))
        listed = SHARED / CODES / both
        words = max(8, math.ceil(math.sqrt(n * listed / LOAD)))
        z = normal.inv_cdf(1 - min(0.4, listed / words**2))
    return words, z, math.ceil(listed)


@functools.lru_cache(maxsize=8)
def code(dim: int, words: int, number: int):
    """(rotation, words of the first block, words of the second) of one code for vectors of one length."""
    rng = np.random.Generator(np.random.PCG64([SEED, dim, words, number]))
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = max(1, dim // 2)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    first = unit(rng.standard_normal((words, half)))
    second = unit(rng.standard_normal((words, dim - half))) if dim > half else np.zeros((words, 0))
    return rotation, first, second


def decode(vectors: np.ndarray, words: int, z: float, least: int) -> list[np.ndarray]:
    """Of each unit vector and code: the directions with an inner product over z / sqrt(dim), the ``least`` best anyway."""
    dim = vectors.shape[1]
    out: list[list[np.ndarray]] = [[] for _ in vectors]
    for number in range(CODES):
        rotation, first, second = code(dim, words, number)
        turned = vectors @ rotation
        a, b = turned[:, : first.shape[1]] @ first.T, turned[:, first.shape[1] :] @ second.T
        for x, y, lists in zip(a, b, out, strict=True):
            # The best sums of two lists lie among the pairs (i, j) of ranks with i * j <= least.
            i, j = np.argsort(-x)[:least], np.argsort(-y)[:least]
            top = (x[i][:, None] + y[j][None, :])[_near_corner(len(i), len(j), least)]
            bound = min(math.sqrt(2) * z / math.sqrt(dim), np.partition(top, max(0, len(top) - least))[max(0, len(top) - least)])
            i, j = np.flatnonzero(x >= bound - y.max()), np.flatnonzero(y >= bound - x.max())
            r, c = np.nonzero(x[i][:, None] + y[j][None, :] >= bound)
            lists.append(number * words * words + i[r] * words + j[c])
    return [np.sort(np.concatenate(x)) for x in out]


@functools.lru_cache(maxsize=64)
def _near_corner(a: int, b: int, least: int) -> np.ndarray:
    return (np.arange(1, a + 1)[:, None] * np.arange(1, b + 1)[None, :]) <= least


def _unit(rows: list[list[float]] | np.ndarray) -> np.ndarray:
    v = np.array(rows, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decoded(batches, words: int, z: float, least: int):
    """Rows of a batch with their unit vectors and directions."""
    for batch in batches:
        by_dim: dict[int, list[dict]] = {}
        for r in batch.to_pylist():
            by_dim.setdefault(len(r["vec"]), []).append(r)
        for dim, own in by_dim.items():
            yield dim, own, decode(_unit([r["vec"] for r in own]), words, z, least)


def _directions(words: int, z: float, least: int):
    def run(batches):
        for dim, own, found in _decoded(batches, words, z, least):
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim), pa.int32()), pa.array(rows)], ["dim", "filter"])

    return run


def _file(words: int, z: float, least: int, kind: np.dtype):
    names = ["dim", "filter", "id", "fp", "m", "vec", "lower"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches):
        for dim, own, lists in _decoded(batches, words, z, least):
            cols: list[list] = [[] for _ in names]
            for r, found in zip(own, lists, strict=True):
                vec, listed = np.array(r["vec"], dtype=kind).tobytes(), found.astype(_small(words)).tobytes()
                size = len(listed) // max(1, len(found))
                for k, f in enumerate(found.tolist()):
                    for c, x in zip(cols, (dim, f, r["rep"]["id"], r["rep"]["fp"], r["m"], vec, listed[: k * size]), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return run


def _small(words: int) -> np.dtype:
    """A type that holds the number of every direction."""
    return np.dtype(np.int32 if CODES * words * words < 1 << 31 else np.int64)


def _links(close: float, words: int, kind: np.dtype):
    """Rows sorted by (dim, filter, i, j) to (vertex, links counted here, local root)."""
    vertex = pa.struct([("id", pa.int64()), ("fp", pa.int64())])
    keys = ("dim", "filter", "i", "j")

    def group(held, key, out):
        if len(held) < 2:
            return
        dim, _, bi, bj = key
        unit = _unit(np.frombuffer(b"".join(r[4] for r in held), kind).reshape(len(held), dim))
        near = unit @ unit.T >= close
        block = np.array([r[3] for r in held])
        if bi != bj:
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return
        near = near[np.ix_(some, some)]
        low = [np.frombuffer(held[i][5], _small(words)) for i in some]
        of = np.repeat(np.arange(len(some)), [len(x) for x in low])
        names, at = np.unique(np.concatenate(low), return_inverse=True)
        fresh = near.copy()
        for k in range(0, len(names), COLUMNS):
            here = (at >= k) & (at < k + COLUMNS)
            member = np.zeros((len(some), min(COLUMNS, len(names) - k)), dtype=np.float32)
            member[of[here], at[here] - k] = 1
            fresh &= member @ member.T == 0
        weight = np.array([held[i][2] for i in some], dtype=np.int64)
        counts = (fresh * weight[None, :]).sum(axis=1)
        root = np.arange(len(some))
        while True:
            new = np.minimum(root, np.where(near, root[None, :], len(some)).min(axis=1))
            new = new[new]
            if (new == root).all():
                break
            root = new
        for i, n, r in zip(some.tolist(), counts.tolist(), root.tolist(), strict=True):
            a, b = held[i], held[some[r]]
            out.append(({"id": a[0], "fp": a[1]}, n, {"id": b[0], "fp": b[1]}))

    def run(batches):
        held: list[tuple] = []
        last = None

        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((vertex, pa.int64(), vertex))], ["v", "n", "r"])

        for batch in batches:
            out: list = []
            cols = [batch.column(c).to_pylist() for c in (*keys, "id", "fp", "m", "own", "vec", "lower")]
            for row in zip(*cols, strict=True):
                if row[:4] != last:
                    group(sorted(held), last, out)
                    held, last = [], row[:4]
                held.append(row[4:])
            yield emit(out)
        out = []
        group(sorted(held), last, out)
        yield emit(out)

    return run


_VERTEX = "struct<id: long, fp: long>"


def link(vectors: DataFrame, close: float = CLOSE, vec: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors at a cosine of ``close`` or more), component_id (smallest vec_id reached), kept."""
    spark = vectors.sparkSession
    v = F.col("vec")
    kind = np.dtype(np.float32 if vectors.schema[vec].dataType.elementType.typeName() == "float" else np.float64)
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col(vec).cast("array<float>" if kind.itemsize == 4 else "array<double>").alias("vec"))
    rows = rows.withColumn("fp", F.coalesce(F.xxhash64("vec"), F.lit(0))).groupBy("id", "fp").agg(F.first("vec").alias("vec"))
    fine = F.coalesce(
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    rows = durable(rows.withColumn("vec", F.when(fine, v)))
    own = F.struct("id", "fp")
    classes = durable(rows.where("vec is not null").groupBy("vec").agg(F.min(own).alias("rep"), F.count(F.lit(1)).alias("m")))
    words, z, least = parameters(max(1, classes.count()), close)

    # Directions with more than a block of members, from numbers alone; a written table, so that its size decides how it is joined.
    listed = arrow_map(classes, _directions(words, z, least), "dim int, filter long", rows=512).groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("members"))
    listed.where(F.col("members") > BLOCK).write.parquet(path := f"{shared_folder(spark)}/directions-{uuid.uuid4().hex}")
    blocks = F.coalesce(F.ceil(F.col("members") / BLOCK).cast("int"), F.lit(1))
    filed = arrow_map(classes, _file(words, z, least, kind), "dim int, filter long, id long, fp long, m long, vec binary, lower binary", rows=512)
    filed = filed.join(spark.read.parquet(path), ["dim", "filter"], "left").withColumn("s", blocks).withColumn("own", F.pmod(F.xxhash64("id", "fp"), F.col("s")).cast("int"))
    filed = filed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    filed = filed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("members", "s", "other")
    key = ["dim", "filter", "i", "j"]
    filed = filed.repartition(width(spark), *key).sortWithinPartitions(*key)
    found = durable(arrow_map(filed, _links(close, words, kind), f"v {_VERTEX}, n long, r {_VERTEX}", rows=2048))

    counts = found.groupBy("v").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("v").alias("a"), F.col("r").alias("b")))
    named = (
        classes.join(counts.withColumnRenamed("v", "rep"), "rep", "left")
        .join(roots.select(F.col("vertex").alias("rep"), "root"), "rep", "left")
        .select("vec", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    # Bad vectors link with nothing and stay out of the join, where they would share one key.
    alone = rows.where("vec is null").select("id", "fp", F.lit(None).cast("long").alias("n"), F.lit(None).cast(_VERTEX).alias("root"))
    out = rows.where("vec is not null").join(named, "vec").select("id", "fp", "n", "root").unionByName(alone)
    clean = lambda c: F.when(c != NULL_ID, c)
    root = F.coalesce(F.col("root"), own)
    return out.select(
        clean(F.col("id")).alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), clean(root["id"]).alias("component_id"), (root == own).alias("kept")
    )
