"""Suffix-array de-duplication: every byte of a long string that also starts earlier goes.

A string here is ``length`` (100) bytes of a text's UTF-8 form; it repeats if an equal one starts earlier, in a document
with a smaller doc_id or further left in the same one. Matches never cross documents, overlaps count, and strings are
judged on the input.

1. Each string is filed under its smallest 32-byte hash (its anchor). The strings of a document under one anchor start
   next to each other; together they are a region, a few dozen bytes longer than a string. Equal strings have equal
   anchors at equal offsets, so only regions under one anchor need comparing. Equal regions of a task fall to the first
   of them before anything is shuffled, and what is shuffled are digests and places, not text. A region's digest is 128
   bits of BLAKE2b over its bytes: no two different regions that anyone can write down share one.
2. By anchor: equal regions fall to the first of all. An anchor with one distinct region, not periodic, has nothing left to find. For
   the others, the bytes of each distinct region are asked for.
3. The documents answer. The regions of an anchor with very many of them, periodic or not, are cut into their strings, each
   filed under all its bytes. Equal strings have one anchor, so that they meet here as well, and a group holds copies of one
   string, of which a task sends the first: no group's text grows with the number of documents that hold a common line.
4. The regions of a bucket of anchors are laid end to end, from their anchors on, in 8-byte symbols, and sorted as one
   suffix array (linear grouping, see suffix_array). Strings at one offset are equal where neighbours in the array
   agree far enough to the right, and neighbours in the order of the bytes before the anchor agree far enough to the left:
   both are comparisons of bytes. All but the first of each class repeat. Regions that hold their anchor twice (periodic
   text) go through a suffix array over single bytes instead.
5. By document: spans are merged and cut.

The number of buckets follows the bytes of all texts, so that a bucket has one size whatever the input and whatever the
session's number of shuffle partitions.

Defined cases: a null text is the empty one and nothing is removed from it; a null doc_id comes before all others; rows
that share doc_id and text are one document and all get its result; rows that share only doc_id order by a hash of
their text; texts under ``length`` bytes stay whole; an empty table gives an empty result; input columns named
like an added one are replaced, all others pass through, whatever their names. Removing bytes can split a character, so text that is given back drops torn ones.
"""

from __future__ import annotations

import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import NULL_ID, arrow_map, aside, width
from seamline.llm.rolling import mix, sliding_min, windows
from seamline.llm.suffix_array import suffix_array

LENGTH = 100
GRAM = 32
#: Strings of a region at most, and strings of a document handled at once.
REGION, SEGMENT = 4096, 1 << 20
#: Bytes of text, or of regions, that a task gathers before it writes blocks.
BATCH = 6 << 20
#: Bytes of text for each bucket of anchors.
BUCKET = 8 << 20
#: Distinct regions of an anchor from which on their strings are filed one by one.
MANY = 1024
_U = np.uint64
DIGEST = np.dtype([("one", "<u8"), ("two", "<u8")])
PLACE = np.dtype([("doc", "<i8"), ("fp", "<i8"), ("lo", "<i8"), ("n", "<i4"), ("at", "<i4")])
ANCHOR = np.dtype([("hash", "<u8"), ("one", "<u8"), ("two", "<u8"), ("row", "<u4"), ("lo", "<u4"), ("n", "<u2"), ("at", "<i2")])
#: In place of an anchor's offset: a region that holds its anchor twice; a single string, filed under its bytes.
PERIODIC, STRING = -1, -2


def fingerprint(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw, seed=7) - (1 << 63)


def digests(raw: bytes, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit digests of byte ranges."""
    blake = functools.partial(hashlib.blake2b, digest_size=DIGEST.itemsize)
    return np.frombuffer(b"".join([blake(raw[a:b]).digest() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]), dtype=DIGEST)


def regions(raw: bytes, length: int = LENGTH):
    """(hash, digest, lo, n bytes, anchor's offset or PERIODIC) of each region of a text, as arrays."""
    if len(raw) < length:
        return None
    data = np.frombuffer(raw, dtype=np.uint8)
    w = length - GRAM + 1
    h = windows(data, GRAM) >> _U(7)
    low = sliding_min(h, w)
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    end = np.concatenate((start[1:], [len(low)]))
    # A position is some string's anchor if the largest minimum around it is its own hash.
    top = ~sliding_min(np.concatenate((np.full(w - 1, ~_U(0)), ~low, np.full(w - 1, ~_U(0)))), w)
    anchors = np.flatnonzero(h == top[: len(h)])
    value = low[start]
    if len(anchors) == len(start) and (h[anchors] == value).all():
        at = anchors - start
    else:
        at = np.empty(len(start), dtype=np.int64)
        for i, (a, b, v) in enumerate(zip(start.tolist(), end.tolist(), value, strict=True)):
            found = np.flatnonzero(h[a : b + w - 1] == v)
            at[i] = found[0] if len(found) == 1 else PERIODIC
    if (end - start).max() > REGION:
        cut = [(p, min(p + REGION, b), v, x) for a, b, v, x in zip(start.tolist(), end.tolist(), value, at.tolist(), strict=True) for p in range(a, b, REGION)]
        start, end, at = (np.array([c[i] for c in cut]) for i in (0, 1, 3))
        value = np.array([c[2] for c in cut], dtype=_U)
    stop = end + (length - 1)
    return mix(value), digests(raw, start, stop), start, stop - start, at


def merge(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, non-touching spans that cover the same bytes; (n, 2) arrays."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[new, 0], reach[np.concatenate((new[1:], [len(spans)])) - 1]), axis=1)


def _pack(z, *arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<I", len(a.tobytes())) + a.tobytes() for a in arrays]
    return z.compress(b"".join(parts))


def _unpack(raw: bytes, *dtypes) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(raw), [], 0
    for dtype in dtypes:
        (n,) = struct.unpack_from("<I", raw, at)
        out.append(np.frombuffer(raw, dtype=dtype, count=n // np.dtype(dtype).itemsize, offset=at + 4))
        at += 4 + n
    return out


#: Rows between stages: a block for a bucket (kind 1), or spans and requests of a document (kind 0).
STAGE = "bucket int, doc long, fp long, spans binary, block binary"
_STAGE = pa.schema([("bucket", pa.int32()), ("doc", pa.int64()), ("fp", pa.int64()), ("spans", pa.binary()), ("block", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _STAGE.types, strict=True)], schema=_STAGE)


def _doc_rows(doc: np.ndarray, fp: np.ndarray, items: np.ndarray, buckets: int, spans: bool) -> list[tuple]:
    """One row per document with its spans (merged) or its requests."""
    order = np.lexsort((fp, doc))
    doc, fp, items = doc[order], fp[order], items[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])))) if len(doc) else []
    out = []
    for a, b in zip(first, [*first[1:], len(doc)], strict=True) if len(doc) else ():
        part = merge(items[a:b]).tobytes() if spans else items[a:b].tobytes()
        d, f = int(doc[a]), int(fp[a])
        out.append(((d ^ f) % buckets, d, f, part if spans else None, None if spans else part))
    return out


def _scan(buckets: int, length: int):
    """Documents to blocks of anchors by bucket, and spans of regions that an earlier one of the task equals."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        held, size = [], 0
        docs: list[tuple[int, int]] = []

        def flush():
            doc, fp = (np.array([d[i] for d in docs], dtype=np.int64) for i in (0, 1))
            a = np.concatenate(held) if held else np.zeros(0, ANCHOR)
            order = np.lexsort((a["lo"], fp[a["row"]], doc[a["row"]], a["two"], a["one"], a["hash"])) if len(a) else np.zeros(0, np.int64)
            a = a[order]
            same = np.ones(len(a), dtype=bool)
            same[:1] = False
            for c in ("hash", *DIGEST.names):
                same[1:] &= a[c][1:] == a[c][:-1]
            spare, first = a[same], a[~same]
            # A row that repeats its document's first region is the same document once more, not a later one.
            lead = a[np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))][same] if len(a) else spare
            later = (spare["lo"] != lead["lo"]) | (doc[spare["row"]] != doc[lead["row"]]) | (fp[spare["row"]] != fp[lead["row"]])
            spare = spare[later]
            lo = spare["lo"].astype(np.int64)
            rows = _doc_rows(doc[spare["row"]], fp[spare["row"]], np.stack((lo, lo + spare["n"]), axis=1), buckets, True)
            of = (first["hash"] % _U(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            first, of = first[order], of[order]
            there, starts = np.unique(of, return_index=True)  # buckets that the batch has anchors for, however many there are
            for b, part in zip(there.tolist(), np.split(first, starts[1:]), strict=len(there) > 0):
                used, row = np.unique(part["row"], return_inverse=True)
                part = part.copy()
                part["row"] = row
                part = part[np.argsort(part["row"], kind="stable")]
                block = _pack(z, doc[used], fp[used], *[np.ascontiguousarray(part[c]) for c in ANCHOR.names])
                rows.append((b, None, None, None, block))
            return _rows(rows)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (t.as_py() or "").encode("utf-8")
                if len(raw) < length:
                    continue
                docs.append((NULL_ID if i is None else i, fingerprint(raw)))
                for at in range(0, len(raw) - length + 1, SEGMENT):
                    h, g, lo, n, anchor = regions(raw[at : at + SEGMENT + length - 1], length)
                    part = np.empty(len(h), dtype=ANCHOR)
                    part["hash"], part["one"], part["two"], part["row"], part["lo"], part["n"], part["at"] = h, g["one"], g["two"], len(docs) - 1, lo + at, n, anchor
                    held.append(part)
                size += len(raw)
                if size >= BATCH:
                    yield flush()
                    held, docs, size = [], [], 0
        yield flush()

    return run


def _compare(buckets: int):
    """Anchors of a bucket: spans of regions equal to an earlier one; requests for regions under a shared anchor."""

    def run(key, table):
        rows, blocks = [], []
        for r in table.to_pylist():
            if r["block"] is None:
                rows.append((r["bucket"], r["doc"], r["fp"], r["spans"], None))
            else:
                got = _unpack(r["block"], "<i8", "<i8", *[ANCHOR[c] for c in ANCHOR.names])
                h, one, two, row, lo, n, at = got[2:]
                blocks.append((h, one, two, got[0][row], got[1][row], lo.astype(np.int64), n, at))
        if blocks:
            h, one, two, doc, fp, lo, n, at = (np.concatenate(c) for c in zip(*blocks, strict=True))
            order = np.lexsort((lo, fp, doc, two, one, h))
            h, one, two, doc, fp, lo, n, at = (x[order] for x in (h, one, two, doc, fp, lo, n, at))
            new_hash = np.concatenate(([True], h[1:] != h[:-1]))
            new = new_hash | np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            later = ~new & ((lo != lo[lead]) | (doc != doc[lead]) | (fp != fp[lead]))
            rows += _doc_rows(doc[later], fp[later], np.stack((lo[later], lo[later] + n[later]), axis=1), buckets, True)
            group = np.cumsum(new_hash) - 1
            distinct = np.bincount(group[new])
            ask = new & ((distinct[group] > 1) | (at == PERIODIC))
            want = np.stack((h[ask].view(np.int64), lo[ask], n[ask].astype(np.int64), at[ask].astype(np.int64), distinct[group[ask]]), axis=1)
            rows += _doc_rows(doc[ask], fp[ask], want, buckets, False)
        return pa.Table.from_batches([_rows(rows)])

    return run


def _answer(buckets: int, length: int):
    """Documents with requests to blocks of region bytes; spans pass."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        held: dict[int, list] = {}
        alone: dict[bytes, tuple[int, int, int]] = {}
        again: list[tuple[int, int, int]] = []
        size = 0

        def flush():
            for raw, (doc, fp, lo) in alone.items():
                put(xxhash.xxh64_intdigest(raw, seed=1), doc, fp, lo, STRING, raw)
            doc, fp, lo = (np.array([p[i] for p in again], np.int64) for i in (0, 1, 2))
            rows = _doc_rows(doc, fp, np.stack((lo, lo + length), axis=1), buckets, True)
            for b, parts in held.items():
                place = np.array([p[1] for p in parts], dtype=PLACE)
                names = np.array([p[0] for p in parts], dtype=np.uint64)
                rows.append((b, None, None, None, _pack(z, names, place, np.frombuffer(b"".join(p[2] for p in parts), np.uint8))))
            return _rows(rows)

        def put(name: int, doc: int, fp: int, lo: int, at: int, raw: bytes):
            held.setdefault(name % buckets, []).append((name, (doc, fp, lo, len(raw), at), raw))

        for batch in batches:
            rows = []
            for r in batch.select(["_doc", "_fp", "spans", "asks", "_z"]).to_pylist():
                if not r["spans"] and not r["asks"]:
                    continue
                doc, fp = r["_doc"], r["_fp"]
                spans = [np.frombuffer(s, np.int64).reshape(-1, 2) for s in r["spans"]]
                if spans:
                    rows.append(((doc ^ fp) % buckets, doc, fp, merge(np.concatenate(spans)).tobytes(), None))
                if not r["asks"]:
                    continue
                raw = zstandard.decompress(r["_z"])
                for h, lo, n, at, many in np.concatenate([np.frombuffer(s, np.int64).reshape(-1, 5) for s in r["asks"]]).tolist():
                    name = h & ((1 << 64) - 1)
                    if many < MANY:
                        put(name, doc, fp, lo, at, raw[lo : lo + n])
                        size += n
                        continue
                    for p in range(lo, lo + n - length + 1):
                        string, place = raw[p : p + length], (doc, fp, p)
                        was = alone.setdefault(string, place)
                        if was is place:
                            size += length
                        elif was != place:
                            alone[string] = min(was, place)
                            again.append(max(was, place))
                    size += n
                if size >= BATCH:
                    yield _rows(rows)
                    yield flush()
                    rows, held, alone, again, size = [], {}, {}, [], 0
            yield _rows(rows)
        yield flush()

    return run


def _starts_of(parts: list[bytes], step: int):
    """The parts laid end to end, each filled up with zeros to a multiple of ``step``; and where each starts."""
    filled = [p + b"\0" * (-len(p) % step) for p in parts]
    start = np.concatenate(([0], np.cumsum([len(p) for p in filled])[:-1])).astype(np.int64)
    return np.frombuffer(b"".join(filled), dtype=np.uint8), start


def _aligned(place: np.ndarray, parts: list[bytes], length: int):
    """Repeating strings among regions compared at their anchors; (region, first start, last start) arrays."""
    reach = length - GRAM
    data, start = _starts_of([p[a:] for p, a in zip(parts, place["at"].tolist(), strict=True)], 8)
    rank = np.empty(len(data) // 8, dtype=np.int64)
    order = suffix_array(data.view(">u8").astype(np.uint64))
    rank[order] = np.arange(len(order))
    by = np.argsort(rank[start // 8])
    place, start = place[by], start[by]
    view = np.concatenate((data, np.zeros(length, np.uint8)))
    right = np.lib.stride_tricks.sliding_window_view(view, length)[start]
    differs = right[1:] != right[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    left = np.zeros((len(by), reach + 1), dtype=np.uint8)
    for i, (k, a) in enumerate(zip(by.tolist(), place["at"].tolist(), strict=True)):
        left[i, :a] = np.frombuffer(parts[k], np.uint8, count=a)[::-1]
    # The zeros that fill a row lie beyond the bytes that its strings have before the anchor, so they are never compared.
    turned = np.argsort(left.view(f"S{reach + 1}").reshape(-1), kind="stable")
    differs = left[turned[1:]] != left[turned[:-1]]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), reach + 1)
    age = np.empty(len(by), dtype=np.int64)
    age[np.lexsort((place["lo"] + place["at"], place["fp"], place["doc"]))] = np.arange(len(by))
    far = place["at"].astype(np.int64)
    near = far - (place["n"].astype(np.int64) - length)
    seen = np.zeros((len(by), reach + 3), dtype=bool)
    name = np.zeros(len(by), dtype=np.int64)
    for d in range(int(far.max()) + 1):
        who = np.flatnonzero((near <= d) & (d <= far))
        if len(who) > 1:
            name[turned] = np.concatenate(([0], np.cumsum(shared < d)))
            key = (np.concatenate(([0], np.cumsum(common < length - d))) * len(by) + name)[who]
            rows = np.lexsort((age[who], key))
            key = key[rows]
            again = np.concatenate(([False], key[1:] == key[:-1]))
            seen[who[rows[again]], d + 1] = True
    edge = np.diff(seen.astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)  # runs of offsets; both in row order
    anchor = place["lo"][row] + far[row]
    return place["doc"][row], place["fp"][row], anchor - (last - 1), anchor - first


def _periodic(place: np.ndarray, parts: list[bytes], length: int):
    """Repeating strings among regions without a common origin, from a suffix array over their bytes."""
    data, start = _starts_of(parts, 1)
    owner = np.repeat(np.arange(len(parts)), place["n"])
    inner = np.arange(len(data)) - start[owner]
    order = suffix_array(data)
    order = order[inner[order] <= place["n"][owner[order]] - length]
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    new = np.ones(len(order), dtype=bool)
    for at in range(1, len(order), 1 << 15):
        stop = min(at + (1 << 15), len(order))
        new[at:stop] = (view[order[at:stop]] != view[order[at - 1 : stop - 1]]).any(axis=1)
    who = owner[order]
    where = place["lo"][who] + inner[order]
    block = np.cumsum(new)
    rows = np.lexsort((where, place["fp"][who], place["doc"][who], block))
    again = rows[1:][block[rows[1:]] == block[rows[:-1]]]
    return place["doc"][who[again]], place["fp"][who[again]], where[again], where[again]


def _search(buckets: int, length: int):
    """Regions of a bucket to spans of repeating strings."""

    def run(key, table):
        rows, first = [], {}
        doc, fp, spans = [], [], []
        for r in table.to_pylist():
            if r["block"] is None:
                rows.append((r["bucket"], r["doc"], r["fp"], r["spans"], None))
                continue
            names, place, data = _unpack(r["block"], np.uint64, PLACE, np.uint8)
            raw, at = data.tobytes(), 0
            for name, p in zip(names.tolist(), place.tolist(), strict=True):
                k = (name, p[4], raw[at : at + p[3]])
                at += p[3]
                was = first.setdefault(k, p)
                if was[:3] != p[:3]:
                    was, later = (was, p) if was[:3] < p[:3] else (p, was)
                    first[k] = was
                    doc.append(later[0]), fp.append(later[1]), spans.append((later[2], later[2] + later[3]))
        loose = {k[0] for k in first if k[1] == PERIODIC}
        for odd in (False, True):
            own = [k for k in first if k[1] != STRING and (k[0] in loose) == odd]
            if len(own) > (0 if odd else 1):
                place = np.array([first[k] for k in own], dtype=PLACE)
                d, f, a, b = (_periodic if odd else _aligned)(place, [k[2] for k in own], length)
                doc += d.tolist()
                fp += f.tolist()
                spans += zip(a.tolist(), (b + length).tolist(), strict=True)
        rows += _doc_rows(np.array(doc, np.int64), np.array(fp, np.int64), np.array(spans, np.int64).reshape(-1, 2), buckets, True)
        return pa.Table.from_batches([_rows(rows)])

    return run


def _squeeze(keep: list[str]):
    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raws = [(t.as_py() or "").encode("utf-8") for t in batch.column("_text")]
            ids = [NULL_ID if i is None else i for i in batch.column("_id").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(ids, pa.int64()), pa.array(map(fingerprint, raws), pa.int64()), pa.array(map(z.compress, raws), pa.binary())],
                [*keep, "_doc", "_fp", "_z"],
            )

    return run


def _fields(df: DataFrame, cols: list[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols]


def _cut(keep: list[str], length: int, text: str | None):
    """Documents with all their spans to results; ``text`` names the column for the remaining text, if wanted."""

    def run(batches):
        for batch in batches:
            size, gone, runs, sha, rest = [], [], [], [], []
            for packed, found in zip(batch.column("_z"), batch.column("_spans"), strict=True):
                raw = zstandard.decompress(packed.as_py())
                spans = [np.frombuffer(s, np.int64).reshape(-1, 2) for s in (found.as_py() or ())]
                left, at, n = [], 0, 0
                cuts = merge(np.concatenate(spans)).tolist() if spans else []
                for a, b in cuts:
                    left.append(raw[at:a])
                    n, at = n + b - a, b
                left = b"".join([*left, raw[at:]])
                size.append(len(raw)), gone.append(n), runs.append(len(cuts))
                if text is None:
                    sha.append(hashlib.sha256(left).hexdigest())
                else:
                    rest.append(left.decode("utf-8", errors="ignore") if n else raw.decode("utf-8"))
            arrays = [batch.column(c) for c in keep] + [pa.array(x, pa.int64()) for x in (size, gone, runs)]
            arrays.append(pa.array(sha if text is None else rest, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256" if text is None else "_rest"])

    return run


def remove(docs: DataFrame, length: int = LENGTH, text: str = "text", give_text: bool = False) -> DataFrame:
    """Drop repeated bytes. Returns the other columns with n_bytes, n_removed, n_spans and kept_sha256.

    With ``give_text`` the text column holds what is left, in its place, instead of kept_sha256.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    columns = [c for c in docs.columns if c not in added or c == text]
    docs, back = aside(docs.select(*[F.col(f"`{c}`") for c in columns]), "doc_id", text)
    keep = [c for c in docs.columns if c != text]
    spark = docs.sparkSession
    doc_id = F.col("doc_id")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    buckets = max(4 * width(spark), -(-size // BUCKET))
    block = lambda df, f: df.groupBy("bucket").applyInArrow(f, STAGE)
    small, name = ["_doc", "_fp"], [F.col("doc").alias("_doc"), F.col("fp").alias("_fp")]

    anchors = arrow_map(docs.select(doc_id.cast("long").alias("_id"), F.col(text).alias("_text")), _scan(buckets, length), STAGE, rows=256)
    met = block(anchors, _compare(buckets))
    asked = met.groupBy(*name).agg(F.collect_list("spans").alias("spans"), F.collect_list("block").alias("asks"))
    source = docs.select(*keep, doc_id.cast("long").alias("_id"), F.col(text).alias("_text"))
    packed = arrow_map(source, _squeeze(keep), ", ".join([*_fields(docs, keep), "_doc long", "_fp long", "_z binary"]), rows=256)
    # Both joins take the same rows and columns of the packed texts, so that these are shuffled once.
    regions_ = arrow_map(packed.join(asked, small, "left"), _answer(buckets, length), STAGE, rows=256)
    found = block(regions_, _search(buckets, length)).groupBy(*name).agg(F.collect_list("spans").alias("_spans"))
    joined = packed.join(found, small, "left")
    tail = ["n_bytes long", "n_removed long", "n_spans long", "_rest string" if give_text else "kept_sha256 string"]
    out = arrow_map(joined.select(*keep, "_z", "_spans"), _cut(keep, length, text if give_text else None), ", ".join([*_fields(docs, keep), *tail]), rows=256)
    if not give_text:
        return out.select(*back([c for c in columns if c != text]), *added)
    return out.withColumnRenamed("_rest", text).select(*back(columns), *added[:3])
