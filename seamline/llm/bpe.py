"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last 32 bytes falls under a bound, so equal passages get equal chunks
wherever they stand. A task encodes each distinct chunk once and reuses its ids for every document that holds it.
Ids near a cut can be wrong, as a merge or a pre-token may span it. Each join is therefore repaired: the text around
it is encoded anew, from the last sure boundary before the cut to the first one after it, and the new ids replace the
chunk's own. A sure boundary is an ASCII blank or line feed after a visible ASCII character: no pre-token and no
special token of a byte-level vocabulary spans it, whatever stands further left or right. The repair widens until both
ends agree with the chunks' own ids; a chunk without a sure boundary is encoded with its neighbours.

No row leaves its task: nothing is shuffled, no key can be hot, and a lost executor costs its own tasks only. Chunks are
shared within a task; moving texts or ids between tasks costs more than encoding a chunk once in each of them.

Defined cases: a null text is the empty one; an empty text has no ids; rows are handled one by one, so repeated rows
and identifiers keep a row each; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seamline.llm.common import arrow_map
from seamline.llm.rolling import windows

WINDOW = 32
#: One cut in so many bytes.
CHUNK = 1024
#: Bytes of chunks, with their ids, that a task remembers at once.
MEMO = 32 << 20
#: Bytes that a remembered chunk takes besides its text, ids and their ends.
OBJECTS = 400
#: A longer stretch without a sure boundary, or one with characters past U+024F, goes to the reference encoder.
STRETCH = 2048
LATIN = 0xC9


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes without one are counted up from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        #: Fixed value: the pre-token pattern of byte-level BPE.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = tuple(special)
        size = max([*ranks.values(), *special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.pieces[i] = piece
        self.decimal = [str(i).encode() for i in range(size)]
        self.length = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def encode_piece(self, raw: bytes, data: np.ndarray, stretch: int) -> np.ndarray:
        text = raw.decode("utf-8")
        if stretch > STRETCH or data.max() > LATIN or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@dataclass
class Chunk:
    ids: np.ndarray
    ends: np.ndarray  # bytes up to the end of each id


class Encoder:
    """Encodes texts with a memory of chunks; the memory is dropped when it holds ``memo`` bytes."""

    def __init__(self, path: str, chunk: int = CHUNK, memo: int = MEMO):
        self.codec, self.memo, self.known, self.held = codec(path), memo, {}, 0
        self.bound = np.uint64((1 << 64) // chunk)
        self.reused = self.encoded = self.repaired = 0

    def _piece(self, raw: bytes, data: np.ndarray, lo: int, hi: int, stretch: int) -> Chunk:
        key = raw[lo:hi]
        found = self.known.get(key)
        if found is None:
            ids = self.codec.encode_piece(key, data[lo:hi], stretch)
            found = Chunk(ids, np.cumsum(self.codec.length[ids], dtype=np.int32))
            if self.held > self.memo:
                self.known, self.held = {}, 0
            self.known[key] = found
            self.held += len(key) + found.ids.nbytes + found.ends.nbytes + OBJECTS
            self.encoded += 1
        else:
            self.reused += 1
        return found

    def encode(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8")
        n = len(raw)
        if not n:
            return np.zeros(0, dtype=np.int64)
        data = np.frombuffer(raw, dtype=np.uint8)
        seen = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
        sure = np.flatnonzero(seen & ((data[1:] == 0x20) | (data[1:] == 0x0A))) + 1
        sure = np.concatenate(([0], sure, [n]))
        stretch = int(np.diff(sure).max())
        cuts = np.flatnonzero(windows(data, WINDOW) < self.bound) + WINDOW
        cuts = cuts[cuts < n]
        cuts = cuts[(data[cuts] & 0xC0) != 0x80]  # never inside a character
        cuts = np.concatenate(([0], cuts, [n]))
        chunks = [self._piece(raw, data, a, b, stretch) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if len(chunks) == 1:
            return chunks[0].ids
        # Of each cut, the sure boundary at or before it and the one at or after it.
        before = sure[np.searchsorted(sure, cuts, side="right") - 1].tolist()
        after = sure[np.searchsorted(sure, cuts, side="left")].tolist()
        starts = cuts.tolist()
        out: list[np.ndarray] = []
        done = 0  # bytes of the text whose ids are out
        for k, c in enumerate(chunks):
            lo, hi = max(after[k], done), before[k + 1]
            if lo >= hi:
                continue  # no sure stretch of its own: the next repair takes it in
            a = int(np.searchsorted(c.ends, lo - starts[k], side="right")) if lo > starts[k] else 0
            b = int(np.searchsorted(c.ends, hi - starts[k], side="right"))
            at = lambda i: starts[k] + (int(c.ends[i - 1]) if i else 0)  # noqa: E731, B023
            if at(a) != lo or at(b) != hi:
                continue  # the ends disagree: widen over this chunk
            if lo > done:
                out.append(self._piece(raw, data, done, lo, stretch).ids)
                self.repaired += 1
            out.append(c.ids[a:b])
            done = hi
        if done < n:
            out.append(self._piece(raw, data, done, n, stretch).ids)
            self.repaired += 1
        return np.concatenate(out)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Add ``ids array<int>`` and ``decoded string`` (or, with ``digests``, their number and SHA-256) to each row.

    ``text`` itself is dropped with ``digests``; input columns named like an added one are replaced, all others stay.
    """
    path = path or default_path()
    new = {"n_tokens": "long"}
    if digests:
        new |= {"ids_sha256": "string", "decoded_sha256": "string"}
    if ids:
        new |= {"ids": "array<int>", "decoded": "string"}
    keep = [c for c in docs.columns if c not in new and not (digests and c == text)]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{k} {v}" for k, v in new.items()])
    source = docs.select(*dict.fromkeys([*keep, text]))

    def run(batches):
        enc = Encoder(path)
        pieces, decimal = enc.codec.pieces, enc.codec.decimal
        for batch in batches:
            cols = {k: [] for k in new}
            for t in batch.column(text):
                got = enc.encode(t.as_py() or "").tolist()
                cols["n_tokens"].append(len(got))
                whole = b"".join(map(pieces.__getitem__, got)).decode("utf-8", errors="replace")
                if digests:
                    cols["ids_sha256"].append(hashlib.sha256(b",".join(map(decimal.__getitem__, got))).hexdigest())
                    cols["decoded_sha256"].append(hashlib.sha256(whole.encode("utf-8")).hexdigest())
                if ids:
                    cols["ids"].append(got)
                    cols["decoded"].append(whole)
            types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            arrays = [batch.column(c) for c in keep] + [pa.array(v, types.get(k, pa.string())) for k, v in cols.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *new])

    return arrow_map(source, run, schema, rows=256)
