"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's frequency vector holds how often each of ``GROUPS`` groups of letters occurs in it. One replaced letter moves at
most one unit between two groups, one deleted letter takes one unit from one group. The trie arranges words by length,
then by the successive counts; a depth-first search from another word goes on with a budget of one surplus and one
deficit and leaves every branch that would spend more. Words at the leaves it reaches are compared letter by letter.

Each pair is met once: the search looks from the longer word for shorter ones (one deficit), and between equal lengths
only for vectors whose first difference is a surplus; words of one vector are paired by their order.

Spark: words are counted with partial sums inside the tasks. The upper levels of the trie, length and the first ``depth``
counts, are the shuffle key. A word is stored once under its own key and searches under the keys that the budget can
reach, with what is left of the budget; below its key each task builds the rest of the trie. ``depth`` follows the number
of words. A key that holds more than ``FULL`` words is dealt over shards by the words' hash, searches visit all of them:
the words of one shard, and a few thousand searches, are all that a task holds.

Defined cases: a null or empty text holds no word; a null doc_id is the empty string; repeated rows count each; further
columns are ignored, whatever their names; an empty table gives an empty result; words of any length are compared whole;
ties of the most frequent near word go to the first in code-point order.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import arrow_map, durable, width

#: Letter groups: code points that agree in their last four bits. Common letters come first, so that upper levels part well.
GROUPS = (5, 1, 9, 14, 15, 4, 2, 3, 8, 12, 7, 13, 6, 0, 11, 10)
PLACE = tuple(GROUPS.index(g) for g in range(16))
#: Words per shard of a key.
FULL = 16384
#: Words below which a branch is not parted further.
LEAF = 16
#: Searches that descend together.
TOGETHER = 4096
#: Distinct words that a counting task holds before it hands them on.
HELD = 400_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counting(least: int, damage: int):
    letters = re.compile(f"[a-z\u00c0-\u00ff]{{{least},}}")  # a shorter run is no word, damaged or not

    def run(batches):
        seen: dict[str, int] = defaultdict(int)

        def out():
            block = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return block

        for b in batches:
            for who, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                who += b":"
                for w, n in Counter(letters.findall(text.translate(LOWER).decode(errors="replace"))).items():
                    if damage and not (h := crc32(who + w.encode())) % damage:
                        if len(w) == least:
                            continue
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    seen[w] += n
                if len(seen) > HELD:
                    yield out()
        if seen:
            yield out()

    return run


def vocabulary(docs: DataFrame, least: int = 6, often: int = 5, damage: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lower-cased, of ``least`` code points found ``often`` times or more.

    With ``damage``, a run of a document loses one letter where ``damage`` divides the CRC of ``doc_id:run``: planted misspellings.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary").alias("who"), F.col(text).cast("binary").alias("text"))
    return arrow_map(rows, _counting(least, damage), "word string, n long", 256).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def vector(word: str) -> list[int]:
    v = [0] * len(GROUPS)
    for c in word:
        v[PLACE[ord(c) & 15]] += 1
    return v


#: What a search may still spend, and what one more step costs: difference of a stored count to the searching word's, to
#: the budget left. "same": both units left, of which the surplus comes first; "owed": the deficit is left and due;
#: "less": a shorter word's one deficit is left; "none": nothing is left.
STEPS = {"same": ((0, "same"), (1, "owed")), "owed": ((0, "owed"), (-1, "none")), "less": ((0, "less"), (-1, "none")), "none": ((0, "none"),)}


def reach(word: str, depth: int):
    """(key, budget left) of all upper nodes that a search from the word can reach."""
    v, size = vector(word), len(word)
    paths = [((size,), "same"), ((size - 1,), "less")]
    for level in range(depth):
        paths = [((*at, v[level] + d), then) for at, left in paths for d, then in STEPS[left] if v[level] + d >= 0]
    return paths


def key(path) -> str:
    return ",".join(map(str, path))


def _routing(depth: int, least: int):
    def run(batches):
        for b in batches:
            where, left, words, ns = [], [], [], []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where.append(key((len(w), *vector(w)[:depth])))
                left.append("")
                for path, budget in reach(w, depth):
                    if path[0] >= least:
                        where.append(key(path))
                        left.append(budget)
                words += [w] * (len(where) - len(words))
                ns += [n] * (len(where) - len(ns))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.string()), pa.array(left, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["key", "left", "word", "n"])

    return run


def grow(items: list, level: int):
    """The trie below a level: counts to branches, or the items (word, n, vector) themselves."""
    if len(items) <= LEAF or level == len(GROUPS):
        return items
    parts = defaultdict(list)
    for item in items:
        parts[item[2][level]].append(item)
    return {c: grow(part, level + 1) for c, part in parts.items()}


def one_edit(a: str, b: str) -> bool:
    """Does one replaced letter, or one letter less, make ``b`` of ``a``? ``a`` is not the shorter one."""
    at = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        at += 1
    else:
        return len(a) == len(b) + 1
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


def descend(node, level: int, seekers: list, left: str, found: list) -> None:
    """Depth-first search of all ``seekers`` (word, n, vector) at once; those that still share a branch go on together."""
    if isinstance(node, list):
        for a in seekers:
            word = a[0]
            # An edit leaves the first or the last half as it is; few other words agree in one.
            head, tail = word[: len(word) // 2], word[len(word) // 2 :]
            for b in node:
                other = b[0]
                if (other.startswith(head) or other.endswith(tail)) and one_edit(word, other):
                    # "same" at a leaf: no difference was met above it, what lies below decides which of the two looks for the other.
                    if left != "same" or (b[2][level:], other) > (a[2][level:], word):
                        found.append((a, b))
        return
    parts = defaultdict(list)
    for a in seekers:
        parts[a[2][level]].append(a)
    for c, branch in node.items():
        for d, then in STEPS[left]:
            if c - d in parts:
                descend(branch, level + 1, parts[c - d], then, found)


def _searching(depth: int):
    def run(batches):
        at, stored, trie, seekers = None, [], None, defaultdict(list)

        def out(left):
            found = []
            descend(trie, depth, seekers.pop(left), left, found)
            words = [a[0] for a, _ in found] + [b[0] for _, b in found]
            others = [b[0] for _, b in found] + [a[0] for a, _ in found]
            ns = [b[1] for _, b in found] + [a[1] for a, _ in found]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(others, pa.string()), pa.array(ns, pa.int64())], names=["word", "other", "other_n"])

        for b in batches:
            for k, shard, left, w, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if at != (k, shard):
                    for budget in list(seekers):
                        yield out(budget)
                    at, stored, trie = (k, shard), [], None
                if not left:  # stored words come first
                    stored.append((w, n, vector(w)))
                    continue
                if not stored:
                    continue
                if trie is None:
                    trie = grow(stored, depth)
                seekers[left].append((w, n, vector(w)))
                if len(seekers[left]) == TOGETHER:
                    yield out(left)
        for budget in list(seekers):
            yield out(budget)

    return run


def depth_for(words: int) -> int:
    """Levels in the shuffle key: each parts a key's words in about three."""
    return min(len(GROUPS), max(0, math.ceil(math.log(max(1, words) / (8 * FULL), 3))))


def near_words(words: DataFrame, least: int = 6, depth: int | None = None) -> DataFrame:
    """(word, n) to (word, other, other_n), both ways, for all words that one edit parts."""
    if depth is None:
        depth = depth_for(words.count())
    spark = words.sparkSession
    routed = arrow_map(words.select("word", "n"), _routing(depth, least), "key string, left string, word string, n long", 4096)
    held = routed.where("left = ''").groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    shards = F.ceil(F.col("held") / FULL).cast("int")
    met = routed.join(held.select("key", shards.alias("shards")), "key")
    shard = F.when(F.col("left") == "", F.array(F.pmod(F.crc32(F.col("word").cast("binary")), F.col("shards")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("shards") - 1))
    placed = met.select("key", F.explode(shard).alias("shard"), "left", "word", "n")
    placed = placed.repartition(4 * width(spark), "key", "shard").sortWithinPartitions("key", "shard", "left")
    return arrow_map(placed, _searching(depth), "word string, other string, other_n long", 4096)


def last_of(forms: DataFrame, most: int) -> DataFrame:
    """(word, form) to (word, root): the last word of the chain of forms, each round doubling the reach.

    A form is found at least five times as often as its word, so the largest count bounds the chain and with it the rounds.
    """
    at = durable(forms.select("word", F.col("form").alias("root")))
    steps, longest = 1, math.log(max(most, 5), 5) + 1
    while steps < longest:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = durable(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps *= 2
    return at


def group_variants(docs: DataFrame, least: int = 6, often: int = 5, factor: int = 5, damage: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary.

    ``form`` is the most frequent near word if it is found ``factor`` times as often as the word; ``root`` the end of its chain.
    """
    words = durable(vocabulary(docs, least, often, damage, doc_id, text))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(words, least).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= factor * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")
    )
    out = durable(out)
    most = out.agg(F.max("n")).first()[0]
    if most is None:
        return out.withColumn("root", F.col("word"))
    roots = last_of(out.where("form is not null"), most)
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
