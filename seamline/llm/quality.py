"""Quality rules, line first: bad lines go, then documents that lost too much of their text.

Every rule is a Spark SQL expression on a single row: no shuffle, no Python workers, and no state beyond the row.

A line fails when it is
* navigation: at least ``nav_marks`` separators of ``|»•·`` and one for each ``nav_words`` words,
* boilerplate: it holds one of the stock phrases,
* symbols: one of ``#*$%&|<>`` or more for each ``symbol_words`` words, from ``min_marked_words`` words on,
* shouting: from ``min_marked_words`` words on, no small ASCII letter and a word with a capital,
* unpunctuated: no sentence or clause mark at all, from ``min_plain_words`` words on.

A document is kept if the base rules hold (enough words, few repeated five-word windows) and at most
``max_lost`` of its lines' code points went with failed lines.

Defined cases: a null or empty text has zero counts, fails the base rule and is not kept; rows are judged one by
one, so ties and repeated rows do not matter; columns that clash with the names added here are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import aside, flat


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    nav_marks: int = 2
    nav_words: int = 4
    symbol_words: int = 3
    min_marked_words: int = 3
    min_plain_words: int = 5
    max_lost_pct: int = 50
    phrases: tuple[str, ...] = (
        "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "all rights reserved",
        "click here", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "sign up for",
    )


RULES = Rules()


def with_repeated_words(df: DataFrame, words: str, window: int, out: str) -> DataFrame:
    """Add the number of words that lie in a window of ``window`` words found twice or more.

    Windows become 64-bit hashes. Most texts repeat none, which sorting the bare hashes shows. For the others,
    sorting (hash, start) brings equal ones together, and the starts that have an equal neighbour, sorted again, give
    the covered words as a sum of gaps no longer than the window. Each array is a column of its own, so that no lambda
    evaluates another array anew for each of its elements.
    """
    h, g, s, o = (F.col(c) for c in ("_h", "_g", "_s", "_o"))
    grams = F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (window - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, window)]),
    )
    same = F.transform(o, lambda x, i: F.when(x["h"].eqNullSafe(F.get(o, i - 1)["h"]) | x["h"].eqNullSafe(F.get(o, i + 1)["h"]), x["i"]))
    covered = F.aggregate(
        F.array_sort(F.filter(same, lambda p: p.isNotNull())),
        F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(window))).cast("long").alias("n")),
    )["n"]
    return (
        df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
        .withColumn("_g", grams)
        .withColumn("_s", F.sort_array("_g"))
        .withColumn("_twice", F.exists(F.transform(s, lambda x, i: x.eqNullSafe(F.get(s, i + 1))), lambda x: x))
        .withColumn("_o", F.when(F.col("_twice"), F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .withColumn(out, F.when(F.col("_twice"), covered).otherwise(F.lit(0).cast("long")))
        .drop("_h", "_g", "_s", "_o", "_twice")
    )


WORD = "[^\\x20\\x09-\\x0D]"
NAV, SYMBOL, CLAUSE = "|»•·", "#*$%&|<>", ".,;:!?…"


def _count(value: Column, marks: str) -> Column:
    return F.length(value) - F.length(F.translate(value, marks, ""))


def _any(value: Column, marks: str) -> Column:
    return F.rlike(value, F.lit("[" + marks + "]"))


def line_fails(line: Column, r: Rules = RULES) -> Column:
    """Each rule opens with a test that ends early on common lines; only then are marks and words counted."""
    n = F.regexp_count(line, F.lit(WORD + "+"))
    low = F.lower(line)
    phrase = F.lit(False)
    for p in r.phrases:
        phrase = phrase | F.contains(low, F.lit(p))
    return (
        (_any(line, NAV) & (_count(line, NAV) >= r.nav_marks) & (_count(line, NAV) * r.nav_words >= n))
        | (_any(line, SYMBOL) & (n >= r.min_marked_words) & (_count(line, SYMBOL) * r.symbol_words >= n))
        | (~_any(line, "a-z") & _any(line, "A-Z") & (n >= r.min_marked_words))
        | (~_any(line, CLAUSE) & (n >= r.min_plain_words))
        | phrase
    )


def judge(docs: DataFrame, r: Rules = RULES, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, clean_text, kept."""
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text", "kept")
    columns = [c for c in docs.columns if c not in added or c == text]
    plain, back = aside(docs.select(*[F.col(f"`{c}`") for c in columns]), text)
    t = F.coalesce(F.col(text), F.lit(""))
    out = plain.withColumn("_f", flat(F.col(text))).withColumn("_l", F.split(t, "\n", -1))
    out = out.withColumn("_w", F.filter(F.split("_f", " ", -1), lambda w: w != ""))
    out = out.withColumn("_spoken", F.filter("_l", lambda x: F.rlike(x, F.lit(WORD))))
    out = out.withColumn("_good", F.filter("_l", lambda x: ~line_fails(x, r)))
    size = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    out = out.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.replace("_f", F.lit(" "), F.lit(""))).cast("long"),
            "n_symbols": F.when(_any(t, SYMBOL), _count(t, SYMBOL)).otherwise(0).cast("long"),
            "n_dup_lines": (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long"),
            "_all": size(F.col("_l")),
            "lost_chars": size(F.col("_l")) - size(F.col("_good")),
        }
    )
    out = with_repeated_words(out, "_w", r.window, "n_repeat_words")
    out = out.withColumn("base_failed", (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_pct * F.col("n_words")))
    lost = 100 * F.col("lost_chars") > r.max_lost_pct * F.col("_all")
    # A row number in the verdict keeps the optimizer from moving filters on it below the projections above: there it would
    # put whole arrays in place of their names, to be built anew for each element that looks at them.
    kept = ~F.col("base_failed") & ~lost & (F.monotonically_increasing_id() >= 0)
    done = out.withColumns({"clean_text": F.array_join("_good", "\n"), "kept": kept})
    return done.select(*back(columns), *added)


def clean(docs: DataFrame, r: Rules = RULES) -> DataFrame:
    """Documents that the rules keep, without their failed lines; the columns stay those of ``docs``."""
    plain, back = aside(docs, "text", "n_chars")
    done = judge(plain, r).where("kept")
    own = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return done.withColumns(own).select(*back(docs.columns))
