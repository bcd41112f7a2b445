"""Mixing sources to target weights by entropy balancing.

Targets: each source's weight times a scale, cut at ``cap`` times the source's size; the scale is the one at which all
targets add up to the budget. The sum of cut targets is concave in the scale and has a bend per source, so Newton steps from
below reach the scale after a few sums over the sources.

Rates: among all document rates ``r`` with ``0 < r <= cap`` whose words meet a source's target, the ones closest to "each
document once" in relative entropy, document by document, are ``r = min(cap, exp(lambda * size))``: an exponential tilt by
the document's number of words. The dual is convex; a Newton step for all sources needs two sums per source (words taken and
their derivative), which Spark adds up over the (source, size) cells in each iteration. Steps that leave the interval known to hold
the solution halve it instead. A source whose target is its cap takes every document ``cap`` times.

Copies: a cell of n documents of one size and source takes a whole number of copies. What rounding leaves over moves to
the next smaller size of the source, so a source ends within half of its smallest documents of its target wherever
copies allow. Inside a cell the documents first in hash order get the extra copy; the cell is dealt over hash buckets,
so a size that a third of all rows share is not one task's work.

Defined cases: a null text has size 0; a null source is a source of its own, after all others; a source without words
has target 0 and its documents are taken once (0 words); rows that agree in all columns are interchangeable; an empty
table gives an empty result; in ``mix`` input columns named like an added one are replaced, all other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import aside, durable, words_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Hash buckets of a (source, size) cell.
BUCKETS = 4096
#: Largest share of a target that the dual's solution may leave open.
TOLERANCE = 1e-9
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def numbered(sizes: DataFrame) -> DataFrame:
    """Add ``place``, from 0: sources by UTF-8 bytes, which is the order of code points; null last.

    Rows are sorted by ranges, and each range counts on from the number of rows before it; what the driver sees is one
    number per range.
    """
    ranged = durable(sizes.sort(F.col("source").isNull(), F.col("source")).withColumn("at", F.monotonically_increasing_id()))
    part, own = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = {}, 0
    for r in counts:
        before[r["part"]], total = total, total + r["n"]
    if not before:
        return ranged.withColumn("place", F.lit(0).cast("long")).drop("at")
    offsets = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    return ranged.withColumn("place", F.element_at(offsets, part.cast("long")) + own).drop("at")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(src, source, source_size) to (src, source_size, target)."""
    place = (F.col("place") % len(weights) + 1).cast("int")
    out = durable(numbered(sizes).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)))
    full = float(cap) * F.col("source_size")
    budget = share * float(out.agg(F.sum("source_size")).first()[0] or 0)
    scale, last = 0.0, -1.0
    while scale > last:
        under = full > scale * F.col("weight")
        got = out.agg(F.sum(F.when(~under, full)).alias("full"), F.sum(F.when(under, F.col("weight"))).alias("weight")).first()
        if got["weight"] is None:  # every source is full
            break
        scale, last = max(scale, (budget - float(got["full"] or 0)) / got["weight"]), scale
    return out.select("src", "source_size", F.least(full, F.lit(scale) * F.col("weight")).alias("target"))


def rate(lam, size, cap: float = CAP):
    """Rate of a document from its source's multiplier (per mean size of the source; null: the source is full)."""
    return F.when(lam.isNull() | (size == 0), F.when(size == 0, 1.0).otherwise(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(lam * size)))


def solve_dual(cells: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """Newton iterations on the dual, all sources at once; (src, source_size, target, lam).

    ``cells``: (src, size, n). Words taken rise with a source's multiplier ``lam``; less the target they are the dual's
    gradient, and their derivative is its curvature. ``lam`` is null for full sources. Iterations start at zero, the base,
    and keep an interval around the solution: any ``lam`` under it takes too little, any over it too much. They end when
    all sources are solved; halved intervals make that certain. Driver state is one row: the largest relative residual.
    """
    size = F.col("size").cast("double")
    small = cells.groupBy("src").agg(F.max("size").alias("largest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("smallest"))
    state = goals.join(small, "src")
    open_ = (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size") * (1 - 1e-12))
    # At ln(cap) / smallest all documents are taken cap times; at ln(TOLERANCE) less than that share of the words is.
    state = state.withColumn("lam", F.when(open_, F.lit(0.0)))
    state = state.withColumn("high", F.when(open_, F.log(F.lit(float(cap))) / F.col("smallest")))
    state = state.withColumn("low", F.when(open_, -(F.log(F.lit(1 / TOLERANCE)) + F.log1p(F.col("source_size").cast("double"))) / F.col("smallest")))
    state = durable(state.select("src", "source_size", "target", "lam", "low", "high"))
    while True:
        r = F.least(F.lit(float(cap)), F.exp(F.col("lam") * size))
        words = F.col("n") * size * r
        bend = F.when(F.exp(F.col("lam") * size) < cap, words * size).otherwise(0.0)
        met = cells.join(state.where("lam is not null").select("src", "lam"), "src")
        sums = met.groupBy("src").agg(F.sum(words).alias("words"), F.sum(bend).alias("bend"))
        excess = F.col("words") - F.col("target")
        now = state.join(sums, "src", "left").withColumns({"low": F.when(excess < 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(excess > 0, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") - excess / F.col("bend")
        inside = (F.col("bend") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        step = F.when(excess == 0, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        left = F.abs(excess) / F.col("target")
        # An interval that holds no other number is as good as solved.
        left = F.when((step <= F.col("low")) | (step >= F.col("high")), 0.0).otherwise(left)
        now = durable(now.select("src", "source_size", "target", "low", "high", "lam", F.when(left > TOLERANCE, step).otherwise(F.col("lam")).alias("next"), left.alias("left")))
        worst = now.agg(F.max("left")).first()[0]
        if worst is None or worst <= TOLERANCE:
            return now.select("src", "source_size", "target", "lam")
        state = now.select("src", "source_size", "target", F.col("next").alias("lam"), "low", "high")


def _diffuse(cap: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Copies of each cell of one source; a row per distinct size, so no more rows than the longest text has words."""
        pdf = pdf.sort_values("size", ascending=False)
        left, total = 0.0, []
        for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist(), strict=True):
            if size == 0:
                total.append(n)
                continue
            want = n * size * rate + left
            k = min(max(round(want / size), 0), int(cap * n))
            left = want - k * size
            total.append(k)
        return pdf.assign(total=total)[["src", "size", "n", "total", "rate", "source_size", "target"]]

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, text: str = "text") -> DataFrame:
    """Add size, source_size, target, rate, copies and taken to every row; ``copies`` is 0 to ``cap``."""
    kept = [c for c in docs.columns if c not in ADDED or c in ("source", text)]
    base, back = aside(docs.select(*[F.col(f"`{c}`") for c in kept]), "doc_id", "source", text)
    sized = base.withColumn("size", F.size(words_of(F.col(text))).cast("long"))
    key = lambda df: df.withColumn("src", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    order = F.xxhash64(*[F.col(c) for c in base.columns if c in ("doc_id", text)])
    rest = [F.xxhash64(*others)] if (others := [c for c in base.columns if c not in ("doc_id", "source", text) and "map<" not in dict(base.dtypes)[c]]) else []
    bucket = F.pmod(order, F.lit(BUCKETS)).cast("int")
    fine = durable(
        key(sized.select("source", "size", bucket.alias("bucket"))).groupBy("src", "size", "bucket").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"))
    )
    cells = durable(fine.groupBy("src", "size").agg(F.first("source").alias("source"), F.sum("n").alias("n")))
    sizes = cells.groupBy("src").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    dual = solve_dual(cells, targets(sizes, weights, share, cap), cap)
    rated = cells.join(dual, "src").withColumn("rate", rate(F.col("lam"), F.col("size"), cap))
    totals = (
        rated.select("src", "size", "n", "rate", "source_size", "target")
        .groupBy("src")
        .applyInPandas(_diffuse(cap), "src string, size long, n long, total long, rate double, source_size long, target double")
    )
    # Extra copies of a cell go to its buckets in order.
    before = F.coalesce(F.sum("m").over(Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = (
        fine.select("src", "size", "bucket", F.col("n").alias("m"))
        .withColumn("before", before)
        .join(totals, ["src", "size"])
        .select("src", "size", "bucket", "source_size", "target", "rate", F.expr("total div n").alias("every"), (F.expr("total % n") - F.col("before")).alias("more"))
    )
    rows = key(sized).withColumn("bucket", bucket)
    place = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy(order, *[c for c in base.columns if c == "doc_id"], *rest))
    copies = (F.col("every") + F.when(F.col("place") <= F.col("more"), 1).otherwise(0)).cast("int")
    return (
        rows.withColumn("place", place)
        .join(parts, ["src", "size", "bucket"])
        .withColumn("copies", copies)
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .select(*back(kept), *ADDED)
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row as often as it is taken; the columns are those of ``docs``."""
    plain, back = aside(docs, "doc_id", "source", how.get("text", "text"))
    out = mix(plain, **how).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*back(docs.columns))
