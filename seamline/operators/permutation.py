"""Do a symbol's runs share a future? Total variation between its nearest and furthest runs, against relabelled ones.

Replicates are drawn as counts, never as permuted rows: ``n_fix`` of the near and of the far runs without replacement, as
their places in the cumulated counts, and for the null ``n_fix`` of those 2 n_fix again. All comparisons are of one size, so
the bias of the plug-in distance is the same in all. Places come by Floyd's rule from md5 draws of seed and keys: what a
replicate draws depends on nothing else, and SQL repeats it. The work is symbols times replicates, whatever the number of
runs, of which only counts are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_PERM, N_FIX, MIN_RUNS = 2000, 100, 200
PARTS = 4  # draws of 32 bits in an md5


def uniforms(n: int, *key: Column) -> Column:
    """``n`` draws in [0, 1) from seed and keys."""
    word = lambda w: F.md5(F.concat_ws("|", *[k.cast("string") for k in key], w.cast("string")))
    heads = F.transform(F.sequence(F.lit(0), F.lit(-(-n // PARTS) - 1)), word)
    bits = F.flatten(F.transform(heads, lambda h: F.array(*[F.conv(F.substring(h, 8 * p + 1, 8), 16, 10).cast("double") / 2.0**32 for p in range(PARTS)])))
    return F.slice(bits, F.lit(1), F.lit(n))


def subset(total: Column, n: int, draws: Column) -> Column:
    """``n`` distinct places under ``total``, every subset as likely: the j-th draw is taken unless it was, then j itself is."""
    tried = F.transform(draws, lambda u, i: F.struct((total - n + i).cast("long").alias("j"), F.floor(u * (total - n + i + 1)).cast("long").alias("t")))
    start = F.array().cast("array<bigint>")
    return F.aggregate(tried, start, lambda s, x: F.concat(s, F.array(F.when(F.array_contains(s, x["t"]), x["j"]).otherwise(x["t"]))))


def falling(places: Column, counts: Column) -> Column:
    """How many places fall on each category, categories laid end to end with their counts."""
    ends = F.transform(counts, lambda _, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x))
    under = F.transform(ends, lambda e: F.size(F.filter(places, lambda p: p < e)).cast("long"))
    return F.transform(under, lambda u, i: u - F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(under, i - 1)))


def distance(a: Column, b: Column, n: int) -> Column:
    """Total variation of two counts of ``n`` items each."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x) / (2.0 * n)


def fixed_draws(pairs: DataFrame, n_fix: int, *key: str) -> DataFrame:
    """Adds observed and null to rows with arrays near and far of at least ``n_fix`` items; keys name the draw."""
    total = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda s, x: s + x)
    of = lambda what: uniforms(n_fix, *[F.col(k) for k in key], F.lit(what))
    out = pairs.withColumns({"_un": of("near"), "_uf": of("far"), "_u0": of("null"), "_tn": total("near"), "_tf": total("far")})
    out = out.withColumns({"_pn": subset(F.col("_tn"), n_fix, F.col("_un")), "_pf": subset(F.col("_tf"), n_fix, F.col("_uf")), "_p0": subset(F.lit(2 * n_fix), n_fix, F.col("_u0"))})
    out = out.withColumns({"_n": falling(F.col("_pn"), F.col("near")), "_f": falling(F.col("_pf"), F.col("far"))})
    out = out.withColumn("_pool", F.zip_with("_n", "_f", lambda x, y: x + y))
    out = out.withColumn("_again", falling(F.col("_p0"), F.col("_pool")))
    rest = F.zip_with("_pool", "_again", lambda x, y: x - y)
    return out.select(*pairs.columns, distance(F.col("_n"), F.col("_f"), n_fix).alias("observed"), distance(F.col("_again"), rest, n_fix).alias("null"))


def sides(runs: DataFrame, *by: str) -> DataFrame:
    """(by, symbol, what, near, far, n_near, n_far): counts by category of the first and the last quartile's runs.

    ``runs``: code, next_state (null: not seen), duration_bin, quartile, and ``by``. Next states are of uncensored runs,
    durations of all. Categories are as many as states or bins.
    """
    ends = runs.where("quartile = 0 or quartile = 3")
    kinds = F.array(F.struct(F.lit("next").alias("what"), F.col("next_state").cast("long").alias("v")), F.struct(F.lit("duration").alias("what"), F.col("duration_bin").cast("long").alias("v")))
    long = ends.select(*by, F.col("code").alias("symbol"), (F.col("quartile") == 0).alias("near"), F.explode(kinds).alias("k")).where("k.v is not null")
    side = lambda near: F.sum(F.when(F.col("near") == near, 1).otherwise(0)).cast("long")
    return long.groupBy(*by, "symbol", "k.what", F.col("k.v").alias("v")).agg(side(True).alias("near"), side(False).alias("far"))


def stacked(counts: DataFrame, *by: str) -> DataFrame:
    """One row per symbol and comparison, counts in arrays by category."""
    rows = counts.groupBy(*by, "symbol", "what").agg(F.sort_array(F.collect_list(F.struct("v", "near", "far"))).alias("c"), F.sum("near").alias("n_near"), F.sum("far").alias("n_far"))
    return rows.select(*by, "symbol", "what", F.transform("c", lambda x: x["near"]).alias("near"), F.transform("c", lambda x: x["far"]).alias("far"), "n_near", "n_far")


def symbol_table(runs: DataFrame, seed: int = 0, n_perm: int = N_PERM, n_fix: int = N_FIX, min_runs: int = MIN_RUNS) -> DataFrame:
    """Per symbol and comparison: n_runs and frames of the extreme quartiles, n_near, n_far, tv, null, excess and a +1-smoothed p.

    Symbols under ``min_runs`` are left out; a comparison under half of that, or with under ``n_fix`` runs on a side, has no numbers.
    """
    spark = runs.sparkSession
    mass = runs.where("quartile = 0 or quartile = 3").groupBy(F.col("code").alias("symbol")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("duration").alias("frames")).where(F.col("n_runs") >= min_runs)
    asked = mass.join(spark.createDataFrame([("next",), ("duration",)], "what string"), how="cross")  # two rows
    rows = asked.join(stacked(sides(runs)), ["symbol", "what"], "left")
    enough = (F.least("n_near", "n_far") >= n_fix) & (F.col("n_near") + F.col("n_far") >= min_runs // 2)
    reps = rows.where(enough).select("symbol", "what", "near", "far", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("rep"), F.lit(seed).alias("seed"))
    reps = reps.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol", "what", "rep")
    drawn = fixed_draws(reps, n_fix, "seed", "symbol", "what", "rep").select("symbol", "what", "observed", "null")
    # The p compares each null with the mean observed distance: nulls are counted by value first, as there are no more than n_fix + 1 of them.
    mean = drawn.groupBy("symbol", "what", F.col("null").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.sum("observed").alias("o"))
    mean = mean.groupBy("symbol", "what").agg(F.collect_list(F.struct("v", "k")).alias("nulls"), (F.sum("o") / n_perm).alias("tv"), (F.sum(F.col("v") * F.col("k")) / n_perm).alias("null"))
    beyond = F.aggregate("nulls", F.lit(0).cast("long"), lambda s, x: s + F.when(x["v"] >= F.col("tv") - 1e-12, x["k"]).otherwise(0))
    out = rows.drop("near", "far").join(mean, ["symbol", "what"], "left")
    return out.select("symbol", "what", "n_runs", "frames", "n_near", "n_far", "tv", "null", (F.col("tv") - F.col("null")).alias("excess"), ((1 + beyond) / (1 + n_perm)).alias("p"))


def aggregate(table: DataFrame, what: str = "next", q: float = 0.05) -> DataFrame:
    """Mean excess weighted by frames, and, as a description only, the share of symbols and frames that fail a false discovery rate of ``q``; one row.

    Symbols are as many as states.
    """
    from pyspark.sql import Window

    live = table.where((F.col("what") == what) & F.col("excess").isNotNull())
    ranked = live.withColumns({"r": F.row_number().over(Window.orderBy("p", "symbol")), "m": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})  # a row per state
    ranked = ranked.withColumn("cut", F.max(F.when(F.col("p") <= q * F.col("r") / F.col("m"), F.col("p"))).over(Window.partitionBy(F.lit(1))))
    bad = F.coalesce(F.col("p") <= F.col("cut"), F.lit(False))
    mean = lambda c: F.sum(F.col(c) * F.col("frames")) / F.sum("frames")
    return ranked.agg(
        F.count(F.lit(1)).alias("n_symbols"), mean("excess").alias("excess"), F.avg("excess").alias("excess_unweighted"), mean("tv").alias("tv"), mean("null").alias("null"),
        F.avg(bad.cast("int")).alias("failing_share"), (F.sum(F.when(bad, F.col("frames")).otherwise(0)) / F.sum("frames")).alias("failing_frames"),
    )


def leave_one_out(runs: DataFrame, table: DataFrame, group: str = "animal", seed: int = 0, n_fix: int = N_FIX) -> DataFrame:
    """(group, theta): the weighted excess without each group's runs, every null held at its value on all runs.

    A group's counts are taken off the totals: rows are groups times symbols.
    """
    seen = runs.where("(quartile = 0 or quartile = 3) and next_state is not null")
    own = sides(seen, group).where("what = 'next'")
    all_ = own.groupBy("symbol", "what", "v").agg(F.sum("near").alias("an"), F.sum("far").alias("af"))
    mass = seen.groupBy(group, F.col("code").alias("symbol")).agg(F.sum("duration").alias("w"))
    whole = mass.groupBy("symbol").agg(F.sum("w").alias("all_w"))
    left = seen.select(group).distinct().join(all_, how="cross").join(own, [group, "symbol", "what", "v"], "left")  # groups times states times states
    left = left.select(group, "symbol", "what", "v", (F.col("an") - F.coalesce("near", F.lit(0))).alias("near"), (F.col("af") - F.coalesce("far", F.lit(0))).alias("far"))
    rows = stacked(left, group).where(F.least("n_near", "n_far") >= n_fix).withColumns({"seed": F.lit(seed), "rep": F.lit("without")})
    drawn = fixed_draws(rows, n_fix, "seed", "symbol", "what", "rep", group)
    nulls = table.where("what = 'next' and excess is not null").select("symbol", F.col("null").alias("held"))
    out = drawn.join(nulls, "symbol").join(whole, "symbol").join(mass, [group, "symbol"], "left").withColumn("left_w", F.col("all_w") - F.coalesce("w", F.lit(0)))
    return out.groupBy(group).agg((F.sum(F.col("left_w") * (F.col("observed") - F.col("held"))) / F.sum("left_w")).alias("theta"))


def interval(left: DataFrame, point: DataFrame, z: float = 1.96) -> DataFrame:
    """Point, se, lo, hi, n_groups from leave-one-out values and a one-row excess; under three groups there is no interval."""
    se = F.sqrt((F.count("theta") - 1) * F.var_pop("theta"))
    out = left.agg(F.count("theta").alias("n_groups"), se.alias("se")).crossJoin(F.broadcast(point.select("excess")))  # one row
    half = F.when(F.col("n_groups") >= 3, z * F.col("se"))
    return out.select(F.col("excess").alias("point"), F.when(F.col("n_groups") >= 3, F.col("se")).alias("se"), (F.col("excess") - half).alias("lo"), (F.col("excess") + half).alias("hi"), "n_groups")
