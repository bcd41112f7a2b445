"""Typed verdicts: one row of numbers to one row of judgement, by rules tried in order.

A read is (verdict, reason, n_effective, degenerate, detail); detail holds the numbers as JSON. Rules are SQL conditions, so
a read is a projection on its one-row aggregate and costs no pass over data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = ("PASS", "FAIL", "GRID_LIMITED", "INCONCLUSIVE", "NOT_A_RESULT")


def read(name: str, numbers: DataFrame, rules: Sequence[tuple[str, str, str]], n: str, least: int = 1) -> DataFrame:
    """``rules``: (condition, verdict, reason); the first that holds decides, and too few units are no result."""
    for _, verdict, _ in rules:
        if verdict not in WORDS:
            raise ValueError(f"{verdict} is no verdict")
    few = F.coalesce(F.col(n), F.lit(0)) < least
    verdict, reason = F.when(few, "NOT_A_RESULT"), F.when(few, f"fewer than {least} units")
    for condition, word, why in rules:
        verdict, reason = verdict.when(F.expr(condition), word), reason.when(F.expr(condition), why)
    return numbers.select(
        F.lit(name).alias("read"),
        verdict.otherwise("INCONCLUSIVE").alias("verdict"),
        reason.otherwise("no rule applies").alias("reason"),
        F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n_effective"),
        few.alias("degenerate"),
    )


#: Rules by family: thresholds stand here, and nowhere else.
RULES = {
    "run_lengths": [("self_transitions > 0", "FAIL", "a run repeats the one before it"), ("median <= 3", "FAIL", "half of all runs last three frames or less"), ("median > 3", "PASS", "runs last")],
    "alphabet": [("top_share >= 0.4", "FAIL", "one symbol holds two fifths of all frames"), ("dead >= 0.1", "GRID_LIMITED", "a tenth of the symbols is unused"), ("top_share < 0.4", "PASS", "symbols are shared out")],
    "concentration": [("ratio >= 10", "PASS", "rates vary ten times what chance gives"), ("ratio < 10", "FAIL", "rates vary about as chance gives")],
    "envelope": [("p75 <= 3 and mass3 < 0.5", "PASS", "short runs are many but little of the mass"), ("p75 <= 3", "FAIL", "short runs hold the mass"), ("p75 > 3", "GRID_LIMITED", "runs are long")],
    "ladder": [("lo > 0", "PASS", "the richer model is better on held-out animals"), ("hi < 0", "FAIL", "the richer model is worse"), ("lo <= 0 and hi >= 0", "INCONCLUSIVE", "the interval spans zero")],
    "rank_relation": [("(lo > 0 or hi < 0) and abs(point) >= 0.1", "PASS", "a relation of size"), ("lo > 0 or hi < 0", "GRID_LIMITED", "a small relation"), ("lo <= 0 and hi >= 0", "FAIL", "no relation")],
    "agreement": [("f1 >= 0.5", "PASS", "raters agree"), ("f1 < 0.5", "FAIL", "raters disagree")],
    "recall": [("recall >= 0.9", "PASS", "candidates hold the neighbours"), ("recall < 0.9", "FAIL", "candidates miss neighbours")],
}
