"""Gates on a summary ("sloc > 1000, min-mi < 20"), and the overall assessment."""

from __future__ import annotations

import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of conditions, and the summary's columns.
METRICS = {"max-cyclomatic": "max_cyclomatic", "avg-cyclomatic": "avg_cyclomatic", "max-cognitive": "max_cognitive", "avg-cognitive": "avg_cognitive", "min-mi": "min_maintainability", "min-maintainability": "min_maintainability", "avg-mi": "avg_maintainability", "avg-maintainability": "avg_maintainability", "duplicated-pct": "duplicated_pct", "tokens": "tokens", "files": "files", "sloc": "sloc"}
COMPARISONS = {">=": operator.ge, "<=": operator.le, "==": lambda a, b: F.abs(a - b) < 2.220446049250313e-16, ">": operator.gt, "<": operator.lt}


def parsed(text: str) -> list[tuple[str, str, float]]:
    """(metric, comparison, number) of each condition; ValueError for one that can't be read."""
    out = []
    for part in filter(None, map(str.strip, text.split(","))):
        m = re.fullmatch(r"([a-z-]+)\s*(>=|<=|==|>|<)\s*(\S+)", part)
        try:
            key, sign, number = m[1], m[2], float(m[3])
        except (TypeError, ValueError):
            raise ValueError(f"condition {part!r} isn't metric, comparison and number") from None
        if key not in METRICS or not math.isfinite(number):
            raise ValueError(f"condition {part!r} has an unknown metric or number")
        out.append((key, sign, number))
    return out


def condition(key: str, sign: str, number: float) -> Column:
    return COMPARISONS[sign](F.col(METRICS[key]).cast("double"), F.lit(number))


def failed(summary: DataFrame, text: str) -> DataFrame:
    """failed: whether any condition holds for the one-row summary."""
    test = F.lit(False)
    for c in parsed(text):
        test = test | condition(*c)
    return summary.select(test.alias("failed"))


def assessed(summary: DataFrame, budget: int = 128_000) -> DataFrame:
    """fits_context, reasons and cleanup_worth from duplicated_pct, avg_maintainability, high_risks and tokens."""
    reasons = F.array_compact(F.array(F.when(F.col("duplicated_pct") > 15, F.lit("duplication")), F.when(F.col("avg_maintainability") < 20, F.lit("maintainability")), F.when(F.col("high_risks") >= 3, F.lit("risk"))))
    worth = F.when(F.size(reasons) >= 3, F.lit("high")).when(F.size(reasons) >= 1, F.lit("medium")).otherwise(F.lit("low"))
    return summary.select((F.col("tokens") <= budget).alias("fits_context"), worth.alias("cleanup_worth"), F.array_join(reasons, ",").alias("reasons"))
