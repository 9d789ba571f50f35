"""Quality rules with risk-controlled thresholds.

A step is a rule with a cutoff: it rejects a text of which one measure is above the cutoff. Steps are put in an order by
stratum of length on one part of the labelled texts (the design fold): those that reject the fewest good texts for the
bad ones that they catch come first. The other part is the holdout. There the union of the first k steps rejects some of
the good texts, and an exact binomial test must refute that it rejects more than RISK of them; the walk over k = 1, 2, ...
stops at the first union that isn't refuted. As the order doesn't depend on the holdout, and unions are tested in that
order, a stratum needs no correction for its many steps; the level is divided by the number of strata (Bonferroni). So
with probability 1 - LEVEL, in every stratum all rules together reject no more than RISK of the good texts. Of the unions
admitted, the first that catches nearly all of the bad texts that the last one catches is used, and none where that is less
than USEFUL of them. Too few labels: no cutoff.

All of it is DataFrame operations; the driver gets a few rows of counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SPACES = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"
RISK, LEVEL, USEFUL, NEARLY, LIFT = 0.01, 0.05, 0.005, 0.98, 20
#: One fold of so many is the design fold, the others are the holdout.
FOLDS = 4
#: Upper bounds of the strata's n_words.
STRATA = (200, 600, 2000)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, the measures of MEASURES, and n_lines, n_marks (exclamation and question marks), n_capitals.

    Words are runs of other characters than \\x20 and \\x09-\\x0D. A null text has no words and counts as empty.
    n_repeat_words: words in three-word windows found twice or more in the text. Windows are first looked for by sorted
    64-bit hashes; where two are equal the windows themselves are sorted, so that the count is exact.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("trimmed", F.btrim("text", F.lit(BLANK)))
    words = F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACES))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.regexp_replace("text", SPACES, "")).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count("text", F.lit("[!?]")).alias("n_marks"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_capitals"),
    )
    window = lambda f: F.slice(F.transform("words", f), F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    following = lambda i, k: F.get("words", i + k)
    hashes = F.sort_array(window(lambda x, i: F.xxhash64(x, following(i, 1), following(i, 2))))
    rows = rows.withColumn("hashes", hashes)
    twice = F.exists(F.zip_with("hashes", F.slice("hashes", F.lit(2), F.greatest(F.size("hashes"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    sorted_ = F.array_sort(window(lambda x, i: F.struct(F.concat_ws(" ", x, following(i, 1), following(i, 2)).alias("s"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(twice, sorted_)).drop("hashes")
    pairs = F.zip_with("windows", F.slice("windows", F.lit(2), F.greatest(F.size("windows"), F.lit(1))), lambda a, b: F.when(a["s"] == b["s"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("places", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull())))))
    covered = F.zip_with("places", F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)),
        "n_lines": F.size("lines"),
        "n_marks": F.col("n_marks"),
        "n_capitals": F.col("n_capitals"),
    }
    return rows.select("doc_id", "text_hash", *(c.cast("long").alias(k) for k, c in counts.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k in range(len(STRATA) - 1, -1, -1):
        out = F.when(F.col("n_words") < STRATA[k], F.lit(k)).otherwise(out)
    return out


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rules() -> dict[str, tuple[Column, list[float]]]:
    """Measure and grid of cutoffs, the mildest first, of each rule."""
    share = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03]
    return {
        "symbols": (_ratio("n_symbols", "n_words"), [3.0, 2.0, 1.0, *share]),
        "marks": (_ratio("n_marks", "n_words"), [3.0, 2.0, 1.0, *share]),
        "capitals": (_ratio("n_capitals", "word_chars"), share),
        "repeats": (_ratio("n_repeat_words", "n_words"), share),
        "dup_lines": (_ratio("n_dup_lines", "n_lines"), share),
        "long_words": (_ratio("word_chars", "n_words"), [30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0]),
        "short_words": (-_ratio("word_chars", "n_words"), [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0]),
    }


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), by the continued fraction of the regularised incomplete beta function."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p  # P(X <= k) = I_{1-p}(n-k, k+1)
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return min(1.0, 1 - front * out if flip else front * out)


#: A step: a rule and its cutoff.
Step = tuple[str, float]


def ordered(good: int, bad: int, above: dict[Step, tuple[int, int]]) -> list[Step]:
    """Steps of LIFT and more, best first, from how many good and bad texts of the design fold are above each cutoff."""
    fit = {s: (g, b) for s, (g, b) in above.items() if b and b * good >= LIFT * g * bad}
    return sorted(fit, key=lambda s: ((fit[s][0] + 1) / (fit[s][1] + 1), s[0], -s[1]))


def admitted(good: int, bad: int, rejected: list[tuple[int, int]], risk: float, level: float) -> int:
    """How many steps to use, from how many good and bad texts of the holdout each step is the first to reject."""
    good_sum = bad_sum = 0
    caught = []
    for g, b in rejected:
        good_sum, bad_sum = good_sum + g, bad_sum + b
        if not good or binomial_at_most(good_sum, good, risk) > level:
            break
        caught.append(bad_sum)
    if not caught or caught[-1] < USEFUL * bad or not caught[-1]:
        return 0
    return 1 + next(k for k, c in enumerate(caught) if c >= NEARLY * caught[-1])


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> dict[int, dict[str, float]]:
    """Cutoffs of each rule by stratum. Copies of a text count once, as good if one of them is labelled so, and share a fold."""
    marks = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("good"))
    held = measures.where(~base_failed()).join(marks, "doc_id")
    held = held.groupBy("text_hash").agg(F.max("good").alias("good"), *(F.max(c).alias(c) for c in measures.columns if c not in ("doc_id", "text_hash")))
    held = written(held.withColumns({"stratum": stratum(), "fold": F.pmod(F.xxhash64("text_hash"), F.lit(FOLDS))}), "quality-labelled")
    grid = rules()
    steps = [(name, c) for name, (_, cs) in grid.items() for c in cs]
    over = lambda s: grid[s[0]][0] > s[1]
    above = [F.count_if(over(s)).alias(f"s{k}") for k, s in enumerate(steps)]
    design = {(r.stratum, r.good): r for r in held.where("fold = 0").groupBy("stratum", "good").agg(F.count("*").alias("n"), *above).collect()}
    orders = {}
    for n in range(len(STRATA) + 1):
        good, bad = design.get((n, 1)), design.get((n, 0))
        if good and bad:
            orders[n] = ordered(good["n"], bad["n"], {s: (good[f"s{k}"], bad[f"s{k}"]) for k, s in enumerate(steps)})
    first = F.lit(0)
    for n, order in orders.items():
        if order:
            first = F.when(F.col("stratum") == n, F.array_position(F.array(*map(over, order)), F.lit(True))).otherwise(first)
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in held.where("fold > 0").groupBy("stratum", "good", first.alias("first")).count().collect():
        counts.setdefault((r["stratum"], r["good"]), {})[r["first"]] = r["count"]
    out: dict[int, dict[str, float]] = {}
    for n, order in orders.items():
        good, bad = counts.get((n, 1), {}), counts.get((n, 0), {})
        rejected = [(good.get(k + 1, 0), bad.get(k + 1, 0)) for k in range(len(order))]
        for name, c in order[: admitted(sum(good.values()), sum(bad.values()), rejected, risk, level / (len(STRATA) + 1))]:
            own = out.setdefault(n, {})
            own[name] = min(c, own.get(name, c))
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """doc_id, the measures, base_failed, kept and rejected_by (the rules, joined by commas) for each row of docs.

    kept is false if base_failed, or a rule's measure is above the cutoff of the row's stratum. Other columns aren't
    read. Repeated rows are rows of their own. An empty table gives no rows, and empty labels reject nothing more.
    """
    measures = written(measured(docs), "quality-measures")
    chosen = cutoffs(measures, labels, risk, level)
    grid = rules()
    tests = [F.when((stratum() == s) & (grid[name][0] > c), F.lit(name)) for s, some in sorted(chosen.items()) for name, c in some.items()]
    by = F.concat_ws(",", *tests) if tests else F.lit("")
    return measures.select("doc_id", *MEASURES, base_failed().alias("base_failed"), (~base_failed() & (by == "")).alias("kept"), by.alias("rejected_by"))
