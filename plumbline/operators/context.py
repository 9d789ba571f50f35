"""Which files to read first: scores, and greedy selection under budgets of tokens and files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

#: Weights of the score.
WEIGHTS = {"focus": 1200.0, "changed": 1100.0, "dependency": 600.0, "dependent": 550.0, "test": 500.0, "transitive": 425.0, "entrypoint": 300.0, "nearby": 250.0, "near_change": 75.0}
#: Fixed values: (most, factor) of degrees, commits and complexity, and from where on the last two count.
SIGNALS = {"fan_in": (20.0, 18), "fan_out": (20.0, 5), "commits": (20.0, 4), "cyclomatic": (100.0, 1.5)}
BUSY, COMPLEX, RISK, ELEVATED = 5, 10, 200, 0.4


def scored(files: DataFrame, changed: DataFrame | None = None, reach: DataFrame | None = None) -> DataFrame:
    """files with score: relation to the changed files, then degrees, risk, history and complexity.

    files: path, tokens, fan_in, fan_out, risk, commits, cyclomatic. changed: path. reach: path, distance from a changed
    file against the edges. Missing columns count as zero.
    """
    have = set(files.columns)
    c = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)
    score = F.when(paths.is_entrypoint(F.col("path")), WEIGHTS["entrypoint"]).otherwise(0.0)
    signal = lambda name: F.least(c(name), F.lit(SIGNALS[name][0])) * SIGNALS[name][1]
    score = score + signal("fan_in") + signal("fan_out") + c("risk") * RISK
    score = score + F.when(c("commits") >= BUSY, signal("commits")).otherwise(0.0)
    score = score + F.when(c("cyclomatic") >= COMPLEX, signal("cyclomatic")).otherwise(0.0)
    if changed is not None:
        files = files.join(changed.select("path", F.lit(True).alias("_changed")).distinct(), "path", "left")
        score = score + F.when(F.col("_changed"), WEIGHTS["changed"]).otherwise(0.0)
    if reach is not None:
        files = files.join(reach.groupBy("path").agg(F.min("distance").alias("_distance")), "path", "left")
        score = score + F.when(F.col("_distance") == 1, WEIGHTS["dependent"]).when(F.col("_distance") > 1, WEIGHTS["transitive"] / F.col("_distance")).otherwise(0.0)
    return files.withColumn("score", F.round(score, 2)).drop("_changed", "_distance")


def planning_seeds(files: DataFrame, focus: list[str], changed: DataFrame | None = None) -> DataFrame:
    """path and kind (focus, changed) of the files that a plan starts from; focus: files or folders. A file may be both."""
    test = F.lit(False)
    for f in focus:
        test = test | (F.col("path") == f) | F.startswith("path", F.lit(f.rstrip("/") + "/"))
    out = files.where(test).select("path", F.lit("focus").alias("kind"))
    if changed is not None:
        out = out.union(files.join(changed.select("path"), "path", "left_semi").select("path", F.lit("changed")))
    return out.distinct()


def relations(files: DataFrame, seeds: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """path and score of each file's relation to the seeds (path, kind): focus itself, direct dependencies of a seed, tests that
    match one, and files of a seed's folder. files: path, and risk where it is known. dependencies: source, target.

    A file near a change counts less, unless its risk is elevated.
    """
    changes = not seeds.where("kind = 'changed'").isEmpty()
    one = seeds.groupBy("path").agg(F.max(F.col("kind") == "focus").alias("focus"))
    tests = matching_tests(files.select("path"), one.select("path")).select(F.col("test").alias("path"), F.lit(True).alias("matching")).distinct()
    folders = one.select(paths.parent(F.col("path")).alias("folder"), F.lit(True).alias("nearby")).distinct()
    risk = F.coalesce(F.col("risk"), F.lit(0.0)) if "risk" in files.columns else F.lit(0.0)
    rows = files.select("path", risk.alias("risk"), paths.parent(F.col("path")).alias("folder")).join(one, "path", "left").join(tests, "path", "left").join(folders, "folder", "left")
    near = F.when(F.col("risk") >= ELEVATED, WEIGHTS["nearby"]).otherwise(WEIGHTS["near_change"] if changes else WEIGHTS["nearby"])
    score = F.when(F.col("focus"), WEIGHTS["focus"]).otherwise(0.0) + F.when(F.col("matching"), WEIGHTS["test"]).otherwise(0.0)
    score = score + F.when(F.col("nearby") & F.col("focus").isNull(), near).otherwise(0.0)
    if dependencies is not None:
        direct = dependencies.join(one.select(F.col("path").alias("source")), "source", "left_semi").select(F.col("target").alias("path"), F.lit(True).alias("needed")).distinct()
        rows = rows.join(direct, "path", "left")
        score = score + F.when(F.col("needed"), WEIGHTS["dependency"]).otherwise(0.0)
    return rows.select("path", score.alias("score"))


def merged_reading(entries: DataFrame, tests: DataFrame) -> DataFrame:
    """path, ord and roles: reading entries (ord, path, role) once each at their first place, and tests (path) after them."""
    after = tests.select(F.lit(None).cast("long").alias("ord"), "path", F.lit("matching-test").alias("role"))
    rows = entries.select(F.col("ord").cast("long"), "path", "role").union(after)
    return rows.groupBy("path").agg(F.min("ord").alias("ord"), F.array_sort(F.collect_set("role")).alias("roles"))


def confidence(facts: DataFrame) -> DataFrame:
    """facts with confidence and reasons of a change summary, from observed and discovery (high, partial, none), test_mapping,
    graph_eligible, graph_covered, relevant_gaps, outside_gaps and truncated."""
    covered, eligible = F.col("graph_covered"), F.col("graph_eligible")
    graph = F.when(eligible == 0, "no-graph-eligible-changes").when(covered == 0, "no-graph-covered-changes").when(covered < eligible, "changed-graph-coverage-incomplete")
    tests = F.when(F.col("test_mapping") == "partial", "test-mapping-heuristic").when(F.col("test_mapping") == "none", "no-matching-tests")
    reasons = F.array_compact(F.array(graph, F.when(F.col("relevant_gaps") > 0, "relevant-graph-gaps"), F.when(F.col("outside_gaps") > 0, "repository-graph-gaps"), F.when(F.col("truncated"), "scan-truncated"), tests))
    level = F.when(covered == 0, "none").when((F.col("observed") == "high") & (F.col("discovery") == "high"), "high").otherwise("partial")
    return facts.withColumns({"confidence": level, "reasons": reasons})


def governed(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(path, config) of the configurations in a file's folder and those above; an equi-join on the folders above each path."""
    own = configs.where(paths.is_project_configuration(F.col("path"))).select(paths.parent(F.col("path")).alias("folder"), F.col("path").alias("config"))
    return files.select("path", F.explode(paths.folders_above(F.col("path"))).alias("folder")).join(own, "folder").select("path", "config")


def selected(candidates: DataFrame, tokens: int, files: int) -> DataFrame:
    """candidates with rank and reason, null for those selected: by score, then fewer tokens, then path, each that still fits.

    The choice is sequential, as a file that doesn't fit is skipped and smaller ones may follow; one task walks over
    (path, tokens, score) rows in order, with two sums as its state. Every file stays in the result.
    """

    def walk(batches: Iterator) -> Iterator:
        used = count = rank = 0
        for batch in batches:
            ranks, reasons = [], []
            for size in batch["tokens"]:
                rank += 1
                reason = "file limit" if count >= files else "over the budget" if size > tokens else "does not fit" if used + size > tokens else None
                if reason is None:
                    used, count = used + int(size), count + 1
                ranks.append(rank)
                reasons.append(reason)
            yield batch.assign(rank=ranks, reason=reasons)

    rows = candidates.select("path", F.col("tokens").cast("long"), F.col("score").cast("double")).repartition(1).sortWithinPartitions(F.desc("score"), "tokens", "path")
    return rows.mapInPandas(walk, "path string, tokens long, score double, rank long, reason string")


def shared_budget(sections: DataFrame, budget: int) -> DataFrame:
    """The first `budget` distinct paths over sections in order: (section, ord, path), a path in its first section only."""
    first = sections.groupBy("path").agg(F.min(F.struct("section", "ord")).alias("at"))
    return first.select("path", "at.section", "at.ord").orderBy("section", "ord", "path").limit(budget)


def matching_tests(files: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, test): test files that share a stem with a changed source."""
    tests = files.where(paths.is_test_file(F.col("path"))).select(F.col("path").alias("test"), F.explode(paths.test_stem_keys(F.col("path"))).alias("key"))
    sources = changed.where(~paths.is_test_file(F.col("path"))).select("path", paths.stem_key(F.col("path")).alias("key"))
    return sources.join(tests, "key").select("path", "test").distinct()


def gaps(facts: DataFrame, changed: DataFrame, impacted: DataFrame, chosen: DataFrame) -> DataFrame:
    """facts (path) with the first class that holds: changed, impacted, selected, outside."""
    out = facts
    for name, some in (("_c", changed), ("_i", impacted), ("_s", chosen)):
        out = out.join(some.select("path", F.lit(True).alias(name)).distinct(), "path", "left")
    kind = F.when(F.col("_c"), "changed").when(F.col("_i"), "impacted").when(F.col("_s"), "selected").otherwise("outside")
    return out.withColumn("class", kind).drop("_c", "_i", "_s")


def merged_lines(lines: DataFrame) -> DataFrame:
    """(path, start, end): runs of consecutive changed lines (path, line)."""
    rows = lines.select("path", "line").distinct()
    island = F.col("line") - F.row_number().over(Window.partitionBy("path").orderBy("line"))
    return rows.withColumn("island", island).groupBy("path", "island").agg(F.min("line").alias("start"), F.max("line").alias("end")).drop("island")
