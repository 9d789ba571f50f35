"""The catalogue of queries over the tables of a folder. SQL for them is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, complexity, lines, paths
from ..operators import churn, clone_groups, clones, context, findings, gates, graph, intervals, inventory, locate
from ..session import kept
from ..sources import tables as T

#: Frequent words of the documents, as markers to count.
MARKERS = ["the", "de", "und", "la", "stupid"]
WIDTH = 50

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def measured(spark: SparkSession, folder: str) -> DataFrame:
    return inventory.measured(T.document_files(spark, folder))


def with_history(spark: SparkSession, folder: str) -> DataFrame:
    return churn.with_churn(measured(spark, folder), churn.churn(T.commit_deltas(spark, folder)))


def slim(spark: SparkSession, folder: str) -> DataFrame:
    """path, language, bytes and line counts alone."""
    files = T.document_files(spark, folder)
    return files.select("path", "language", F.octet_length("content").cast("long").alias("bytes"), lines.token_estimate(F.col("content")).alias("tokens"), lines.line_stats(F.col("content")).alias("s")).select("path", "language", "bytes", "tokens", "s.*")


# Inventory, lines, classes, markers


@query
def inventory_totals(spark, folder):
    return inventory.totals(slim(spark, folder))


@query
def language_stats(spark, folder):
    return inventory.by_language(slim(spark, folder))


@query
def source_rollup_other(spark, folder):
    return inventory.with_other(inventory.by_language(slim(spark, folder)), F.col("language").isin("en", "de"))


@query
def line_metrics_plain(spark, folder):
    return slim(spark, folder).select("path", "loc", "sloc", "blank_lines")


@query
def comment_ratio(spark, folder):
    rows = T.page_files(spark, folder).select("path", lines.line_stats(F.col("content"), comments=True).alias("s")).select("path", "s.*")
    return rounded(rows.select("path", "loc", "sloc", "comment_lines", lines.comment_ratio(F.col("comment_lines"), F.col("sloc")).alias("comment_ratio")), "comment_ratio")


@query
def skip_hints(spark, folder):
    files = T.document_files(spark, folder).union(T.page_files(spark, folder))
    hint = F.coalesce(classify.skip_hint(F.col("path"), F.col("content")), F.lit("none"))
    return files.select("language", hint.alias("skip_hint")).groupBy("language", "skip_hint").agg(F.count("*").alias("files"))


@query
def skip_candidates_top(spark, folder):
    files = T.document_files(spark, folder).union(T.page_files(spark, folder))
    rows = files.select("path", classify.skip_hint(F.col("path"), F.col("content")).alias("skip_hint"), lines.token_estimate(F.col("content")).alias("tokens"))
    return inventory.top(rows.where("skip_hint is not null"), "tokens", 10, "skip_hint")


@query
def minified_predicate(spark, folder):
    return T.page_files(spark, folder).select("path", classify.looks_minified(F.col("content")).alias("minified"))


@query
def marker_counts(spark, folder):
    return inventory.markers(T.document_files(spark, folder), MARKERS)


@query
def marker_occurrence_ordinals(spark, folder):
    return inventory.marker_occurrences(T.document_files(spark, folder), MARKERS)


@query
def exact_dup_documents(spark, folder):
    return inventory.duplicates(T.document_files(spark, folder))


@query
def top_token_files(spark, folder):
    return inventory.top(slim(spark, folder), "tokens", 10, "language")


@query
def dir_rollup_depth1(spark, folder):
    return rounded(inventory.by_directory(measured(spark, folder), 1), "avg_cyclomatic", "avg_maintainability")


@query
def dir_rollup_depth2(spark, folder):
    return rounded(inventory.by_directory(measured(spark, folder), 2), "avg_cyclomatic", "avg_maintainability")


# Complexity


@query
def heuristic_cyclomatic(spark, folder):
    return T.page_files(spark, folder).select("path", complexity.heuristic_cyclomatic(F.col("content")).alias("cyclomatic"))


@query
def brace_nesting(spark, folder):
    files = T.document_files(spark, folder).union(T.page_files(spark, folder))
    return files.select("path", lines.max_brace_depth(F.col("content")).alias("max_depth"))


@query
def halstead_heuristic(spark, folder):
    rows = T.page_files(spark, folder).select("path", complexity.halstead_counts(F.col("content")).alias("h")).withColumn("x", complexity.halstead(F.col("h")))
    return rounded(rows.select("path", "h.*", "x.*"), "volume", "difficulty", "effort")


@query
def maintainability_index(spark, folder):
    return rounded(measured(spark, folder).select("path", "sloc", "cyclomatic", "volume", "maintainability"), "volume", "maintainability")


@query
def complexity_summary(spark, folder):
    return rounded(inventory.complexity_summary(measured(spark, folder), 20), "avg_cyclomatic", "avg_maintainability", "min_maintainability")


@query
def complexity_violations(spark, folder):
    return inventory.violations(measured(spark, folder), 2)


# Churn, risk, gates


@query
def churn_by_path(spark, folder):
    return churn.churn(T.commit_deltas(spark, folder))


@query
def churn_capped_recent(spark, folder):
    return churn.churn(churn.recent(T.commit_deltas(spark, folder), 500))


@query
def churn_delta_budget(spark, folder):
    rows = churn.within_budget(T.commit_deltas(spark, folder), per_commit=10, total=300)
    return rows.groupBy("author").agg(F.count("*").alias("deltas"), F.count_distinct("oid").alias("commits"))


@query
def hotspots(spark, folder):
    return churn.hotspots(with_history(spark, folder), 10)


@query
def risk_scores(spark, folder):
    return rounded(churn.risks(with_history(spark, folder)), "score")


@query
def top_risks(spark, folder):
    return rounded(churn.top_risks(churn.risks(with_history(spark, folder)), 10), "score")


def duplicated(spark: SparkSession, folder: str) -> DataFrame:
    """duplicated_pct, the share of tokens that a repeated window covers, and english_duplicated_pct, that in English files, in one row."""
    files = T.document_files(spark, folder)
    total = files.select("path", "language", clones.token_count(F.col("content")).alias("tokens"))
    rows = total.join(clones.coverage(clones.repeated(windows(spark, folder)), WIDTH), ["path", "language"], "left")
    share = lambda n, tokens: F.coalesce(F.try_divide(F.sum(n) * 100.0, F.sum(tokens)), F.lit(0.0))
    return rows.agg(share(F.col("n"), F.col("tokens")).alias("duplicated_pct"), share(english("n"), english("tokens")).alias("english_duplicated_pct"))


def english(name: str) -> Column:
    return F.when(F.col("language") == "en", F.col(name))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of all files in one row, and some of the English ones. It is written, so that what reads it twice runs it once."""
    files = with_history(spark, folder)
    own = [F.avg(english("maintainability")).alias("english_avg_maintainability"), F.min(english("maintainability")).alias("english_min_maintainability"), F.max(english("cyclomatic")).alias("english_max_cyclomatic")]
    row = files.agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("sloc").alias("sloc"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.avg("maintainability").alias("avg_maintainability"), F.min("maintainability").alias("min_maintainability"), F.count_if(complexity.risk_score(F.col("sloc"), F.col("cyclomatic"), F.col("commits")) >= 0.1).alias("high_risks"), *own, F.lit(1).alias("_"))
    return kept(row.join(duplicated(spark, folder).withColumn("_", F.lit(1)), "_").drop("_"), "summary")


@query
def assessment(spark, folder):
    return gates.assessed(summary(spark, folder))


@query
def fail_gate_eval(spark, folder):
    s = summary(spark, folder)
    some = {"size": "sloc > 100, files<5", "upkeep": "min-mi < 20,avg-cyclomatic>=30", "none": "tokens == 1"}
    out = None
    for name, text in some.items():
        row = gates.failed(s, text).select(F.lit(name).alias("gate"), "failed")
        out = row if out is None else out.union(row)
    return out


# Clones


def windows(spark: SparkSession, folder: str) -> DataFrame:
    return clones.windows(T.document_files(spark, folder), WIDTH)


@query
def exact_clone_windows(spark, folder):
    return clones.family_sizes(windows(spark, folder))


@query
def maximal_clone_regions(spark, folder):
    return clones.regions(clones.repeated(windows(spark, folder)), WIDTH)


@query
def clone_groups_ranked(spark, folder):
    """Regions by tokens, then path and start; the number of regions with the same first place is a family's size."""
    rows = clones.regions(clones.repeated(windows(spark, folder)), WIDTH).withColumn("tokens", F.col("end") - F.col("start"))
    grouped = rows.groupBy("first_path", "first_start", "tokens").agg((F.count("*") + 1).alias("copies"))
    return grouped.withColumn("impact", F.col("tokens") * (F.col("copies") - 1)).orderBy(F.desc("impact"), F.desc("tokens"), "first_path", "first_start").limit(20)


@query
def greedy_top_duplicates(spark, folder):
    return clones.top_blocks(clones.regions(clones.repeated(windows(spark, folder)), WIDTH), 10, 20)


@query
def dup_token_coverage(spark, folder):
    return clones.coverage(clones.repeated(windows(spark, folder)), WIDTH).withColumnRenamed("n", "duplicated_tokens")


@query
def dup_by_language(spark, folder):
    files = T.document_files(spark, folder)
    total = files.select("path", "language", clones.token_count(F.col("content")).alias("tokens"))
    rows = total.join(clones.coverage(clones.repeated(windows(spark, folder)), WIDTH), ["path", "language"], "left")
    out = rows.groupBy("language").agg(F.sum("tokens").alias("tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated_tokens"), F.count("n").alias("files_with_clones"))
    return rounded(out.withColumn("duplicated_pct", F.coalesce(F.try_divide(F.col("duplicated_tokens") * 100.0, F.col("tokens")), F.lit(0.0))), "duplicated_pct")


@query
def production_dup(spark, folder):
    """Repeated tokens outside of the first 100 tokens of each file, which stand for its test regions."""
    rows = clones.spans(clones.repeated(windows(spark, folder)), WIDTH).select("path", "b", "e")
    holes = T.document_files(spark, folder).select("path", F.lit(0).cast("long").alias("b"), F.lit(100).cast("long").alias("e"))
    return intervals.without(rows, holes, ["path"]).withColumnRenamed("n", "production_tokens")


@query
def type2_clone_families(spark, folder):
    return clones.renamed_families(clones.shape_windows(T.document_files(spark, folder), WIDTH))


@query
def rare_first_admission(spark, folder):
    return clones.admitted(clones.digested(T.document_files(spark, folder), WIDTH), 20_000)


@query
def bucket_predecessor_cap(spark, folder):
    sizes = clones.family_sizes(windows(spark, folder))
    return sizes.select("copies", F.col("windows").alias("buckets"), (F.col("windows") * clones.pair_count(F.col("copies"))).alias("pairs"))


@query
def bucket_predecessors(spark, folder):
    """Files of equal content against the 2 first and 3 latest of those before them."""
    buckets = T.document_files(spark, folder).select(F.md5("content").alias("hash"), "path", F.lit(0).alias("start")).where("hash is not null")
    return clones.predecessors(buckets, 2, 3).select("left_path", "right_path")


@query
def languages_with_clones(spark, folder):
    return clone_groups.with_signal(dup_by_language(spark, folder)).select("language", "duplicated_tokens")


# Graphs


@query
def fan_counts(spark, folder):
    return graph.fans(T.part_edges(spark, folder))


@query
def top_depended(spark, folder):
    return graph.top_nodes(graph.fans(T.part_edges(spark, folder)), "fan_in", 10)


@query
def graph_orphans(spark, folder):
    parts = T.table(spark, folder, "part").select(F.col("p_partkey").alias("node"))
    return graph.orphans(graph.fans(T.part_edges(spark, folder), parts))


def seed(spark: SparkSession, node: int) -> DataFrame:
    return spark.range(node, node + 1).toDF("node")


@query
def graph_focus_depth2(spark, folder):
    return graph.reached(T.part_edges(spark, folder), seed(spark, 1), 2)


@query
def impact_reverse_bfs(spark, folder):
    return graph.impact(T.part_edges(spark, folder), seed(spark, 7))


@query
def components(spark, folder):
    return graph.components(T.part_edges(spark, folder))


@query
def scc_cycles(spark, folder):
    return graph.cycles(T.event_edges(spark, folder))


@query
def graph_projection(spark, folder):
    near = graph.reached(T.part_edges(spark, folder), seed(spark, 1), 1)
    return graph.projected(T.part_edges(spark, folder), near)


@query
def symbol_edges_resolved(spark, folder):
    """Customers' nations to suppliers' nations, by the best order status that links them."""
    line = T.table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders = T.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer, supplier = T.table(spark, folder, "customer").select("c_custkey", "c_nationkey"), T.table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return graph.resolved(rows.select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"), F.lit("orders").alias("relation"), F.col("o_orderstatus").alias("resolver"), rank.alias("rank")))


@query
def import_roots_distinct(spark, folder):
    """Targets that pages link to, each once for a page, in the order of first use."""
    hosts = F.array_distinct(F.regexp_extract_all("html", F.lit(r"href=\"/([A-Za-z]+)"), F.lit(1)))
    return T.table(spark, folder, "pages").select("page_id", F.posexplode(hosts).alias("ord", "root")).withColumn("ord", F.col("ord").cast("long"))


# Findings and reviews


def catalog(spark: SparkSession, folder: str, threshold: int = 2, risk: float = 0.05) -> DataFrame:
    files = with_history(spark, folder)
    marks = inventory.marker_occurrences(T.document_files(spark, folder), ["stupid", "idiot"])
    copies = clones.regions(clones.repeated(windows(spark, folder)), WIDTH).select("path", "start", "end").distinct()
    return findings.catalog(files, marks, churn.risks(files), copies, threshold, risk)


@query
def findings_catalog(spark, folder):
    return rounded(catalog(spark, folder).select("fingerprint", "kind", "path", "severity", "start_line", "end_line", "score"), "score")


@query
def findings_compare(spark, folder):
    """The catalogue of risks with all commits against that with the first half of the events."""
    files, deltas = measured(spark, folder), T.commit_deltas(spark, folder)
    middle = deltas.agg(F.percentile("oid", 0.5).alias("m"))
    old = deltas.join(F.broadcast(middle), F.col("oid") <= F.col("m")).drop("m")
    risk = lambda d: churn.risks(churn.with_churn(files, churn.churn(d)))
    make = lambda d: findings.catalog(risks=risk(d), risk_threshold=0.05)
    return findings.compare(make(old), make(deltas)).select("path", "state")


@query
def rename_remap(spark, folder):
    """Findings after files of src0 have moved to core; churn follows the new names."""
    files = T.document_files(spark, folder).where(F.startswith("path", F.lit("src0/")))
    renames = files.select(F.col("path").alias("old_path"), F.regexp_replace("path", "^src0/", "core/").alias("new_path"))
    found = findings.catalog(inventory.measured(T.document_files(spark, folder)), max_complexity=2)
    return findings.remapped(found, renames).select("fingerprint", "path", "kind")


def changed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines of an order stand for changed lines of a file."""
    rows = T.table(spark, folder, "lineitem").where(F.col("l_returnflag") == "R")
    return rows.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("long").alias("line"))


@query
def merge_changed_lines(spark, folder):
    return context.merged_lines(changed_lines(spark, folder))


@query
def review_changed_ranges(spark, folder):
    """Lines of large quantity that lie in or next to a changed range of their order."""
    changed = context.merged_lines(changed_lines(spark, folder)).withColumnsRenamed({"start": "b", "end": "e"})
    rows = T.table(spark, folder, "lineitem").where(F.col("l_quantity") >= 45)
    found = rows.select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").alias("part"), (F.col("l_linenumber") - 1).cast("long").alias("start_line"), (F.col("l_linenumber") + 1).cast("long").alias("end_line"))
    return findings.touched(found, changed)


@query
def interval_union(spark, folder):
    """Union of the intervals [line number, line number + quantity] of each order, neighbours merged."""
    rows = T.table(spark, folder, "lineitem").select(F.col("l_orderkey"), F.col("l_linenumber").cast("long").alias("b"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("e"))
    return intervals.union(rows, ["l_orderkey"], closed=True)


@query
def baseline_delta(spark, folder):
    now = summary(spark, folder)
    own = [c for c in now.columns if c.startswith("english_")]
    before = now.select(*(F.col(c).alias(c.removeprefix("english_")) for c in own))
    return rounded(findings.baseline_delta(before, now), "before", "after")


# Look-up, reading plans


@query
def symbol_locate_ranked(spark, folder):
    parts = T.table(spark, folder, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("kind"), F.col("p_partkey").cast("string").alias("path"))
    return locate.located(parts, "widget", 20)


@query
def explain_one(spark, folder):
    files = with_history(spark, folder).where(F.col("doc_id") == 1)
    risk = churn.risks(files).select("path", "score")
    hint = classify.skip_hint(F.col("path"), F.col("content"))
    rows = files.select("path", "language", "tokens", "sloc", "commits", F.coalesce(hint, F.lit("none")).alias("skip_hint"), paths.is_test_file(F.col("path")).alias("test"), paths.is_entrypoint(F.col("path")).alias("entrypoint"))
    return rounded(rows.join(risk, "path", "left"), "score")


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Source paths from documents, and a test path for each English one."""
    docs = T.table(spark, folder, "documents").select("doc_id", "source", "lang")
    name = F.concat(F.lit("m"), F.col("doc_id").cast("string"))
    source = docs.select(F.concat_ws("/", "source", F.lit("src"), F.concat(name, F.lit(".py"))).alias("path"), "lang")
    test = docs.where("lang = 'en'").select(F.concat_ws("/", "source", F.lit("tests"), F.concat(F.lit("test_"), name, F.lit(".py"))).alias("path"), "lang")
    return source.union(test)


@query
def matching_tests(spark, folder):
    files = page_paths(spark, folder)
    return context.matching_tests(files, files.where("not contains(path, '/tests/')"))


@query
def gap_classification(spark, folder):
    files = T.document_files(spark, folder).select("path", "language")
    by = lambda name: files.where(F.col("language") == name).select("path")
    history = T.commit_deltas(spark, folder).select("path")
    return context.gaps(files.select("path"), history, by("de"), by("fr")).groupBy("class").agg(F.count("*").alias("files"))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    files = with_history(spark, folder)
    risk = complexity.risk_score(F.col("sloc"), F.col("cyclomatic"), F.col("commits"))
    return context.scored(files.select("path", "tokens", "cyclomatic", "commits", risk.alias("risk")), T.commit_deltas(spark, folder).where("author = 'purchase'").select("path"))


@query
def context_scores(spark, folder):
    return candidates(spark, folder).select("path", "score")


@query
def context_selection(spark, folder):
    return context.selected(candidates(spark, folder), 32_000, 25)


@query
def reading_relations(spark, folder):
    """Files that relate to changed English sources: their tests, and what lies in their folders."""
    files = page_paths(spark, folder)
    seeds = context.planning_seeds(files, [], files.where("lang = 'en' and not contains(path, '/tests/')"))
    return context.relations(files, seeds).where("score > 0")


@query
def governing_configs(spark, folder):
    """How many files each configuration governs, if each source has a package and each of its languages a configuration."""
    files = T.document_files(spark, folder).select("path")
    top = F.substring_index("path", "/", 1)
    two = F.substring_index("path", "/", 2)
    configs = files.select(F.explode(F.array(F.concat(top, F.lit("/package.json")), F.concat(two, F.lit("/tsconfig.json")), F.concat(two, F.lit("/notes.txt")))).alias("path")).distinct()
    return context.governed(files, configs).groupBy("config").agg(F.count("*").alias("files"))


@query
def work_scope_budget(spark, folder):
    """The first 25 files over three sections: touched by commits, German, then all the rest."""
    files = T.document_files(spark, folder).select("path", "language", "doc_id")
    one = T.commit_deltas(spark, folder).groupBy("path").agg(F.min("oid").alias("ord")).select(F.lit(1).alias("section"), "ord", "path")
    two = files.where("language = 'de'").select(F.lit(2).alias("section"), F.col("doc_id").alias("ord"), "path")
    return context.shared_budget(one.union(two).union(files.select(F.lit(3), "doc_id", "path")), 25)


@query
def change_summary_budget(spark, folder):
    """How many of a shared budget of 100 paths each section of a change summary gets."""
    files = T.document_files(spark, folder).select("path", "language", "doc_id")
    order = {"fr": 1, "es": 2, "de": 3, "en": 4}
    section = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in order.items() for x in p)), F.col("language")), F.lit(5))
    return context.shared_budget(files.select(section.alias("section"), F.col("doc_id").alias("ord"), "path"), 100).groupBy("section").agg(F.count("*").alias("files"))


@query
def event_sequence_ranks(spark, folder):
    """Events of each user in order, with the running sum of value."""
    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = T.table(spark, folder, "events").select("event_id", "user_id", "ts", "value")
    return rows.select("event_id", F.row_number().over(line).cast("long").alias("ordinal"), F.round(F.sum("value").over(line.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


