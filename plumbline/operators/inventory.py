"""Measures of files, and their sums by language, directory and rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, complexity, lines, paths


def measured(files: DataFrame, comments: bool = False) -> DataFrame:
    """files with bytes, tokens (an estimate), line counts, heuristic complexity and maintainability, in one narrow pass.

    Operands and what stands between them are cut out once; tokens, branches and counts are read from those.
    """
    content = F.col("content")
    out = files.withColumns({"bytes": F.octet_length("content").cast("long"), "stats": lines.line_stats(content, comments), "operands": complexity.operands(content), "rest": complexity.rest(content)})
    out = out.withColumn("operators", complexity.operators(F.col("rest")))
    other = F.length(F.replace("rest", F.lit(" "), F.lit("")))
    out = out.select(*files.columns, "bytes", (F.size("operands") + other).cast("long").alias("tokens"), "stats", complexity.branches(F.col("operands"), F.col("rest")).alias("cyclomatic"), complexity.counts(F.col("operands"), F.col("operators")).alias("counts"))
    out = out.withColumn("halstead", complexity.halstead(F.col("counts")))
    mi = complexity.maintainability_index(F.col("halstead.volume"), F.col("cyclomatic"), F.col("stats.sloc"))
    return out.select(*files.columns, "bytes", "tokens", "stats.*", "cyclomatic", "counts.*", "halstead.*", mi.alias("maintainability"))


def totals(files: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("bytes", "loc", "sloc", "blank_lines")]
    return files.agg(F.count("*").alias("files"), *sums)


def by_language(files: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("bytes", "tokens", "loc", "sloc")]
    return files.groupBy("language").agg(F.count("*").alias("files"), *sums).orderBy(F.desc("sloc"), F.desc("tokens"), "language")


def with_other(languages: DataFrame, source: Column) -> DataFrame:
    """Languages that aren't source collapsed into one row that counts them."""
    name = F.when(source, F.col("language")).otherwise(F.lit("Other content"))
    sums = [F.sum(c).alias(c) for c in ("files", "bytes", "tokens", "loc", "sloc")]
    return languages.groupBy(name.alias("language")).agg(F.count("*").alias("formats"), *sums)


def by_directory(files: DataFrame, depth: int) -> DataFrame:
    """Sums by directory, complexity by file on average, largest first."""
    grouped = files.groupBy(paths.dir_bucket(F.col("path"), depth).alias("directory"))
    out = grouped.agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("sloc").alias("sloc"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.avg("maintainability").alias("avg_maintainability"))
    return out.orderBy(F.desc("tokens"), "directory")


def _complexity(threshold: int) -> list[Column]:
    return [
        F.coalesce(F.avg("cyclomatic"), F.lit(0.0)).alias("avg_cyclomatic"),
        F.coalesce(F.max("cyclomatic"), F.lit(0)).alias("max_cyclomatic"),
        F.count_if(F.col("cyclomatic") > threshold).alias("over_threshold"),
        F.coalesce(F.avg("maintainability"), F.lit(0.0)).alias("avg_maintainability"),
        F.coalesce(F.min("maintainability"), F.lit(0.0)).alias("min_maintainability"),
    ]


def complexity_summary(files: DataFrame, threshold: int) -> DataFrame:
    return files.agg(*_complexity(threshold))


def summary(files: DataFrame, threshold: int) -> DataFrame:
    """All totals of measured files in one row; empty sums are 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "tokens", "loc", "sloc", "comment_lines", "blank_lines", "commits")]
    return files.agg(F.count("*").alias("files"), *sums, *_complexity(threshold))


def violations(files: DataFrame, threshold: int) -> DataFrame:
    """Files above the threshold, which itself is fine."""
    return files.where(F.col("cyclomatic") > threshold).select("path", "cyclomatic")


def top(rows: DataFrame, by: str, n: int, *columns: str) -> DataFrame:
    """The n largest by a measure, by path on ties."""
    return rows.orderBy(F.desc(by), "path").limit(n).select("path", by, *columns)


def hinted(files: DataFrame) -> DataFrame:
    return files.withColumn("skip_hint", classify.skip_hint(F.col("path"), F.col("content")))


def markers(files: DataFrame, names: list[str]) -> DataFrame:
    """path, marker and n for each marker that a file has."""
    counts = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(lines.marker_count(F.col("content"), m) for m in names)))
    return files.select("path", F.explode(counts).alias("marker", "n")).where("n > 0")


def marker_occurrences(files: DataFrame, names: list[str]) -> DataFrame:
    """path, marker, line, context_hash, hits and ordinal: lines with a marker, numbered among equal lines of a file.

    context_hash is of the line with its white space collapsed, so that an occurrence keeps its identity as lines move.
    """
    from pyspark.sql import Window

    rows = files.select("path", F.posexplode(lines.lines(F.col("content"))).alias("line", "s")).withColumn("line", (F.col("line") + 1).cast("long"))
    counts = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(lines.marker_count(F.col("s"), m) for m in names)))
    rows = rows.select("path", "line", F.md5(F.trim(F.regexp_replace("s", r"\s+", " "))).alias("context_hash"), F.explode(counts).alias("marker", "hits")).where("hits > 0")
    same = Window.partitionBy("path", "marker", "context_hash").orderBy("line")
    return rows.withColumn("ordinal", F.row_number().over(same).cast("long"))


def duplicates(files: DataFrame) -> DataFrame:
    """Files with the same content: content hash, copies, the first path, and bytes that copies waste."""
    grouped = files.groupBy(F.sha2("content", 256).alias("content_hash"))
    rows = grouped.agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max(F.octet_length("content")).cast("long").alias("bytes"))
    return rows.where("copies > 1").withColumn("wasted_bytes", F.col("bytes") * (F.col("copies") - 1))
