"""Groups of clones after the search: overlaps pruned, repeated and contained groups dropped, short ones left out, findings.

A group is a set of instances: rows (family, path, b, e, start_line, end_line, end_column), the lines where they are known.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def last_line(start_line: Column, end_line: Column, end_column: Column, b: Column, e: Column) -> Column:
    """The last line that an instance occupies: one that ends before the first column of a line ends on the line before."""
    return F.when((end_column == 1) & (end_line > start_line) & (e > b), end_line - 1).otherwise(end_line)


def pruned(instances: DataFrame) -> DataFrame:
    """Instances without those that overlap a kept one of their family and file, the widest first, then the first; families of
    one instance go. A family's instances in one file meet in one group."""

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        rows = []
        for k, b, e in sorted(zip(range(len(group)), group["b"], group["e"], strict=True), key=lambda x: (x[1] - x[2], x[1])):
            if all(e <= x or y <= b for x, y in taken):
                taken.append((b, e))
                rows.append(k)
        return group.iloc[sorted(rows)]

    out = instances.groupBy("family", "path").applyInPandas(kept, instances.schema)
    many = out.groupBy("family").agg(F.count("*").alias("n")).where("n > 1").select("family")
    return out.join(many, "family", "left_semi")


def signatures(instances: DataFrame) -> DataFrame:
    """family, copies, tokens (of the widest), regions and paths: hashes of the sets of regions and of the files with their
    copies. They are sums of hashes, so that no group is gathered in a row; two sums of 64 bits tell sets apart."""
    total = lambda seed, *c: F.sum(F.xxhash64(F.lit(seed), *c).cast("decimal(38,0)"))
    return instances.groupBy("family").agg(
        F.count("*").alias("copies"),
        F.max(F.col("e") - F.col("b")).alias("tokens"),
        F.concat_ws(":", total(1, "path", "b", "e"), total(2, "path", "b", "e")).alias("regions"),
        F.concat_ws(":", total(3, "path"), total(4, "path")).alias("paths"),
    )


def distinct_groups(instances: DataFrame) -> DataFrame:
    """Instances of one family, the first by name, of those with the same regions."""
    first = signatures(instances).groupBy("copies", "regions").agg(F.min("family").alias("family"))
    return instances.join(first.select("family"), "family", "left_semi")


def without_contained(instances: DataFrame) -> DataFrame:
    """Instances without families of which each instance lies in another one of a wider family with the same files and copies.

    Families are compared only where they share files and copies, by containment of the first instance in each file.
    """
    marks = signatures(instances).select("family", "copies", "tokens", "paths")
    rows = instances.join(marks, "family")
    small, wide = rows.alias("s"), rows.alias("w")
    inside = (F.col("s.paths") == F.col("w.paths")) & (F.col("s.copies") == F.col("w.copies")) & (F.col("s.path") == F.col("w.path")) & (F.col("s.tokens") < F.col("w.tokens"))
    pairs = small.join(wide, inside & (F.col("w.b") <= F.col("s.b")) & (F.col("s.e") <= F.col("w.e")))
    pairs = pairs.groupBy(F.col("s.family").alias("family"), F.col("w.family").alias("wide"), F.col("s.copies").alias("copies"))
    held = pairs.agg(F.count_distinct("s.path", "s.b", "s.e").alias("n"), F.count_distinct("w.path", "w.b", "w.e").alias("m")).where("n = copies and m = copies")
    return instances.join(held.select("family").distinct(), "family", "left_anti")


def long_enough(instances: DataFrame, lines: int) -> DataFrame:
    """Instances of families whose longest one has `lines` lines or more."""
    if lines <= 1:
        return instances
    some = instances.groupBy("family").agg(F.max(F.col("end_line") - F.col("start_line") + 1).alias("n")).where(F.col("n") >= lines)
    return instances.join(some.select("family"), "family", "left_semi")


def pair_id(kind: Column, language: Column, a: Column, b: Column) -> Column:
    """A stable name of a pair of instances (structs of path, b, e) that doesn't depend on their order."""
    text = lambda x: F.concat_ws(":", x["path"], x["b"].cast("string"), x["e"].cast("string"))
    return F.sha2(F.concat_ws("|", kind, language, F.least(text(a), text(b)), F.greatest(text(a), text(b))), 256)


def family_fingerprint(kind: Column, language: Column, content: Column) -> Column:
    """A family's name by its content, which stays as files are renamed; content: a hash of its tokens."""
    return F.sha2(F.concat_ws("|", kind, language, content.cast("string")), 256)


def findings(pairs: DataFrame) -> DataFrame:
    """Findings of pairs (kind, language, a, b, similarity): id, kind and confidence, high for exact and near ones of 0.9 and more."""
    confidence = F.when((F.col("kind") == "exact") | (F.col("similarity") >= 0.9), F.lit("high")).otherwise(F.lit("medium"))
    return pairs.select(pair_id(F.col("kind"), F.col("language"), F.col("a"), F.col("b")).alias("id"), "kind", "language", "a", "b", "similarity", confidence.alias("confidence"))


def beyond_exact(near: DataFrame, exact: DataFrame) -> DataFrame:
    """Near pairs (a, b) whose regions no exact pair has."""
    key = lambda df: df.withColumn("_pair", pair_id(F.lit(""), F.lit(""), F.col("a"), F.col("b")))
    return key(near).join(key(exact).select("_pair"), "_pair", "left_anti").drop("_pair")


def apart(matches: DataFrame, budget: int) -> DataFrame:
    """Matches (file_a, file_b, a, b, tokens, lines, similarity) without those that overlap a better one of their pair of files on
    both sides: the longest first, then more lines, the most similar, and by place. Up to `budget` comparisons a pair of files;
    matches that it doesn't reach stay, with checked false. One pair of files is one group."""
    schema = StructType([*matches.schema.fields, StructField("checked", BooleanType())])

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        rows, checks, flags = [], 0, []
        group = group.sort_values(["tokens", "lines", "similarity", "a", "b"], ascending=[False, False, False, True, True])
        for r in group.itertuples():
            if checks + len(rows) > budget:
                rows.append(r)
                flags.append(False)
                continue
            checks += len(rows)
            if not any(r.a < x.a + x.tokens and x.a < r.a + r.tokens and r.b < x.b + x.tokens and x.b < r.b + r.tokens for x in rows):
                rows.append(r)
                flags.append(True)
        out = group.loc[[r.Index for r in rows]]
        return out.assign(checked=flags)

    return matches.groupBy("file_a", "file_b").applyInPandas(kept, schema)


def with_signal(languages: DataFrame) -> DataFrame:
    """Rows of languages of which any measure isn't zero."""
    measures = [c for c, t in languages.dtypes if c.startswith(("duplicated", "exact", "near")) and t != "string"]
    test = F.lit(False)
    for c in measures:
        test = test | (F.col(c) > 0)
    return languages.where(test)

