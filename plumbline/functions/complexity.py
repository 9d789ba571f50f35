"""Complexity measures: Column builders for the heuristic ones, and the equations that all languages share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and operators that each add a branch.
BRANCH_WORDS = ("if", "for", "while", "case", "catch", "elif", "when", "and", "or")
BRANCH_SIGNS = (r"&&", r"\|\|", r"\?")
OPERAND = r"[A-Za-z0-9_]+"
OPERATOR = r"&&|\|\||[=!<>+\-*/%:]=|[-=]>|::|[^\sA-Za-z0-9_]"


def heuristic_cyclomatic(content: Column) -> Column:
    words = r"(?<![A-Za-z0-9_])(?:" + "|".join(BRANCH_WORDS) + r")(?![A-Za-z0-9_])"
    out = F.lit(1) + F.regexp_count(content, F.lit(words))
    for sign in BRANCH_SIGNS:
        out = out + F.regexp_count(content, F.lit(sign))
    return out.cast("long")


def operands(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(OPERAND), F.lit(0))


def rest(content: Column) -> Column:
    """A text with a space in place of each run of operands and white space, so that what is left holds operators only."""
    return F.regexp_replace(content, r"[A-Za-z0-9_\s]+", " ")


def operators(rest: Column) -> Column:
    return F.regexp_extract_all(rest, F.lit(OPERATOR), F.lit(0))


def branches(operands: Column, rest: Column) -> Column:
    """heuristic_cyclomatic() of a text of which operands and rest are known: a branch word stands alone where it is an operand."""
    out = F.lit(1) + F.size(F.filter(operands, lambda x: x.isin(*BRANCH_WORDS)))
    for sign in ("&&", "||", "?"):
        out = out + F.floor((F.octet_length(rest) - F.octet_length(F.replace(rest, F.lit(sign), F.lit("")))) / len(sign)).cast("int")
    return out.cast("long")


def counts(operands: Column, operators: Column) -> Column:
    """Distinct and total operators and operands."""
    parts = {"distinct_operators": F.size(F.array_distinct(operators)), "distinct_operands": F.size(F.array_distinct(operands)), "total_operators": F.size(operators), "total_operands": F.size(operands)}
    return F.struct(*(v.cast("long").alias(k) for k, v in parts.items()))


def halstead_counts(content: Column) -> Column:
    """Distinct and total operators and operands of the heuristic lexer: runs of ASCII word characters are operands, any
    other character or pair of the operator table an operator."""
    return counts(operands(content), operators(rest(content)))


def halstead(h: Column) -> Column:
    """vocabulary, length, volume, difficulty and effort from the four counts."""
    vocabulary, length = h["distinct_operators"] + h["distinct_operands"], h["total_operators"] + h["total_operands"]
    volume = F.when((vocabulary <= 1) | (length == 0), F.lit(0.0)).otherwise(length * F.log2(F.greatest(vocabulary, F.lit(1))))
    difficulty = (h["distinct_operators"] / 2.0) * (h["total_operands"] / F.greatest(h["distinct_operands"], F.lit(1)))
    return F.struct(vocabulary.alias("vocabulary"), length.alias("length"), volume.alias("volume"), difficulty.alias("difficulty"), (difficulty * volume).alias("effort"))


def maintainability_index(volume: Column, cyclomatic: Column, sloc: Column) -> Column:
    raw = 171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.ln(F.greatest(sloc, F.lit(1)).cast("double"))
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw) * 100.0 / 171.0)


def saturation(value: Column, half: float) -> Column:
    """value / (value + half): 0.5 at half."""
    return value / (value + F.lit(half))


def risk_score(sloc: Column, cyclomatic: Column, commits: Column) -> Column:
    return 0.4 * saturation(sloc, 1000.0) + 0.4 * saturation(cyclomatic, 100.0) + 0.2 * saturation(commits, 20.0)


def risk_reasons(sloc: Column, cyclomatic: Column, commits: Column) -> Column:
    """Names of the factors whose value is at least 0.66 of their anchor."""
    pairs = (("size", sloc, 1000), ("complexity", cyclomatic, 100), ("churn", commits, 20))
    return F.array_compact(F.array(*(F.when(v >= 0.66 * a, F.lit(name)) for name, v, a in pairs)))
