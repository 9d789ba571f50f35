"""Lines of a text, and what can be counted in them without a parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines(content: Column) -> Column:
    """The lines of a text without their ends; a final line feed starts no line, and an empty text has none."""
    body = F.regexp_replace(content, r"\n\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")))


def count_where(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def is_comment(line: Column, starts: tuple[str, ...] = ("#", "//", "--")) -> Column:
    """Whether a line holds nothing but a line comment."""
    return line.rlike(r"^\s*(?:" + "|".join(starts) + ")")


def line_stats(content: Column, comments: bool = False) -> Column:
    """loc, sloc, comment_lines and blank_lines of a text; code wins over comments, and comments over blanks."""
    if comments:
        all_ = lines(content)
        comment, blank = count_where(all_, lambda x: is_comment(x)), count_where(all_, is_blank)
        loc = F.size(all_).cast("long")
    else:
        # The same counts without an array of lines: line feeds by the bytes that they take, other lines from their first mark on.
        feeds = F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit("")))
        loc = F.when(F.length(content) == 0, F.lit(0)).otherwise(feeds + F.when(F.endswith(content, F.lit("\n")), F.lit(0)).otherwise(F.lit(1))).cast("long")
        comment, blank = F.lit(0).cast("long"), loc - F.regexp_count(content, F.lit(r"\S[^\n]*"))
    return F.struct(loc.alias("loc"), (loc - blank - comment).alias("sloc"), comment.alias("comment_lines"), blank.alias("blank_lines"))


def comment_ratio(comment_lines: Column, sloc: Column) -> Column:
    return F.coalesce(F.try_divide(comment_lines.cast("double"), comment_lines + sloc), F.lit(0.0))


def token_estimate(content: Column) -> Column:
    """Words and single other characters: an estimate of size that needs no vocabulary, never to be called a BPE count."""
    return F.regexp_count(content, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")).cast("long")


def marker_count(content: Column, marker: str) -> Column:
    """Occurrences of a marker between ASCII word borders."""
    return F.regexp_count(content, F.lit(rf"(?<![A-Za-z0-9_]){marker}(?![A-Za-z0-9_])")).cast("long")


def max_brace_depth(content: Column) -> Column:
    """The deepest nesting of braces; a closing brace at depth zero leaves it there."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))
    braces = F.split(F.regexp_replace(content, "[^{}]", ""), "")

    def step(a: Column, x: Column) -> Column:
        depth = F.when(x == "{", a["depth"] + 1).when(x == "}", F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), F.greatest(a["most"], depth).alias("most"))

    return F.aggregate(braces, start, step, lambda a: a["most"]).cast("long")
