"""The dimension of recognised formats."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Language(NamedTuple):
    extensions: str
    line_comments: tuple[str, ...] = ()
    block_comments: tuple[tuple[str, str], ...] = ()
    source: bool = True
    code: bool = True
    parsed: bool = False


SLASHES, STAR = ("//",), (("/*", "*/"),)
#: Names, file extensions and comment delimiters.
LANGUAGES = {
    "Rust": Language("rs", SLASHES, STAR, parsed=True),
    "Python": Language("py pyi pyw", ("#",), (('"""', '"""'), ("'''", "'''")), parsed=True),
    "JavaScript": Language("cjs js jsx mjs", SLASHES, STAR, parsed=True),
    "TypeScript": Language("cts mts ts", SLASHES, STAR, parsed=True),
    "TSX": Language("tsx", SLASHES, STAR, parsed=True),
    "Go": Language("go", SLASHES, STAR, parsed=True),
    "PHP": Language("ctp engine inc install module php php3 php4 php5 php7 php8 phps phpt phtml profile theme", ("//", "#"), STAR, parsed=True),
    "C": Language("c", SLASHES, STAR),
    "C++": Language("c++ cc cpp cxx", SLASHES, STAR),
    "C/C++ Header": Language("h hh hpp hxx", SLASHES, STAR),
    "C#": Language("cs", SLASHES, STAR),
    "Java": Language("java", SLASHES, STAR),
    "Kotlin": Language("kt kts", SLASHES, STAR),
    "Swift": Language("swift", SLASHES, STAR),
    "Ruby": Language("rb", ("#",), (("=begin", "=end"),)),
    "Shell": Language("bash sh zsh", ("#",)),
    "Scala": Language("sc scala", SLASHES, STAR),
    "Haskell": Language("hs", ("--",), (("{-", "-}"),)),
    "Lua": Language("lua", ("--",), (("--[[", "]]"),)),
    "SQL": Language("sql", ("--",), STAR),
    "HTML": Language("htm html", (), (("<!--", "-->"),), False, False),
    "CSS": Language("css", (), STAR, False, False),
    "SCSS": Language("sass scss", SLASHES, STAR, False, False),
    "JSON": Language("json jsonc", (), (), False, False),
    "YAML": Language("yaml yml", ("#",), (), False, False),
    "TOML": Language("toml", ("#",), (), False, False),
    "Markdown": Language("markdown md", (), (), False, False),
    "XML": Language("xml", (), (("<!--", "-->"),), False, False),
    "Dockerfile": Language("", ("#",), (), True, False),
    "Makefile": Language("", ("#",), (), True, False),
    "Text": Language("txt", (), (), False, False),
}
BY_EXTENSION = {x: name for name, language in LANGUAGES.items() for x in language.extensions.split()}
BY_NAME = {"makefile": "Makefile", "gnumakefile": "Makefile", "dockerfile": "Dockerfile"}


def detect(path: str) -> str | None:
    """The format of a path: Dockerfile and its variants, then the extension, then the whole name."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    if name == "dockerfile" or name.startswith("dockerfile."):
        return "Dockerfile"
    return BY_EXTENSION.get(name.rsplit(".", 1)[1]) if "." in name[1:] and name.rsplit(".", 1)[1] in BY_EXTENSION else BY_NAME.get(name)


def language_of(path: Column) -> Column:
    """detect() as a column."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1))
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    table = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    names = F.create_map(*(F.lit(x) for pair in BY_NAME.items() for x in pair))
    return F.when(name.rlike(r"^dockerfile(\.|$)"), F.lit("Dockerfile")).otherwise(F.coalesce(F.try_element_at(table, extension), F.try_element_at(names, name)))


def is_source(language: Column) -> Column:
    return language.isin([k for k, v in LANGUAGES.items() if v.source])


def is_code(language: Column) -> Column:
    return language.isin([k for k, v in LANGUAGES.items() if v.code])
