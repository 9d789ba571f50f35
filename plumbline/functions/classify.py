"""Which files are likely produced by machines: minified, bundled, generated or vendored, in this order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lines import is_blank, lines
from .paths import file_name, normalised

#: Directories and suffixes that classification goes by.
BUNDLED_DIRS = ("dist", "build", ".next", ".nuxt", ".svelte-kit", "out")
GENERATED_SUFFIXES = (".pb.go", "_pb2.py", ".pb.cc", ".pb.h", ".g.dart", ".freezed.dart", ".designer.cs", ".generated.ts")
VENDORED_DIRS = ("vendor", "node_modules", "third_party", "third-party", "dist", "build", ".next", "out")
BANNERS = ("@generated", "code generated by", "this file was generated", "this file is generated", "automatically generated", "auto-generated")


def looks_minified(content: Column) -> Column:
    """A line of over 2,000 bytes, or several lines of over 250 bytes on average."""
    all_ = lines(content)
    total = F.aggregate(all_, F.lit(0), lambda a, x: a + F.octet_length(x))
    return F.exists(all_, lambda x: F.octet_length(x) > 2000) | ((F.size(all_) > 1) & (total > 250 * F.size(all_)))


def is_bundled(path: Column) -> Column:
    lower = F.lower(normalised(path))
    name = file_name(lower)
    chunk = name.rlike(r"^(?:chunk-(?:vendors|common)\.|chunk[-_](?=[a-z0-9_~-]*[0-9]|[0-9a-f]{6,}\.[^.]*$)[a-z0-9_~-]{6,}\.[^.]*$)")
    directory = lower.rlike(r"(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in BUNDLED_DIRS) + r"|static/chunks)/")
    return name.rlike(r"\.(?:js|mjs|cjs|css)$") & (F.contains(name, F.lit(".chunk.")) | F.contains(name, F.lit(".bundle.")) | chunk | directory)


def has_generated_banner(content: Column) -> Column:
    """A banner in a comment among the first five lines that aren't blank."""
    head = F.slice(F.filter(lines(content), lambda x: ~is_blank(x)), F.lit(1), F.lit(5))
    return F.exists(head, lambda x: F.lower(x).rlike(r"^\s*(?://|#|/\*)\s*(?:" + "|".join(BANNERS) + r"|generated.*do not edit)"))


def skip_hint(path: Column, content: Column) -> Column:
    generated = F.lit(False)
    for suffix in GENERATED_SUFFIXES:
        generated = generated | F.endswith(path, F.lit(suffix))
    vendored = F.exists(F.split(F.regexp_replace(normalised(path), "/?[^/]*$", ""), "/"), lambda x: x.isin(*VENDORED_DIRS))
    return (
        F.when(F.contains(F.lower(file_name(path)), F.lit(".min.")) | looks_minified(content), F.lit("minified"))
        .when(is_bundled(path), F.lit("bundled"))
        .when(generated | has_generated_banner(content), F.lit("generated"))
        .when(vendored, F.lit("vendored"))
    )
