"""Personal data: base patterns, and further spans by candidate gradient boosting.

Base spans are matches of four patterns that pass their checks. Beside them, high-recall generators propose candidates,
which overlap each other and base spans: runs of digits with and without spaces, digits grouped like telephone numbers,
addresses whose marks are spelt out, credential-like runs. Boosted trees score a candidate by its format (digits, letters,
separators, shape, case, length) and its context (the word before, the characters around).

What strict patterns find can't teach what they miss. So the trees learn from disguises: each base span and each credential
of a strict format is rewritten into a form that its pattern doesn't find (an address with its marks spelt out, a card with
dots or between other digits, a telephone number without its plus, a credential without its key word or in upper case),
stays in its own context, and counts as true. Look-alikes made from the same spans (a card with a wrong check digit, an
address part above 255, a date, a handle, a credential without digits) count as false, and so do candidates of the corpus
that fail even loose checks. All other candidates have no label, and are what the trees decide on.

For each generator a threshold is calibrated on a held-out fold: the lowest score from which on an exact binomial test shows
that PRECISION of what it selects there is true. With too few examples nothing is selected. Credentials of a strict format pass a
check of their own, as base spans do, and need no threshold. A selected candidate is added unless a base span or a longer
selected one contains it.

All passes over the corpus are DataFrame operations. As all features have a few levels each, examples are counted by
their features, in a table of CELLS rows a fold at most by construction, and the trees are fitted on those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import binomial_at_most
from .shared import written

KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: Possessive repetition keeps Java's matcher from recursing, and starts are tied to the first character of a run (or to
#: the end of the match before), which gives the same matches without a new try at each character.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match; spares most texts the search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Leading zeros are free; a part of zeros alone is what the look-behind is for.
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?|(?<=0))"

GENERATORS = ("number", "digits", "grouped", "address", "secret")
#: Labels of a spelt-out domain after the first two; the rest of a longer one isn't part of the span.
LABELS = 8
#: Single characters repeat possessively, without a bound; only the few groups of a name or number are counted.
GENERATED = {
    "number": r"(?<![0-9A-Za-z+(])[+(]?[0-9][0-9\x20().-]{6,}+",
    "digits": r"(?<![0-9A-Za-z+(.-])[+(]?[0-9][0-9().-]{6,}+",
    "grouped": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    "address": rf"(?<!\S)[^\s@\[(]++(?:@|\x20?[\[(](?i:at)[\])]\x20?|\x20(?:at|AT)\x20(?=\S++\x20(?i:dot)\x20))[^\s@\[(]++(?:\x20?[\[(](?i:dot)[\])]\x20?[^\s\[(]++|\x20(?i:dot)\x20[^\s\[(]++){{0,{LABELS}}}",
    "secret": r"(?<![A-Za-z0-9])(?:[A-Za-z_]{3,20}\x20?[=:]\x20?)?+\"?+[A-Za-z0-9_/+-]{16,}+\"?+",
}
NEEDED = {"number": r"[0-9][0-9\x20().-]{6}", "digits": r"[0-9][0-9().-]{6}", "grouped": r"[0-9][\x20.-][0-9]{3,4}[\x20.-][0-9]{3}", "address": r"@|[\[(](?i:at)[\])]|\x20(?i:dot)\x20", "secret": r"[A-Za-z0-9_/+-]{16}"}
STRICT_SECRET = r"^(?:AKIA[0-9A-Z]{16}|[A-Za-z_]{3,20}\x20?[=:]\x20?\"?(?=[^\"]*[0-9])(?=[^\"]*[a-f])[0-9a-f]{16,}\"?)$"
NUMBER_CUE = r"(?i)(?:tel|phone|call|fax|mobile|card|visa|account|ip|host|address)[:.#\x20]*$"
CUES = {"address": r"(?i)(?:mail|contact|write|to|from)[:\x20]*$", "secret": r"(?i)(?:key|token|secret|password|auth)[\x20:=\"]*$"}
#: The product of the features' levels.
CELLS = 5 * 6 * 4 * 3 * 4 * 4 * 2 * 3 * 2 * 2
FOLDS, PRECISION, LEVEL, TREES, RATE = 4, 0.95, 0.05, 24, 0.4


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass Luhn's check."""
    digit = lambda i: F.substring(F.reverse(_digits(x)), i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, F.lit(9)).otherwise(F.lit(0)))
    return F.aggregate(F.sequence(F.lit(1), F.length(_digits(x))), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    return {"email": F.lit(True), "ip": x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), "card": n.between(14, 19) & luhn(x), "phone": n.between(10, 15)}[kind]


def _running(lengths: Column, block: int = 512) -> Column:
    """Sums of all values before each; in blocks, as a fold that appends to an array copies it each time."""

    def before(xs: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")), lambda a: a["out"])

    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    many = F.flatten(F.zip_with(blocks, before(F.transform(blocks, total), F.lit(0)), before))
    return F.when(F.size(lengths) <= block, before(lengths, F.lit(0))).otherwise(many)


def found(rows: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """rows with a column `name`: the matches of pattern in column text as an array of (s, start, end, before, after)."""
    empty = F.array().cast("array<string>")
    can = F.lit(True) if needs is None else F.contains("text", F.lit(needs)) if needs == "@" else F.col("text").rlike(needs)
    rows = rows.withColumn("_m", F.when(can, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(empty))
    rows = rows.withColumn("_p", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(empty))
    pairs = F.zip_with("_m", F.slice("_p", F.lit(1), F.size("_m")), lambda m, p: F.length(m) + F.length(p))
    rows = rows.withColumn("_n", pairs).withColumn("_r", F.when(F.size("_n") > 0, _running(F.col("_n"))).otherwise(F.array().cast("array<int>")))
    one = lambda m, i: F.struct(
        m.alias("s"),
        (F.get("_r", i) + F.length(F.get("_p", i))).alias("start"),
        (F.get("_r", i) + F.get("_n", i)).alias("end"),
        F.right(F.get("_p", i), F.lit(16)).alias("before"),
        F.left(F.get("_p", i + 1), F.lit(2)).alias("after"),
    )
    return rows.withColumn(name, F.transform("_m", one)).drop("_m", "_p", "_n", "_r")


def _level(x: Column, bounds: list[int]) -> Column:
    """How many of the bounds x reaches."""
    return sum((x >= b).cast("int") for b in bounds)


FEATURES = ("generator", "digits", "letters", "separators", "length", "shape", "both_cases", "before", "after", "cue")


QUAD = rf"^{BYTE}(?:[.-]{BYTE}){{3}}$"
PHONE = r"^(?:\+?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"


def shape(s: Column) -> Column:
    """1: four parts up to 255. 2: 14 to 19 digits that pass Luhn's check. 3: grouped like a telephone number. 0: none."""
    n = F.length(_digits(s))
    return F.when(s.rlike(QUAD), 1).when(n.between(14, 19) & s.rlike(r"^[0-9\x20.-]+$") & luhn(s), 2).when(s.rlike(PHONE), 3).otherwise(0)


def _by_generator(g: Column, of: dict[str, Column], rest: Column) -> Column:
    out = rest
    for name, value in of.items():
        out = F.when(g == GENERATORS.index(name), value).otherwise(out)
    return out


def features(x: Column) -> Column:
    """The features of a candidate or example (g, s, before, after), each with the few levels that CELLS counts."""
    s, before = x["s"], x["before"]
    last, next_ = F.right(x["before"], F.lit(1)), F.left(x["after"], F.lit(1))
    return F.struct(
        x["g"].alias("generator"),
        _level(F.length(_digits(s)), [1, 8, 10, 13, 16]).alias("digits"),
        _level(F.length(F.regexp_replace(s, r"\P{L}", "")), [1, 4, 12]).alias("letters"),
        _level(F.regexp_count(s, F.lit(r"[\x20().@=:\"-]")), [1, 3]).alias("separators"),
        _level(F.length(s), [12, 18, 30]).alias("length"),
        shape(s).alias("shape"),
        (s.rlike("[A-Z]") & s.rlike("[a-z]")).cast("int").alias("both_cases"),
        F.when(last.rlike(r"^\s?$"), F.lit(0)).when(last.rlike("[:=\"'(<]"), F.lit(1)).otherwise(F.lit(2)).alias("before"),
        next_.rlike(r"^[\s.,;:)>\"']?$").cast("int").alias("after"),
        _by_generator(x["g"], {k: before.rlike(CUES[k]) for k in ("address", "secret")}, before.rlike(NUMBER_CUE)).cast("int").alias("cue"),
    )


def _label(x: Column) -> Column:
    """True for a strict format, false for what fails loose checks, else null."""
    s = x["s"]
    secret = F.when(s.rlike(STRICT_SECRET), True).when(~(s.rlike("[0-9]") & s.rlike("[A-Za-z]")), False)
    return _by_generator(x["g"], {"secret": secret, "address": F.when(~s.rlike(r"\.|(?i)dot"), False)}, F.when(~F.length(_digits(s)).between(10, 19) & (shape(s) == 0), False))


def disguises(kind: str, x: Column) -> list[tuple[str, Column, bool, str, str | None]]:
    """Forms of a base span or strict credential, as (generator, text, whether it is true, text before, text after)."""
    s, digits = x["s"], _digits(x["s"])
    if kind == "email":
        local, domain = F.regexp_extract(s, "^([^@]*)@", 1), F.regexp_extract(s, "@(.*)$", 1)
        spelt = lambda at, dot: F.concat(local, F.lit(at), F.regexp_replace(domain, r"\.", dot))
        return [("address", spelt(" [at] ", " [dot] "), True, "", None), ("address", spelt("(at)", "."), True, "", None), ("address", spelt(" at ", " dot "), True, "", None), ("address", spelt("@", ""), False, "", None)]
    if kind == "ip":
        return [("digits", s, True, "17 ", " 4"), ("digits", F.regexp_replace(s, r"\.", "-"), True, "", None), ("digits", F.concat(F.lit("9"), F.lpad(s, 15, "3")), False, "", None), ("digits", F.regexp_replace(s, r"\.[0-9]+$", ".2024"), False, "", None)]
    if kind == "card":
        fours = F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1.")
        wrong = F.concat(F.left(digits, F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 3) % 10).cast("string"))
        return [("digits", digits, True, "4075 ", " 8"), ("digits", fours, True, "", None), ("digits", wrong, False, "4075 ", " 8"), ("digits", wrong, False, "", None)]
    if kind == "phone":
        local = F.regexp_replace(s, r"^\+[0-9]{1,3}[\x20.-]?", "")
        dotted = F.regexp_replace(F.right(digits, F.lit(10)), "^([0-9]{3})([0-9]{3})", "$1.$2.")
        date = F.concat(F.lit("20"), F.left(digits, F.lit(2)), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2))
        return [("grouped", s, True, "", " 1"), ("grouped", local, True, "", None), ("digits", dotted, True, "", None), ("digits", date, False, "", None), ("grouped", F.concat(F.left(digits, F.lit(3)), F.lit(" 000 "), F.right(digits, F.lit(3))), False, "", None)]
    bare = F.regexp_replace(s, r'^[^=:]*[=:]\x20?"?|"$', "")
    return [("secret", F.upper(s), True, "", None), ("secret", bare, True, "", None), ("secret", F.translate(s, "0123456789", "ghijklmnop"), False, "", None)]


def _made(kind: str, spans: Column) -> Column:
    """Examples of all spans, as (g, s, before, after, label, h): of each one all its false forms, and one true form by its hash.

    h is the span's own hash, so that all its forms share a fold.
    """

    def form(x: Column, generator: str, s: Column, label: bool, before: str, after: str | None) -> Column:
        return F.struct(F.lit(GENERATORS.index(generator)).alias("g"), s.alias("s"), F.concat(x["before"], F.lit(before)).alias("before"), (x["after"] if after is None else F.lit(after)).alias("after"), F.lit(label).alias("label"), F.xxhash64(x["s"]).alias("h"))

    def of(x: Column) -> Column:
        forms = disguises(kind, x)
        true, false = ([form(x, *f) for f in forms if f[2] == side] for side in (True, False))
        return F.concat(F.slice(F.array(*true), F.pmod(F.xxhash64(x["s"], F.lit(3)), F.lit(len(true))).cast("int") + 1, F.lit(1)), F.array(*false))

    return F.flatten(F.transform(spans, of))


def _span(x: Column, k: int, kind: str) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _passing(kind: str) -> Column:
    return F.filter(kind, lambda x: passes(kind, x["s"]))


def _based(k: int, kind: str) -> Column:
    return F.transform(_passing(kind), lambda x: _span(x, k, kind))


def _trimmed(x: Column) -> Column:
    """A run of digits without what follows the last one."""
    s = F.regexp_replace(x["s"], "[^0-9]++$", "")
    return F.struct(s.alias("s"), x["start"].alias("start"), (x["start"] + F.length(s)).alias("end"), x["before"].alias("before"), F.left(F.concat(F.substring(x["s"], F.length(s) + 1, F.lit(2)), x["after"]), F.lit(2)).alias("after"))


def _proposed(g: int, name: str) -> Column:
    return F.transform(name, lambda x: F.struct(F.lit(g).alias("g"), x["s"].alias("s"), x["start"].alias("start"), x["end"].alias("end"), x["before"].alias("before"), x["after"].alias("after")))


def _scorable(x: Column) -> Column:
    kind = F.element_at(F.array(*map(F.lit, GENERATORS)), x["g"] + 1)
    return F.struct(x["start"].alias("start"), (x["g"] + len(KINDS)).alias("k"), x["end"].alias("end"), kind.alias("kind"), features(x).alias("f"), _label(x).alias("label"), F.xxhash64(x["s"]).alias("h"))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans by start, then kind), candidates (spans with features, label and a hash) and examples (features,
    label and a hash) for each row of docs.

    Positions are code points, ends exclusive. A null text counts as empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base, candidates, examples = [], [], []
    for k, kind in enumerate(KINDS):
        rows = found(rows, kind, PATTERNS[kind], NEEDS[kind])
        base.append(_based(k, kind))
        examples.append(_made(kind, _passing(kind)))
    for g, name in enumerate(GENERATORS):
        rows = found(rows, name, GENERATED[name], NEEDED[name])
        if name in ("number", "digits"):
            rows = rows.withColumn(name, F.transform(name, _trimmed))
        candidates.append(_proposed(g, name))
    examples.append(_made("secret", F.filter("secret", lambda x: x["s"].rlike(STRICT_SECRET))))
    rows = rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*candidates).alias("candidates"), F.concat(*examples).alias("examples"))
    example = lambda x: F.struct(features(x).alias("f"), x["label"].alias("label"), x["h"].alias("h"))
    return rows.select("doc_id", "base", F.transform("candidates", _scorable).alias("candidates"), F.transform("examples", example).alias("examples"))


class Boosted:
    """Trees of depth two over features with few levels, by gradient boosting of the logistic loss with Newton steps."""

    def __init__(self, cells: list[tuple[tuple[int, ...], float, float]], trees: int = TREES, rate: float = RATE, ridge: float = 1.0):
        """cells: (features, count, count labelled true)."""
        total, true = sum(n for _, n, _ in cells), sum(t for _, _, t in cells)
        self.start = math.log((true + 1) / (total - true + 1))
        self.trees: list[tuple] = []
        score = [self.start] * len(cells)
        for _ in range(trees if cells else 0):
            grads = []
            for (_, n, t), z in zip(cells, score, strict=True):
                p = 1 / (1 + math.exp(-z))
                grads.append((t - n * p, n * p * (1 - p)))
            tree = self._grown(cells, grads, range(len(cells)), 2, rate, ridge)
            if not isinstance(tree, tuple):
                break
            self.trees.append(tree)
            score = [z + self._value(tree, f) for (f, _, _), z in zip(cells, score, strict=True)]

    def _grown(self, cells, grads, own, depth: int, rate: float, ridge: float):
        g, h = sum(grads[i][0] for i in own), sum(grads[i][1] for i in own)
        best = (1e-6, None)
        for feature in range(len(cells[0][0])) if depth else ():
            sums: dict[int, list[float]] = {}
            for i in own:
                s = sums.setdefault(cells[i][0][feature], [0.0, 0.0])
                s[0] += grads[i][0]
                s[1] += grads[i][1]
            left = [0.0, 0.0]
            for level in sorted(sums)[:-1]:
                left = [left[0] + sums[level][0], left[1] + sums[level][1]]
                gain = left[0] ** 2 / (left[1] + ridge) + (g - left[0]) ** 2 / (h - left[1] + ridge) - g * g / (h + ridge)
                if gain > best[0]:
                    best = (gain, (feature, level))
        if best[1] is None:
            return rate * g / (h + ridge)
        feature, level = best[1]
        sides = [[i for i in own if (cells[i][0][feature] <= level) == side] for side in (True, False)]
        return (feature, level, *(self._grown(cells, grads, side, depth - 1, rate, ridge) for side in sides))

    def _value(self, tree, f) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if f[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, f: tuple[int, ...]) -> float:
        return self.start + sum(self._value(t, f) for t in self.trees)


def thresholds(model: Boosted, cells: list[tuple[tuple[int, ...], float, float]], precision: float = PRECISION) -> dict[int, float]:
    """For each generator the lowest score from which on held-out examples are true, shown by an exact binomial test, with `precision`."""
    out = {}
    for g in range(len(GENERATORS)):
        rows = sorted(((model.score(f), n, t) for f, n, t in cells if f[0] == g), reverse=True)
        n = t = 0
        for k, (z, m, u) in enumerate(rows):
            n, t = n + m, t + u
            if binomial_at_most(int(n - t), int(n), 1 - precision) <= LEVEL and (k + 1 == len(rows) or rows[k + 1][0] < z):
                out[g] = z
    return out


def learned(rows: DataFrame) -> tuple[Boosted, dict[int, float]]:
    """Trees from three folds of the distinct examples, and thresholds from the other; copies count once and share a fold."""
    labelled = F.transform(F.filter("candidates", lambda x: x["label"].isNotNull()), lambda x: F.struct(x["f"].alias("f"), x["label"].alias("label"), x["h"].alias("h")))
    once = rows.select(F.explode(F.concat("examples", labelled)).alias("c")).select("c.h", "c.f", "c.label").distinct()
    cells = once.groupBy(F.pmod("h", F.lit(FOLDS)).alias("fold"), "f").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("t"))
    table: list[dict] = [{}, {}]
    for r in cells.collect():  # FOLDS * CELLS rows at most
        side, f = table[r.fold == 0], tuple(r.f)
        n, t = side.get(f, (0, 0))
        side[f] = (n + r.n, t + r.t)
    fit, held = ([(f, n, t) for f, (n, t) in sorted(x.items())] for x in table)
    model = Boosted(fit)
    return model, thresholds(model, held)


def scored(model: Boosted, f: Column) -> Column:
    def value(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(f[FEATURES[tree[0]]] <= tree[1], value(tree[2])).otherwise(value(tree[3]))

    out = F.lit(model.start)
    for tree in model.trees:
        out = out + value(tree)
    return out


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, k, end, kind, by start and then kind) for each row of docs.

    base: the matches of the four patterns that pass their checks, leftmost and non-overlapping for each kind. spans:
    these and the selected candidates; a candidate that a base span contains, or a longer selected one (of two equal ones
    that of the first generator), adds nothing and is left out. Equal tables give equal spans. Repeated rows are rows of
    their own with equal spans, and teach once; very long texts are whole; other columns, whatever their names, aren't read;
    an empty table gives no rows.
    """
    rows = written(described(docs), "pii-candidates")
    model, cut = learned(rows)
    plain = lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind"))
    strict = lambda x: F.coalesce(x["label"], F.lit(False))
    likely = lambda x: F.coalesce(scored(model, x["f"]) >= _chosen(cut, x["f"]["generator"]) - 1e-9, F.lit(False))
    take = (lambda x: strict(x) | likely(x)) if cut else strict
    rows = rows.withColumn("taken", F.transform(F.filter("candidates", take), plain))
    within = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])
    more = lambda x, y: (y["end"] - y["start"] > x["end"] - x["start"]) | ((y["end"] - y["start"] == x["end"] - x["start"]) & (y["k"] < x["k"]))
    apart = lambda x: ~F.exists("base", lambda y: within(x, y)) & ~F.exists("taken", lambda y: within(x, y) & more(x, y))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.filter("taken", apart))).alias("spans"))


def _chosen(cut: dict[int, float], generator: Column) -> Column:
    out = F.lit(None).cast("double")
    for g, z in cut.items():
        out = F.when(generator == g, F.lit(z)).otherwise(out)
    return out


def redacted(text: Column, spans: Column) -> Column:
    """text with each span's characters replaced by its kind in brackets, once where spans overlap: the first by start wins."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out")))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
