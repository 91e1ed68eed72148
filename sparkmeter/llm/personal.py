"""Personal data: boosted trees choose among candidate spans of high-recall generators.

Four base kinds have exact patterns and checks; their spans always stay. Generators propose further
spans, which may overlap each other and the base ones: loose e-mail forms, spelled-out addresses,
runs of digits with separators, and long mixed tokens. Boosted trees score each candidate from its
format and the text just before it. They are trained on a small labelled table made from a rule;
half of it fits the trees, the other half sets for each kind the least threshold that accepts no
negative example. An accepted candidate that does not touch a base span (nor an earlier accepted
one) is added.

Everything on rows is a column expression. Matches are placed by cutting the text with the same
pattern: a match starts after all pieces and matches before it, so nothing is searched twice. Where
a pattern may start inside a run only at its begin or after the last match, a look-behind says so;
this keeps the leftmost matches and makes long runs linear. Positions are code points.

A null text is empty. Rows are independent, so repeated rows and ids need no care; other columns
are carried along, and columns of the same names are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import let, table
from sparkmeter.llm.registry import query

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: kind -> (pattern, sign that every match has)
BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: generator -> (pattern, sign that every match has)
GENERATORS = {
    "loose_email": (r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++", "@"),
    "spelled_email": (
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?[\[(]at[\])] ?{_LABEL}++(?: ?[\[(]dot[\])] ?{_LABEL}++)++",
        "at",
    ),
    "digits": (r"[(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,}+", None),
    "token": (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+", None),
}
_CONTEXT = 24
_SECRET_WORDS = r"(?i)\b(token|secret|password|passwd|pwd|api.?key|bearer|credentials?)\b"
_PHONE_WORDS = r"(?i)\b(tel|phone|mobile|fax|call|cell|whatsapp)\b"
_MAIL_WORDS = r"(?i)\b(e?-?mail|contact|write to|reach)\b"
SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,text:string,before:string>>"


def _find(body: Column, pattern: str, sign: str | None) -> Column:
    """All matches with their places and the text just before each."""
    guard = F.contains(body, F.lit(sign)) if sign else body.rlike("[0-9]")

    def placed(matches: Column) -> Column:
        def walk(pieces: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

            def step(a: Column, i: Column) -> Column:
                match, piece = F.get(matches, i), F.get(pieces, i)
                begin = a["at"] + F.length(piece)
                end = begin + F.length(match)
                span = F.struct(
                    begin.alias("start"),
                    end.alias("end"),
                    match.alias("text"),
                    F.right(piece, F.lit(_CONTEXT)).alias("before"),
                )
                return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step)["out"]

        found = let(F.split(body, pattern, -1), walk)
        return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(_FOUND))

    return F.when(guard, let(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), placed)).otherwise(
        F.array().cast(_FOUND)
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == 1
        value = F.when(twice, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)
        return total + value

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = _digits(text)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _spans(found: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")),
    )


def _base_of(body: Column, kind: str) -> Column:
    return _spans(F.filter(_find(body, *BASE[kind]), lambda s: _valid(kind, s["text"])), kind)


def base_spans(body: Column) -> Column:
    """Spans of the base kinds, by start, then kind."""
    return F.array_sort(F.concat(*[_base_of(body, kind) for kind in BASE])).cast(SPAN)


def features(generator: str, span: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    text, before = span["text"], span["before"]
    digits = _digits(text)
    count = lambda p: F.regexp_count(text, F.lit(p))
    flag = lambda c: c.cast("int")
    return {
        "generator": F.lit(list(GENERATORS).index(generator)),
        "length": F.length(text),
        "digits": F.length(digits),
        "too_long": flag(F.length(digits) > 15),
        "dots": count(r"\."),
        "separators": count(r"[ ()\-/]"),
        "letter_kinds": flag(text.rlike("[a-z]")) + flag(text.rlike("[A-Z]")),
        "hex": flag(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "groups_3_4": flag(text.rlike(r"[(]?[0-9]{3}[)]?[ .-]+[0-9]{3}[ .-]+[0-9]{4}$")),
        "domain": flag(text.rlike(r"@[A-Za-z0-9-]+([.\[(]|\x20).*[A-Za-z]{2,}")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "secret_word": flag(before.rlike(_SECRET_WORDS)),
        "phone_word": flag(before.rlike(_PHONE_WORDS)),
        "mail_word": flag(before.rlike(_MAIL_WORDS)),
        "date_like": flag(text.rlike(r"^(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.]")),
    }


KIND_OF = {"loose_email": "email", "spelled_email": "email", "digits": "phone", "token": "secret"}


# ---- the labelled table, from a rule -------------------------------------------------------------


def labelled_examples() -> list[tuple[str, int, int]]:
    """(text, label, fold): the candidates of a text are positive where the label is 1."""
    hexes = [format((k * 2654435761) ** 5 % 16**40, "040x") for k in range(3, 11)]
    mixed = [f"sk{h[:6]}X{h[6:12].upper()}_{h[12:24]}" for h in hexes]
    numbers = [str((k * 7919) ** 4 % 10**10).zfill(10) for k in range(11, 19)]
    phones = [f"{n[:3]}-{n[3:6]}-{n[6:]}" for n in numbers]
    phones += [f"({n[:3]}) {n[3:6]}-{n[6:]}" for n in numbers]
    local = [f"{n[0]} {n[1:5]} {n[5:]}" for n in numbers]
    positive = [f"{w} {q}{h}{q}" for h in hexes for w, q in (("token =", '"'), ("secret:", ""))]
    positive += [f"password: {m}" for m in mixed] + [f"the api key = {m} is mine" for m in mixed]
    positive += [f"reach us {p} today" for p in phones] + [f"phone: {p}" for p in local]
    positive += [f"tel {n}" for n in numbers]
    for k in range(8):
        positive.append(f"mail ana{k} [at] site{k} [dot] org")
        positive.append(f"contact: bo.b{k} (at) host{k} (dot) net")
        positive.append(f"mail jörg{k}@firma{k}.example")
    negative = [f"commit {h} merged" for h in hexes] + [f"see {h}" for h in hexes]
    negative += [f"file part_{m} of the set" for m in mixed]
    negative += [f"order {n}{n[:6]} shipped" for n in numbers] + [f"{n}" for n in numbers]
    negative += [f"phone order {n}{n[:6]}" for n in numbers]
    negative += [f"on {1990 + k}-0{k + 1}-1{k} {k + 10}" for k in range(8)]
    negative += [f"values {k}.{k + 3} 1{k}.25 {k}00.75 9{k}" for k in range(8)]
    negative += [f"version 1{k}.2{k}.3{k}.4{k}56" for k in range(8)]
    negative += [f"follow @user{k}@ or a@b{k}" for k in range(8)]
    negative += [f"room {k} 12 14 {k}6 18 20 22" for k in range(8)]
    return [
        (text, label, k % 2)
        for label, texts in ((1, positive), (0, negative))
        for k, text in enumerate(texts)
    ]


# ---- boosting ------------------------------------------------------------------------------------

ROUNDS, RATE, DEPTH = 24, 0.4, 2


@dataclass(frozen=True)
class Split:
    """At most ``cut`` goes left; sides are splits or leaf values."""

    name: str
    cut: float
    left: Split | float
    right: Split | float


def _leaf(rows: list[dict], grads: list[tuple[float, float]]) -> float:
    return RATE * sum(g for g, _ in grads) / (sum(h for _, h in grads) + 1.0)


def _grow(rows: list[dict], grads: list[tuple[float, float]], depth: int) -> Split | float:
    """The split with the largest gain of a second-order loss, or a leaf."""
    score = lambda part: sum(g for g, _ in part) ** 2 / (sum(h for _, h in part) + 1.0)
    best: tuple[float, str, float] | None = None
    for name in sorted(rows[0]) if depth and rows else []:
        values = sorted({r[name] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            left = [g for r, g in zip(rows, grads, strict=True) if r[name] <= cut]
            right = [g for r, g in zip(rows, grads, strict=True) if r[name] > cut]
            gain = score(left) + score(right) - score(grads)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                best = gain, name, cut
    if best is None:
        return _leaf(rows, grads)
    _, name, cut = best
    sides = []
    for keep in (lambda r: r[name] <= cut, lambda r: r[name] > cut):
        picked = [(r, g) for r, g in zip(rows, grads, strict=True) if keep(r)]
        sides.append(_grow([r for r, _ in picked], [g for _, g in picked], depth - 1))
    return Split(name, cut, *sides)


def _value(tree: Split | float, row: dict) -> float:
    while isinstance(tree, Split):
        tree = tree.left if row[tree.name] <= tree.cut else tree.right
    return tree


def fit(rows: list[dict], labels: list[int]) -> list[Split | float]:
    """Boosted trees on the logistic loss."""
    trees: list[Split | float] = []
    scores = [0.0] * len(rows)
    for _ in range(ROUNDS):
        chances = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [(y - p, p * (1 - p)) for y, p in zip(labels, chances, strict=True)]
        tree = _grow(rows, grads, DEPTH)
        trees.append(tree)
        scores = [s + _value(tree, r) for s, r in zip(scores, rows, strict=True)]
    return trees


def _column(tree: Split | float, values: dict[str, Column] | Column) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    return F.when(values[tree.name] <= tree.cut, _column(tree.left, values)).otherwise(
        _column(tree.right, values)
    )


@dataclass(frozen=True)
class Model:
    trees: list[Split | float]
    thresholds: dict[str, float]

    def score(self, values: Column) -> Column:
        return reduce(lambda a, b: a + b, [_column(t, values) for t in self.trees])


def _candidates(body: Column, generator: str) -> Column:
    pattern, sign = GENERATORS[generator]
    return F.transform(
        _find(body, pattern, sign),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.struct(*[c.alias(n) for n, c in features(generator, s).items()]).alias("f"),
        ),
    )


def train(spark: SparkSession) -> Model:
    """Fit on one half of the labelled table, set thresholds on the other.

    The features of the examples come from the same column expressions as those of documents.
    """
    values = ", ".join(f"('{t}', {y}, {k})" for t, y, k in labelled_examples())
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS e(t, y, fold)")
    spans = [
        rows.select("y", "fold", F.lit(name).alias("g"), F.explode(_candidates(F.col("t"), name)).alias("c"))
        for name in GENERATORS
    ]
    kept = reduce(DataFrame.union, spans).select("g", "y", "fold", "c.f").coalesce(1)
    found = [(r["g"], r["y"], r["fold"], r["f"].asDict()) for r in kept.collect()]
    fitted = fit([f for _, _, k, f in found if k == 0], [y for _, y, k, _ in found if k == 0])
    thresholds = {}
    for name in GENERATORS:
        scored = [(sum(_value(t, f) for t in fitted), y) for g, y, k, f in found if k == 1 and g == name]
        worst = max([s for s, y in scored if not y], default=0.0)
        above = [s for s, y in scored if y and s > worst]
        # Halfway between the best negative and the least positive above it; even odds at least.
        thresholds[name] = max(0.0, (worst + min(above)) / 2) if above else math.inf
    return Model(fitted, thresholds)


def _accepted(body: Column, name: str, model: Model) -> Column:
    above = lambda c: model.score(c["f"]) > model.thresholds[name]
    return _spans(F.filter(_candidates(body, name), above), KIND_OF[name])


def added_spans(body: Column, base: Column, model: Model) -> Column:
    """Accepted candidates that touch neither a base span nor an accepted one before them."""
    parts = []
    for name in GENERATORS:
        if not math.isinf(model.thresholds[name]):
            parts.append(_accepted(body, name, model))
    if not parts:
        return F.array().cast(SPAN)
    touch = lambda a: lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = lambda found: F.filter(found, lambda c: ~F.exists(base, touch(c)))

    def step(kept: Column, c: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)["end"]
        return F.when((F.size(kept) > 0) & (c["start"] < last), kept).otherwise(
            F.array_append(kept, c)
        )

    sorted_spans = F.array_sort(free(F.concat(*parts).cast(SPAN)))
    return F.aggregate(sorted_spans, F.array().cast(SPAN), step)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def find_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``base`` and ``found`` (base and added spans) to each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("base", base_spans(body))
    both = F.array_sort(F.concat(F.col("base"), added_spans(body, F.col("base"), model)))
    return found.withColumn("found", both)


def redacted(body: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substr(body, a["at"] + 1, s["start"] - a["at"])
        fresh = F.concat(a["out"], between, F.get(labels, s["kind"]))
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"),
        )

    rest = F.aggregate(spans, start, step)
    return let(rest, lambda r: F.concat(r["out"], F.substr(body, r["at"] + 1, F.length(body))))


def redact(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with personal data replaced; rows without any, and null texts, are unchanged.

    Columns that share a name with a result are kept as they came.
    """
    found = find_spans(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")), model)
    changed = F.when(F.size("found") > 0, redacted(F.col("text"), F.col("found")))
    cleaned = F.coalesce(changed, F.col("text"))
    return found.select(*[(cleaned if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def describe(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests of the spans of each document."""
    count = lambda k: F.size(
        F.filter("base", lambda s: s["kind"] == KINDS.index(k))
    ).cast("bigint")
    return find_spans(docs, model, text).select(
        F.col(id_col),
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
        F.size("found").cast("bigint").alias("n_spans"),
        (F.size("found") - F.size("base")).cast("bigint").alias("n_added"),
    )


@query("op7_boosted_pii")
def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(table(spark, sf_dir, "documents"), train(spark))
