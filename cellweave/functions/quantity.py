"""Numbers, scales, units, modifiers and their variants, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that name a scale or a unit (fixed values).
SCALES = {"billion": 1e9, "giga": 1e9, "million": 1e6, "mega": 1e6, "thousand": 1e3, "kilo": 1e3, "hundred": 100.0, "cents": 0.01}
UNITS = {
    "%": "%", "perc": "%", "per cent": "%", "percent": "%", "percentage": "%", "dollar": "$", "dollars": "$", "$": "$", "usd": "$",
    "eur": "eur", "euro": "eur", "€": "eur", "£": "pound",
}
#: Words that modify a quantity, and words that name an aggregate (fixed values).
APPROXIMATE = "about approximately around roughly nearly close almost slightly".split()
EXACT = "exactly exact precisely specifically strictly literally".split()
BOUND = "less lowermost below under more least above greater higher".split()
AGGREGATES = {
    "total": "sum", "overall": "sum", "sum": "sum", "average": "avg", "decrease": "rat", "increase": "rat", "percent": "percentage",
    "percentage": "percentage", "difference": "dif", "decreased": "rat", "increased": "rat", "up": "rat", "down": "rat", "-": "rat", "+": "rat",
}
NUMBER = r"(-)?(\d+(?:[, ]\d+)*(?:\.\d+)?)"
FRAME = 5


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _chain(cases, default) -> Column:
    first, *rest = cases
    return reduce(lambda w, c: w.when(*c), rest, F.when(*first)).otherwise(default)


def round2(x) -> Column:
    """Two decimals, halves up, by one IEEE rule in every engine."""
    return F.floor(_c(x) * 100 + 0.5) / 100


def is_year(s) -> Column:
    return F.rlike(F.trim(_c(s)), F.lit(r"^(?:19\d{2}|20[01]\d)$"))


def is_quantity(s) -> Column:
    """Money or percent, or a number with at most ten characters before or after it."""
    number = r"\(?[+-]?\d+(?:[., ]\d+)*\)?"
    money = r"\(?[+-]?\p{Sc}?\d+(?:[., ]\d+)*%?\p{Sc}?\)?"
    return F.rlike(F.trim(_c(s)), F.lit(rf"^(?:{money}|{number}.{{1,10}}|.{{1,10}}{number}|.{{1,10}}{number}.{{1,10}})$"))


def value_text(s) -> Column:
    """Digits of the first number: a decimal comma becomes a point, separators go."""
    number = F.regexp_extract(_c(s), NUMBER, 2)
    return F.when(F.rlike(number, F.lit(r"^\d+,\d$")), F.replace(number, F.lit(","), F.lit("."))).otherwise(
        F.regexp_replace(number, "[, ]", "")
    )


def negative(s) -> Column:
    return F.regexp_extract(_c(s), NUMBER, 1) == "-"


def value(s) -> Column:
    return value_text(s).try_cast("double")


def precision(s) -> Column:
    return F.length(F.regexp_extract(value_text(s), r"\.(\d+)$", 1))


def zero_scale(s) -> Column:
    """Scale of a zero suffix such as (000s)."""
    s = _c(s)
    return _chain([(F.rlike(s, F.lit(r"\D000(?:'s|s)")), 1e3), (F.rlike(s, F.lit(r"\D000000(?:'s|s)")), 1e6)], 1.0)


def _scale_unit_cases(s: Column) -> list[tuple[Column, float, str | None]]:
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))
    like = lambda p: F.rlike(s, F.lit(p))
    money = r"^\p{Sc}\d+(?:[.,]\d+)*"
    return [
        (has("million", "mega"), 1e6, None),
        (has("billion", "giga"), 1e9, None),
        (has("thousand", "kilo"), 1e3, None),
        (has("hundred"), 100.0, None),
        (like(r"\bcents?\b"), 0.01, "$"),
        (like(money + "bn?$"), 1e9, None),
        (like(money + "mn?$"), 1e6, None),
        (like(money + "k$"), 1e3, None),
        (like(r"^\(?\p{Sc}?000'?s"), 1e3, None),
        *((has(sign + letter), scale, unit) for sign, unit in (("$", "$"), ("£", "pound")) for letter, scale in (("m", 1e6), ("b", 1e9), ("k", 1e3))),
    ]


def scale_of(s) -> Column:
    """Scale that a lower-case string names, 1 if none; the first matching rule decides."""
    s = F.coalesce(_c(s), F.lit(""))
    return _chain([(c, F.lit(v)) for c, v, _ in _scale_unit_cases(s)], F.lit(1.0))


def unit_of(s) -> Column:
    """Unit that a lower-case string names, or null."""
    s = F.coalesce(_c(s), F.lit(""))
    has = lambda *words: reduce(lambda a, b: a | b, (F.contains(s, F.lit(w)) for w in words))
    sign = _chain([(c, F.lit(u)) for c, _, u in _scale_unit_cases(s)], F.lit(None).cast("string"))
    word = _chain(
        [
            (has("$", "usd", "dollar"), F.lit("$")),
            (has("eur", "€"), F.lit("eur")),
            (has("£", "pound"), F.lit("pound")),
            (has("%", "percent", "per cent"), F.lit("%")),
        ],
        F.lit(None).cast("string"),
    )
    return F.coalesce(sign, word)


def simple_unit(s) -> Column:
    return _chain([(F.contains(_c(s), F.lit("%")), F.lit("%")), (F.contains(_c(s), F.lit("$")), F.lit("$"))], F.lit("other"))


def simple_scale(s) -> Column:
    words = (("million", 1e6), ("thousand", 1e3), ("hundred", 100.0), ("billion", 1e9))
    return _chain([(F.contains(_c(s), F.lit(w)), F.lit(v)) for w, v in words], F.lit(0.0))


def scaled_value(v, scale, unit, own_scale) -> Column:
    """Percentages are never scaled; else by the context's scale, else by the mention's own."""
    return F.when(_c(unit).eqNullSafe(F.lit("%")), _c(v)).otherwise(_c(v) * F.coalesce(_c(scale), _c(own_scale), F.lit(1.0)))


def scale_gap(a, b) -> Column:
    return F.abs(F.log10(_c(a)) - F.log10(_c(b)))


def truncated(s) -> Column:
    """One decimal level dropped, or the last half of an integer's digits zeroed."""
    s = _c(s)
    raw = F.trim(F.regexp_extract(s, r"\d+(?:[, ]\d+)*(?:\.\d+)?", 0))
    v = F.regexp_replace(raw, "[, ]", "")
    half = F.floor(F.length(v) / 2).cast("int")
    new = (
        F.when(F.rlike(v, F.lit(r"\.\d{2,}$")), F.regexp_extract(v, r"^\d+\.\d", 0))
        .when(F.contains(v, F.lit(".")), F.regexp_extract(v, r"^\d+", 0))
        .when(F.length(v) > 2, F.concat(F.substr(v, F.lit(1), F.length(v) - half), F.repeat(F.lit("0"), half)))
    )
    return F.when(new.isNull() | (raw == ""), s).otherwise(F.replace(s, raw, new))


def approximated(s) -> Column:
    """Decimals rounded to integers, integers rounded to their first half of digits."""
    s = _c(s)
    raw = F.trim(F.regexp_extract(s, r"\d+(?:[, ]\d+)*(?:\.\d+)?", 0))
    v = F.regexp_replace(raw, "[, ]", "")
    ten = F.pow(F.lit(10.0), F.floor(F.length(v) / 2))
    x = v.try_cast("double")
    new = F.when(F.contains(v, F.lit(".")), F.concat(F.floor(x + 0.5).cast("string"), F.lit(".0"))).otherwise(
        (F.floor(x / ten + 0.5) * ten).cast("long").cast("string")
    )
    return F.when(raw == "", s).otherwise(F.replace(s, raw, new))


def pair_type(a, b) -> Column:
    a, b = _c(a), _c(b)
    return _chain(
        [(a == b, F.lit("exact")), ((a != b) & (F.startswith(a, b) | F.startswith(b, a)), F.lit("truncated"))], F.lit("approximate")
    )


def relation_of(name) -> Column:
    """Relation that a virtual cell's name carries; there is no rule for sums."""
    rules = (("rat", "rat"), ("perc", "percentage"), ("dif", "dif"), ("avg", "avg"))
    return _chain([(F.contains(_c(name), F.lit(k)), F.lit(v)) for k, v in rules], F.lit("same"))


def full_name(table, cell, func) -> Column:
    return F.concat_ws(".", _c(table).cast("string"), _c(cell).cast("string"), _c(func))


def aggregate_header(h) -> Column:
    return F.coalesce(F.rlike(_c(h), F.lit("total|change|percent|average|avg|diff")) | (_c(h) == "%"), F.lit(False))


def frame(before, after, n: int = FRAME) -> Column:
    """The last n tokens before a mention and the first n after it, in order."""
    last = F.slice(_c(before), F.greatest(F.size(_c(before)) - n + 1, F.lit(1)), n)
    return F.concat(last, F.slice(_c(after), 1, n))


def modifier(words) -> Column:
    """Class of the first modifier word of a frame."""
    kinds = {w: k for k, ws in (("approx", APPROXIMATE), ("exact", EXACT), ("bound", BOUND)) for w in ws}
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.get(F.filter(F.transform(_c(words), lambda w: F.try_element_at(known, w)), lambda k: k.isNotNull()), F.lit(0))


def aggregate_named(words) -> Column:
    """Aggregate function of the first aggregate word of a frame."""
    known = F.create_map(*[F.lit(x) for kv in AGGREGATES.items() for x in kv])
    return F.get(F.filter(F.transform(_c(words), lambda w: F.try_element_at(known, w)), lambda k: k.isNotNull()), F.lit(0))


def neighbour_scale_unit(before, after, n: int = FRAME) -> Column:
    """struct<scale, unit> from the n tokens after, to the first unit; else from those before, nearest first."""
    scales = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    ahead = F.slice(_c(after), 1, n)
    back = F.reverse(F.slice(_c(before), F.greatest(F.size(_c(before)) - n + 1, F.lit(1)), n))

    def scan(words, start):
        return F.aggregate(
            words,
            start,
            lambda acc, w: F.when(acc["unit"].isNotNull(), acc).otherwise(
                F.struct(
                    F.coalesce(F.try_element_at(scales, w), acc["scale"]).alias("scale"), F.try_element_at(units, w).alias("unit")
                )
            ),
        )

    first = scan(ahead, F.struct(F.lit(1.0).alias("scale"), F.lit(None).cast("string").alias("unit")))
    return scan(back, first)


def cell_list(cells) -> Column:
    """A comma list of cell ids, trailing comma tolerated, as sorted integers."""
    return F.array_sort(F.transform(F.filter(F.split(_c(cells), ","), lambda x: x != ""), lambda x: x.cast("int")))


def sorted_cells(cells) -> Column:
    return F.array_join(F.transform(cell_list(cells), lambda x: x.cast("string")), ",")


def entropy(priors) -> Column:
    """Natural entropy of an array of weights, normalised first."""
    total = F.aggregate(_c(priors), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(_c(priors), F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))
