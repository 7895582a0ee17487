"""Quantity recognition in text: one tokenising pass, then a grammar over the tokens.

A text becomes tokens (numbers, words, currency signs, white space, single signs). Rules are parsing
expressions over tokens; they run in four stages, each rule over the whole text from left to right:
leave out dates, titles and durations; take ranges, compound units, money and percentages; leave out
phone numbers, years, headings and times; take scores and plain numbers. Tokens that a rule matched
are spent, so later rules meet a gap there and offsets stay those of the text. Runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEXER = regex.compile(r"(?P<n>\d+(?:[.,]\d+)*)|(?P<w>\p{L}+)|(?P<c>\p{Sc})|(?P<s>\s+)|(?P<o>.)", regex.S)
#: A parser takes the tokens and a place, and gives the place after its match or None.
Parser = Callable[["Tokens", int], int | None]

CALENDAR = "january february march april may june july august september october november december".split()
MONTHS = {*CALENDAR, *(m[:3] for m in CALENDAR)}
TITLES = set("line section sec table tab appendix chapter ch figure fig".split())
DURATIONS = set("minute minutes second seconds hour hours sec min mins hr hrs".split())
SIZES = set("million millions thousand thousands hundred hundreds billion billions".split())
SHORT_SIZES = set("t m mn k b bn".split())
DASHES = "-\u2013\u2212"


class Tokens:
    """Kinds, strings and offsets of a text's tokens; spent ones have the kind ``x``."""

    def __init__(self, text: str):
        found = [(m.lastgroup, m[0], m.start()) for m in LEXER.finditer(text)]
        self.kinds = [k for k, _, _ in found]
        self.words = [w for _, w, _ in found]
        self.starts = [a for _, _, a in found] + [len(text)]

    def kind(self, i: int) -> str:
        return self.kinds[i] if 0 <= i < len(self.kinds) else ""


def token(kind: str, test: Callable[[str], bool] = lambda s: True) -> Parser:
    return lambda t, i: i + 1 if t.kind(i) == kind and test(t.words[i]) else None


def word(*names: str) -> Parser:
    """One of some words, in small letters or with a capital first, or all capitals if short."""
    known = {f for n in names for f in (n, n.capitalize(), *([n.upper()] if len(n) < 3 else []))}
    return token("w", known.__contains__)


def sign(chars: str) -> Parser:
    return token("o", lambda s: s in chars)


def row(*parts: Parser) -> Parser:
    def parse(t: Tokens, i: int) -> int | None:
        for p in parts:
            if (i := p(t, i)) is None:
                return None
        return i

    return parse


def first(*choices: Parser) -> Parser:
    return lambda t, i: next((j for p in choices if (j := p(t, i)) is not None), None)


def maybe(*parts: Parser) -> Parser:
    p = row(*parts)
    return lambda t, i: i if (j := p(t, i)) is None else j


def many(p: Parser, least: int = 0) -> Parser:
    def parse(t: Tokens, i: int) -> int | None:
        n = 0
        while (j := p(t, i)) is not None:
            i, n = j, n + 1
        return i if n >= least else None

    return parse


def digits(low: int, high: int = 99) -> Parser:
    return token("n", lambda s: s.isdecimal() and low <= len(s) <= high)


def alone(p: Parser) -> Parser:
    """A match that no letter touches."""
    return lambda t, i: None if t.kind(i - 1) == "w" or (j := p(t, i)) is None or t.kind(j) == "w" else j


gap, number = token("s"), token("n")
space = maybe(gap)
year = token("n", lambda s: s.isdecimal() and len(s) == 4 and s[:2] in ("19", "20"))
any_year = first(digits(2, 4), row(sign("'\u2019"), digits(2, 2)))
month = row(word(*MONTHS), maybe(sign(".")))
day = digits(1, 2)
half_day = first(word("am", "pm"), row(word("a", "p"), sign("."), word("m"), maybe(sign("."))))
to = first(row(space, sign(DASHES), space), row(gap, word("to"), gap), row(space, sign("\u00b1"), space))
signed = row(maybe(sign("+" + DASHES)), number)
size = first(row(gap, word(*SIZES)), row(space, word(*SHORT_SIZES)))
percent = first(sign("%"), row(space, first(word("percent"), row(word("per"), gap, word("cent")))))
unit = row(first(token("w"), sign("\u00b0\u00b5%")), many(first(token("w"), sign("\u00b0\u00b2\u00b3^"))))
compound = row(space, unit, first(row(gap, word("per"), gap), row(space, sign("/"), space)), unit)
group = digits(3)
code = first(row(sign("("), maybe(sign("+")), digits(2), sign(")")), row(sign("+"), digits(2)))
dash_or_gap = first(sign("-"), token("s", lambda s: len(s) == 1))
mark = first(row(gap, sign(":/\\-"), gap), sign(":/\\-"))
money = row(token("c"), maybe(sign("(")), number, maybe(sign(")")))

#: (whether matches are quantities, kinds of token that a match begins with, rule), in order of use.
GRAMMAR: list[tuple[bool, str, Parser]] = [
    # Dates, titles, clock times with half of the day, durations.
    (False, "w", row(month, gap, day, space, sign(","), space, any_year)),
    (False, "nw", row(maybe(day, gap), month, space, maybe(sign(",")), space, any_year)),
    (False, "n", first(row(day, sign("-/"), day, sign("-/"), year), row(year, sign("-/"), day, sign("-/"), day))),
    (False, "n", first(row(year, space, sign("-/."), space, day), row(day, space, sign("-/."), space, year))),
    (False, "n", token("n", lambda s: regex.fullmatch(r"(?:19|20)\d\d\.\d{1,2}|\d{1,2}\.(?:19|20)\d\d", s) is not None)),
    (False, "w", row(word(*TITLES), maybe(sign(".")), space, number, maybe(gap, word("to"), gap, number))),
    (False, "n", row(day, sign(":"), digits(2, 2), space, half_day)),
    (False, "n", row(digits(1), gap, word(*DURATIONS))),
    # Compound units, percentages, money.
    (True, "on", row(signed, compound, to, signed, compound)),
    (True, "on", row(signed, maybe(to, signed), compound)),
    (True, "on", row(signed, space, sign("\u00d7\u00b1"), space, signed, compound)),
    (True, "on", row(signed, to, signed, percent)),
    (True, "c", row(money, to, money, maybe(size))),
    (True, "c", row(money, maybe(size))),
    (True, "n", alone(row(number, percent))),
    # Phone numbers, years, headings, sections, clock times, references.
    (False, "on", row(code, dash_or_gap, maybe(sign("(")), digits(2), maybe(sign(")")), many(row(dash_or_gap, digits(2)), 1))),
    (False, "on", row(first(row(sign("("), group, sign(")"), space), row(group, dash_or_gap)), group, many(row(dash_or_gap, digits(2))))),
    (False, "on", row(maybe(sign("(")), alone(year), maybe(sign(")")))),
    (False, "n", row(digits(1), sign("."), gap)),
    (False, "n", token("n", lambda s: s.count(".") > 1)),
    (False, "n", row(day, sign(":"), digits(2, 2), maybe(sign(":"), digits(2, 2)), maybe(space, half_day))),
    (False, "o", row(sign("["), digits(1), sign("]"))),
    # Scores and plain numbers.
    (True, "n", alone(row(digits(1, 3), many(row(mark, digits(1, 3)), 1)))),
    (True, "n", alone(row(number, maybe(first(to, row(space, sign("\u00d7"), space)), number), maybe(first(size, row(gap, word("kilo", "kilos"))))))),
]


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, surface) of the quantities of a text, in the order the grammar finds them; single characters are none."""
    text = (text or "").replace("\xa0", " ")
    t = Tokens(text)
    places: dict[str, list[int]] = {k: [] for k in "nwcso"}
    for i, k in enumerate(t.kinds):
        places[k].append(i)
    found: list[tuple[int, int, str]] = []
    for take, begins, rule in GRAMMAR:
        upto = 0
        for i in sorted(i for k in begins for i in places[k]) if len(begins) > 1 else places[begins]:
            if i < upto or t.kinds[i] == "x" or (end := rule(t, i)) is None:
                continue
            start, stop = t.starts[i], t.starts[end]
            surface = text[start:stop].strip()
            if len(surface) < 2:
                continue
            t.kinds[i:end] = "x" * (end - i)
            upto = end
            if take:
                found.append((start, stop, surface))
    return found


def extract(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The keys, mention_id from 1, start, stop, surface: a row a quantity."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for n, m in enumerate(mentions(t), 1):
                    at.append(i)
                    rows.append((n, *m))
            take = pa.array(at, pa.int64())
            cols = [b.column(i).take(take) for i in range(len(keys))]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            cols += [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "mention_id", "start", "stop", "surface"])

    # Texts without a digit have no quantity; they do not go to Python.
    rows = df.where(F.rlike(F.col(text), F.lit("[0-9]"))).select(*keys, text)
    return rows.mapInArrow(run, f"{kinds}, mention_id int, start int, stop int, surface string")
