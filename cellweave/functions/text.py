"""Tokens, phrases, blocks and stems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Function words left out of contexts; every function here takes another list.
STOP_WORDS = (
    "a about after all an and any are as at be been before but by can do for from had has have he her his how i if in"
    " into is it its more most no not of on one or our out over she so some than that the their them then there these"
    " they this to under up was we were what when which who will with would you your"
).split()
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
TOKEN_BREAK = r"[\s.,?;()\"'!]+"
WORD_BREAK = r"[.,:?;/()\[\]\"'\-!&\s%$#\\]+"


def squeeze(text) -> Column:
    """Cell text: lower case, white space runs to one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text) -> Column:
    """Lower-case tokens, empty ones at the edges included."""
    return F.split(F.lower(text), TOKEN_BREAK)


def content_tokens(text, stop=STOP_WORDS) -> Column:
    return F.filter(tokens(text), lambda t: (t != "") & ~t.isin(*stop))


def content_words(text, stop=STOP_WORDS) -> Column:
    """Words by the wide delimiter class without stop words and single characters."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def word_set(text, stop=STOP_WORDS) -> Column:
    return F.array_sort(F.array_distinct(content_words(text, stop)))


def drop_stop_words(words, stop=STOP_WORDS) -> Column:
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def phrases(text, stop=STOP_WORDS) -> Column:
    """Distinct pairs of neighbouring content tokens, sorted."""
    toks = F.split(F.lower(text), r"[\s.,?;()\"']")
    good = lambda t: (t != "") & ~t.isin(*stop)
    pairs = F.zip_with(
        toks, F.slice(toks, 2, F.greatest(F.size(toks), F.lit(1))), lambda a, b: F.when(b.isNotNull() & good(a) & good(b), F.concat(a, F.lit(" "), b))
    )
    return F.array_sort(F.array_distinct(F.filter(pairs, lambda p: p.isNotNull())))


def blocks(content) -> Column:
    """Blocks of a page's text: cut after a sentence end with a new line, or at blank lines; 2+ blanks are one."""
    cut = F.split(content, r"[.;]\s*\n|\n{2,}")
    return F.transform(cut, lambda b: F.trim(F.regexp_replace(b, r"[ \t]{2,}", " ")))


def block_admitted(block) -> Column:
    """100 to 1000 characters, at most four new lines, and some character that a number may have."""
    newlines = F.length(block) - F.length(F.replace(block, F.lit("\n"), F.lit("")))
    return F.length(block).between(100, 1000) & (newlines <= 4) & F.rlike(block, F.lit(r"[0-9%$.,\-]"))


def table_references(block) -> Column:
    return F.regexp_extract_all(block, F.lit(r"[tT]able\.? ?\d+(?:\.\d+)*"), F.lit(0))


def sentences(text) -> Column:
    """Sentence spans, array<struct<start, stop>>: a sentence ends at . ! or ? before white space, which it includes."""
    parts = F.split(text, r"(?<=[.!?]\s)(?=\S)")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p)).alias("at"),
        F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("stop"))).alias("out"),
    )
    return F.aggregate(parts, none, step)["out"]


# Suffix-stripping stemmer (Porter, 1980), written from the published rules.

_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _consonant(w, i) else "v" for i in range(len(w)))
    return sum(kinds[i : i + 2] == "vc" for i in range(len(kinds) - 1))


def _vowel(w: str) -> bool:
    return any(not _consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _consonant(w, len(w) - 3) and not _consonant(w, len(w) - 2) and _consonant(w, len(w) - 1) and w[-1] not in "wxy"


#: Suffix tables of the published rules (fixed values).
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and _vowel(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for s, r in sorted(rules, key=lambda x: -len(x[0])):
            if w.endswith(s):
                if _measure(w[: -len(s)]) > 0:
                    w = w[: -len(s)] + r
                break
    for s in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def _stem(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda w: None if w is None else known.get(w) or known.setdefault(w, porter(w)))


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """Stem of each word, in Arrow batches; repeated words are stemmed once a batch."""
    return _stem(words)


@F.pandas_udf(ArrayType(StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, porter(w)) for w in ws])
