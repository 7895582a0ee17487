"""Language identification by rank-order profiles.

A profile is the ``TOP`` most frequent n-grams of one to three letters, in order of frequency
(ties by code), words padded with a blank. A text's own profile, over its whole length, is compared
to each language's by out-of-place distance: the sum over its n-grams of the difference in rank, or
``TOP`` where the language's profile lacks one. The nearest language wins, ties by name.

Profiles are learned from a bounded sample: about ``SAMPLE`` documents of each language, by a hash
of doc_id, each counted in the executors; only counts of n-grams reach the driver, at most
``KEPT`` of a language.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is all text
when nothing was learned; null languages and null doc_ids teach nothing; repeated rows are rows of
their own, with equal predictions; beyond ``MAX_LANGUAGES`` languages, the largest by documents (then
by name) are learned, as profiles are held in memory; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import table
from cellweave.llm.toxicity import held_out

SAMPLE = 2000
TOP = 400
KEPT = 2000
MAX_LANGUAGES = 10_000
#: Bits of a letter in an n-gram's code; letters are numbered by code point modulo 2**21.
SHIFT = 21
CHUNK = 1 << 18

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text and how often each occurs, by code."""
    total: dict[int, int] = {}
    codes = counts = np.zeros(0, np.int64)
    text = (text or "").lower()
    end = 0
    while (at := end) < len(text):
        # A piece ends before a character that is no letter, which words are cut at anyway.
        end = at + CHUNK
        while end < len(text) and text[end].isalpha():
            end += 1
        a = np.frombuffer((" " + text[at:end] + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        a = np.where(_letters()[a], a, 0)
        a = a[(a != 0) | np.append(True, a[:-1] != 0)]
        one = a[a != 0]
        two = (a[:-1] << SHIFT) | a[1:]
        three = (a[:-2] << 2 * SHIFT) | (a[1:-1] << SHIFT) | a[2:]
        # An n-gram has its length in its number of non-blank places; blank-only ones do not occur.
        codes, counts = np.unique(np.concatenate([one, two | (1 << 62), three[a[1:-1] != 0]]), return_counts=True)
        if len(text) > CHUNK:
            for c, n in zip(codes.tolist(), counts.tolist()):
                total[c] = total.get(c, 0) + n
    if total:
        codes = np.array(sorted(total), np.int64)
        counts = np.array([total[c] for c in codes.tolist()], np.int64)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The TOP codes by falling count, ties by code."""
    if len(counts) > TOP:
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:TOP]


class Profiles:
    def __init__(self, counts: dict[str, list[tuple[int, int]]]):
        self.names = sorted(counts)
        own = [ranked(*(np.array(x, np.int64) for x in zip(*sorted(counts[n])))) for n in self.names]
        self.known = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        self.ranks = np.full((len(own), len(self.known) + 1), -1, np.int64)
        for i, o in enumerate(own):
            self.ranks[i, np.searchsorted(self.known, o)] = np.arange(len(o))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.names:
            return "und", 0.0
        top = ranked(codes, counts)
        at = np.searchsorted(self.known, top)
        at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] != top)] = len(self.known)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, TOP, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(away))
        near = 1 - away / (TOP * len(top))
        total = near.sum()
        return self.names[best], float(near[best] / total) if total > 0 else 1 / len(self.names)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[str, dict[int, int]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = sums.setdefault(lang, {})
            for c, n in zip(*(x.tolist() for x in grams(text))):
                own[c] = own.get(c, 0) + n
        flat = [(k, c, n) for k, own in sums.items() for c, n in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["lang", "code", "n"]
        )


def learn(docs: DataFrame) -> Profiles:
    rows = docs.where("lang is not null and text is not null").where(~held_out(4, 2))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(MAX_LANGUAGES).collect()
    known = docs.sparkSession.createDataFrame([(r["lang"], r["size"]) for r in sizes], "lang string, size long")
    picked = rows.select("doc_id", "lang", "text").join(F.broadcast(known), "lang").where(
        F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1_000_000)) < F.lit(1_000_000) * SAMPLE / F.col("size")
    )
    counts = picked.select("lang", "text").mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= KEPT).collect()
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        found.setdefault(r.lang, []).append((r.code, r.n))
    return Profiles(found)


def identified(docs: DataFrame, profiles: Profiles) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out(4, 2).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, learn(docs))
