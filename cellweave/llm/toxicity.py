"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic, one on ordinary text.

A text is cut into windows of ``WINDOW`` words. Zstandard finds no use in repeats as short as one
word, so a window is compressed as a stream of ``CODE`` bytes per character: a code of the
``GRAM`` characters that start there. A word that a dictionary knows is then one match, a word
that it does not know is many literals. A window's margin is its length under the ordinary dictionary less that under the toxic one.
Margins beyond thresholds are summed over all windows of the whole text; a logistic curve turns the
sums, per window and per root of windows, and the largest margin into a score, shifted so that 0.5 is
the F measure that weighs precision twice is best. Thresholds (quantiles of ordinary windows) and curve are calibrated on the half of
the sample that trained no dictionary.

The classifier is fitted on a bounded sample: about ``SAMPLE`` documents of each class, taken by a
hash of doc_id, of at most ``MAX_CHARS`` characters each (longer labelled texts teach nothing, which
bounds the driver's memory). Every document is scored whole, in pieces that end between windows.

Defined cases: null and empty texts are scored as texts without windows; doc_ids labelled twice
take the larger label; of rows that share a labelled doc_id the greatest text teaches; null doc_ids
and null labels teach nothing; without labels of both classes every score is 0; other columns, of any
name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import table

SAMPLE = 2500
MAX_CHARS = 30_000
WINDOW = 2
GRAM = 4
CODE = 4
#: Dictionary sizes: toxic, ordinary.
SIZES = (60_000, 400_000)
TRAIN_WINDOWS = 60_000
LEVEL = 3
QUANTILES = (0.97, 0.99, 0.997)
FOLDS = 5
#: Least number of documents of each class to fit on.
LEAST = 8
#: Characters coded at once, so that memory does not follow the longest text.
CHUNK = 1 << 18


def _codes(text: str) -> tuple[bytes, np.ndarray]:
    """The stream of codes of a lower-case text with a blank before it, and where words start in it."""
    a = np.frombuffer((" " + text + " " * GRAM).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    a[a < 32] = 32
    n = len(a) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h * np.uint64(1_000_003)) ^ a[k : k + n]
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    space = a[:n] <= 32
    return h.astype(np.uint32).tobytes(), np.flatnonzero(space & ~np.append(a[1:n] <= 32, True))


def windows(text: str | None) -> Iterator[bytes]:
    """Streams of ``WINDOW`` words each, the text's last window shorter; none for wordless texts."""
    text = (text or "").lower()
    at, size = 0, CHUNK
    while at < len(text):
        last = at + size >= len(text)
        stream, starts = _codes(text[at : at + size])
        cuts = starts[::WINDOW].tolist()
        if last:
            cuts.append(len(stream) // CODE)
        elif len(cuts) > 2:
            cuts.pop()  # its word may go on beyond this piece
        elif starts.size:
            size *= 2
            continue
        for i, j in itertools.pairwise(cuts):
            yield stream[CODE * i : CODE * j]
        # The next piece starts with the first word that is in no window yet.
        at = len(text) if last else at + (cuts[-1] if cuts else size)


def _train(size: int, samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:  # too few samples to train on: their own bytes
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:].ljust(16, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Model:
    """Two dictionaries, margin thresholds and a logistic curve. Pickles as bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes, kinds: tuple[int, int]):
        self.parts, self.kinds = (ordinary, toxic), kinds
        self.thresholds = np.zeros(len(QUANTILES))
        self.mean = self.scale = self.weights = None
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def _compressors(self):
        if self._ready is None:
            self._ready = [
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=zstandard.ZstdCompressionDict(p, dict_type=k),
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                ).compress
                for p, k in zip(self.parts, self.kinds)
            ]
        return self._ready

    def margins(self, text: str | None) -> np.ndarray:
        ordinary, toxic = self._compressors()
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.float64)

    def features(self, m: np.ndarray) -> np.ndarray:
        """Of a text's margins."""
        n = len(m)
        over = [np.maximum(m - t, 0).sum() for t in self.thresholds]
        return np.array([*(np.log1p(100 * x / max(n, 1)) for x in over), *(np.log1p(x / np.sqrt(20 + n)) for x in over), m.max() if n else 0.0])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        x = (self.features(self.margins(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30))))

    def calibrate(self, margins: list[np.ndarray], labels: np.ndarray, ordinary_weight: float) -> None:
        """Fits thresholds and curve to texts' margins."""
        ordinary = [m for m, y in zip(margins, labels) if not y and len(m)]
        self.thresholds = np.quantile(np.concatenate(ordinary or [np.zeros(1)]), QUANTILES)
        x = np.array([self.features(m) for m in margins])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.hstack([np.ones((len(x), 1)), (x - self.mean) / self.scale])
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
        ridge[0] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - labels) + ridge * w)
        z = x @ w
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(labels[order])
        wrong = np.cumsum(1 - labels[order]) * ordinary_weight
        f = 1.25 * hits / (hits + wrong + 0.25 * labels.sum())
        best = int(np.argmax(f))
        nxt = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
        w[0] -= (z[order[best]] + nxt) / 2
        self.weights = w


def _trained(texts: dict[int, list[str]]) -> Model:
    """A model of two dictionaries, not calibrated yet."""
    found = {y: [w for t in texts[y] for w in windows(t)] for y in (0, 1)}
    ordinary = _train(SIZES[1], found[0][:: max(1, len(found[0]) // TRAIN_WINDOWS)][:TRAIN_WINDOWS])
    kind = lambda d: zstandard.DICT_TYPE_AUTO if d.dict_id() else zstandard.DICT_TYPE_RAWCONTENT
    toxic = _train(SIZES[0], found[1][:: max(1, len(found[1]) // TRAIN_WINDOWS)][:TRAIN_WINDOWS])
    return Model(toxic.as_bytes(), ordinary.as_bytes(), (kind(ordinary), kind(toxic)))


def fit(rows: list[tuple[int, str, int]], ordinary_weight: float = 1.0) -> Model:
    """Fits on (doc_id, text, label) rows: one half trains the dictionaries, the other calibrates.

    ``ordinary_weight``: how many ordinary documents of the corpus each ordinary row stands for,
    against one toxic document for each toxic row.
    """
    rows = sorted(rows, key=lambda r: (_crc(r[1]), r[1]))
    texts = {y: [t for _, t, label in rows if label == y] for y in (0, 1)}
    if min(len(t) for t in texts.values()) < LEAST:
        return Model(b"\0" * 16, b"\0" * 16, (zstandard.DICT_TYPE_RAWCONTENT,) * 2)
    model = _trained({y: t[0::2] for y, t in texts.items()})
    rest = [(t, y) for y in (0, 1) for t in texts[y][1::2]]
    model.calibrate([model.margins(t) for t, _ in rest], np.array([y for _, y in rest], float), ordinary_weight)
    return model


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def held_out(folds: int = FOLDS, which: int = 0) -> Column:
    """crc32 of doc_id as text; a null doc_id is held out of learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == which, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """About SAMPLE learning rows of each class: (doc_id, text, toxic); and the classes' sizes."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.where(~held_out())
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y in (0, 1):
        share = F.when(F.col("toxic") == y, min(1.0, SAMPLE / counts[y]) if counts.get(y) else 0.0).otherwise(share)
    picked = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < share * 1_000_000)
    # A hash picks SAMPLE of each class within a few hundredths; the order makes the bound exact.
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(4)), "doc_id").limit(4 * SAMPLE)
    rows = docs.select("doc_id", "text").where(F.length("text") <= MAX_CHARS).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), counts


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    sample, sizes = labelled_sample(docs, labels)
    rows = [(r.doc_id, r.text, r.toxic) for r in sample.collect()]
    took = {y: sum(r[2] == y for r in rows) for y in (0, 1)}
    weight = (sizes.get(0, 1) / max(took[0], 1)) / (sizes.get(1, 1) / max(took[1], 1))
    return fit(rows, weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([model.score(t.as_py()) for t in b.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), scores], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels")))
