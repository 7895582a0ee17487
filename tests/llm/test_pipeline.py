"""The corpus pipeline against brute force, stage by stage and as a whole."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_native_ops import base, contamination_brute, dedup_brute, fingerprint_brute

import corpus_pipeline
from cellweave.llm import mixing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rnd = random.Random(7)
    words = ["".join(rnd.choice(["ta", "ro", "mi", "ne", "su", "lo", "ka"]) for _ in range(rnd.randint(1, 4))) for _ in range(900)]
    prose = lambda n: "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(8, 30))) for _ in range(n))
    items = [(k, prose(2)) for k in range(4)]
    rows = []
    for i in range(260):
        text = prose(rnd.randint(3, 9))
        if i % 20 == 3:
            text = " ".join(w + "###" for w in text.split(" "))
        if i % 20 == 5:
            text = "A Licence of exactly ten words stands at the very top here\n" + text
        if i % 20 == 7:
            text += "\n" + items[i % 4][1]
        if i % 20 == 9:
            text = rows[i - 1][1]
        if i % 20 == 11:
            text = "too short"
        rows.append((i, text, "aa" if i % 3 else "bb", f"s{i % 4}" if i % 50 else None, len(text)))
    return [*rows, (900, None, None, None, None), (901, "", "aa", "s1", 0)], items


def guarded_cov(c):
    """The covariance with each dimension's deviation beside those before it at least FLOOR."""
    low = np.zeros_like(c)
    for i in range(len(c)):
        for j in range(i + 1):
            v = c[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = math.sqrt(max(v, quality.FLOOR**2)) if i == j else v / low[j, j]
    return low @ low.T


def quality_brute(rows):
    """Minimum-covariance-determinant verdicts with numpy, each start run far beyond convergence: kept row numbers."""
    rounded = lambda v: np.sign(v) * np.floor(np.abs(v) + 0.5)
    stats = []
    for _, t, lang, source, _ in rows:
        n, chars, _, _, repeat = base(t)
        t = t or ""
        words = t.split()
        marks = sum(not c.isalnum() for w in words for c in w)
        x = [0.0] * 5 if not n else [math.log(chars / n), math.sqrt(sum(c.isupper() for c in t) / chars), math.sqrt(marks / chars), math.log(len(set(words)) / n), math.log(n)]
        stats.append((rounded(np.array(x) * quality.RAW), n >= 50 and 100 * repeat <= 50 * n, lang, source, n))
    size = Counter((s[2], s[3]) for s in stats if s[1])
    pool = Counter()
    for (lang, _), n in size.items():
        pool[lang] += n if n < quality.MIN_GROUP else 0
    group = lambda s: (s[2], s[3]) if size[s[2], s[3]] >= quality.MIN_GROUP else ((s[2],) if pool[s[2]] >= quality.MIN_GROUP else ())
    members = defaultdict(list)
    for i, s in enumerate(stats):
        if s[1]:
            members[group(s)].append(i)
    kept = set()
    for rows_of in members.values():
        x = np.array([stats[i][0] for i in rows_of])
        n = np.array([stats[i][4] for i in rows_of])
        y = rounded((x - np.median(x, axis=0)) * np.sqrt(n / (n + quality.STEADY))[:, None])
        mad = np.median(np.abs(y), axis=0) * 1.4826
        rms = np.sqrt((y**2).sum(axis=0) / np.maximum((y != 0).sum(axis=0), 1))
        z = rounded(y / np.where(mad > 0, mad, np.where(rms > 0, rms, 1)) * quality.SCALE) / quality.SCALE
        signs = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
        starts = [(z.mean(axis=0), np.cov(z.T, bias=True)), (np.zeros(5), np.eye(5)), (np.zeros(5), np.tanh(z).T @ np.tanh(z) / len(z)), (np.zeros(5), 5 * signs.T @ signs / len(z))]
        best = None
        for mu, cov in starts:
            for _ in range(60):
                cov = guarded_cov(cov)
                d2 = np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov), z - mu)
                bins = np.maximum(-400, np.floor(np.log(d2 + 1e-9) * quality.BINS_PER_E))
                near = np.array([(bins < b).sum() for b in bins]) < quality.ALPHA * len(z)
                mu, cov = z[near].mean(axis=0), np.cov(z[near].T, bias=True) * quality.CONSISTENCY
            cov = guarded_cov(cov)
            if best is None or np.linalg.slogdet(cov)[1] < best[0] - 1e-6:
                best = np.linalg.slogdet(cov)[1], np.einsum("ij,jk,ik->i", z - mu, np.linalg.inv(cov), z - mu)
        kept |= {i for i, d in zip(rows_of, best[1]) if len(z) < quality.MIN_GROUP or d <= quality.CUTOFF}
    return kept


def components_brute(rows):
    fps = [fingerprint_brute(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return {min(g) for g in groups.values()}


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, items = corpus()
    d = tmp_path_factory.mktemp("corpus")
    pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(COLUMNS)}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), d / "benchmark.parquet")
    return rows, items, str(d)


def test_each_stage_and_the_whole(spark, case):
    rows, items, d = case
    docs = spark.read.parquet(f"{d}/documents.parquet")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        steps.append((name, docs.columns, docs.collect()))
        docs = spark.createDataFrame(steps[-1][2], docs.schema)
    assert [s[0] for s in steps] == ["quality rules", "line dedup", "near dedup", "decontamination", "mixing"]
    assert all(s[1] == COLUMNS for s in steps[:4])
    plain = [Counter((r.doc_id, r.text) for r in s[2]) for s in steps]

    now = [rows[i] for i in sorted(quality_brute(rows))]
    assert 200 < len(now) < 250 and plain[0] == Counter((r[0], r[1]) for r in now)
    now = [(i, t) for i, t in dedup_brute([(r[0], r[1]) for r in now])]
    assert plain[1] == Counter(now) and any("Licence" in (r[1] or "") for r in rows)
    stay = components_brute(now)
    now = [r for r in now if r[0] in stay]
    assert plain[2] == Counter(now)
    bad = {r[0] for r in contamination_brute(now, items) if r[5]}
    now = [r for r in now if r[0] not in bad]
    assert bad and plain[3] == Counter(now)

    source = {r[0]: r[3] for r in rows}
    size, taken = Counter(), Counter()
    for i, t in now:
        size[source[i]] += len((t or "").split())
    for r in steps[4][2]:
        assert (r.doc_id, r.text) in plain[3]
        taken[source[r.doc_id]] += len((r.text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.targets([size[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])
    longest = max(len((t or "").split()) for _, t in now)
    assert all(abs(taken[s] - w) <= longest for s, w in zip(order, want))

    whole = corpus_pipeline.run(spark, d)
    assert Counter((r.doc_id, r.text) for r in whole.collect()) == plain[4]


def test_an_empty_corpus(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "n_chars": pa.array([], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": ["a b c"]}), tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
