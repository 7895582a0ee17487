"""Quality rules, line dedup, decontamination, SimHash and mixing against brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from cellweave.llm import decontaminate, linededup, mixing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def frame(spark, rows):
    """Documents with an extra column whose name the operators also use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["ab", "cd", "ef", "gh", "#x", "É&t", "Ij", "kl|"]
    out = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120)))) for i in range(60)]
    out += [(100 + i, "\n".join(rnd.choice(["a b c", "a b", " ", "", "d e f g"]) for _ in range(9))) for i in range(20)]
    return out + [(200, None), (201, ""), (None, "one two three one two three"), (203, "x\t\ny\r\n x"), (203, "x\t\ny\r\n x"), (204, "w " * 30000)]


def base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_base_statistics_match_brute_force(spark, texts):
    got = quality.verdicts(frame(spark, texts)).select("doc_id", *quality.STATS, "base_failed", "kept").collect()
    want = [(i, *base(t)) for i, t in texts]
    assert Counter(tuple(r[:6]) for r in got) == Counter(want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    clean = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(60, 300)))) for i in range(300)]
    odd = [(1000 + i, " ".join(rnd.choice(vocabulary) + "###" for _ in range(100))) for i in range(20)]
    kept = {r.doc_id for r in quality.keep_good(frame(spark, clean + odd)).collect()}
    assert not kept & {i for i, _ in odd}
    assert len(kept) >= 299


def test_quality_quantiles():
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality.chi2_cdf(4.3515, 5) - 0.5) < 1e-4


def test_quality_empty_table(spark):
    assert quality.verdicts(frame(spark, [])).count() == 0


def records_of(line):
    """Records by counting words: a sentence of ten words or more ends one, with one white space after it."""
    out, begin, run, at = [], 0, 0, 0
    while m := re.compile(r"[^\x20\x09-\x0D]+").search(line, at):
        at = m.end()
        run += 1
        if line[at - 1] in ".!?" and at < len(line):
            if run >= 10:
                out.append(line[begin : at + 1])
                begin = at + 1
            run = 0
    return [*out, line[begin:]]


def paths_of(t):
    n = len(t)
    if n < 15:
        return [("all", n, *t)]
    if n < 20:
        a, b = n // 3, 2 * n // 3
        return [("to", n, *t[:b]), ("from", n, *t[a:]), ("around", n, *t[:a], "|", *t[b:])]
    a, b, c = n // 4, n // 2, 3 * n // 4
    return [("first", n, *t[:b]), ("last", n, *t[b:]), ("middle", n, *t[a:c]), ("outer", n, *t[:a], "|", *t[c:])]


def dedup_brute(rows):
    """Templates of each record, by Python; first ids keep theirs."""
    ids, found = defaultdict(set), []
    own = [-(2**63) if i is None else i for i, _ in rows]
    cut = [[records_of(line) for line in t.split("\n")] if t is not None else [] for _, t in rows]
    for n, lines in enumerate(cut):
        for k, line in enumerate(lines):
            for j, record in enumerate(line):
                toks = ["<*>" if re.search("[0-9]", w) else w for w in re.split(r"[\x20\x09-\x0D]+", record) if w]
                for key in paths_of(toks) if toks else []:
                    ids[key].add(own[n])
                    found.append((n, k, j, key))
    gone = {(n, k, j) for n, k, j, key in found if len(ids[key]) >= (10 if key[1] < 10 else 2) and min(ids[key]) != own[n]}
    out = []
    for n, (i, t) in enumerate(rows):
        lines = []
        for k, line in enumerate(cut[n]):
            kept = "".join(r for j, r in enumerate(line) if (n, k, j) not in gone)
            if kept.strip("\x20\t\n\x0b\x0c\r") or not any((n, k, j) in gone for j in range(len(line))):
                lines.append(kept)
        out.append((i, t if t is None else "\n".join(lines)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(3)
    words = LONG.split()
    long = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    sixteen, thirty = long(16), long(30)
    pool = [LONG, LONG + " 17", LONG + " 23 x9", LONG.replace("delta", "other"), "short line", "two  spaces\there", "", " ", LONG[:-2] + "nu", "Page 7 of 9"]
    pool += [sixteen, thirty, f"One two. {thirty}. Three four.", f"{thirty}! {sixteen}? end", f" {sixteen}.  {thirty}.\t", "\r" + thirty + ".\r"]
    edit = lambda s: " ".join(rnd.choice(words) if rnd.random() < 0.08 else w for w in s.split(" "))
    rows = [(i, "\n".join(edit(rnd.choice(pool + [f"own line number {c} of {i} " + chr(97 + i % 26) * 3])) for c in range(rnd.randint(1, 8)))) for i in range(60)]
    rows += [(None, LONG), (50, None), (51, ""), (52, LONG + "\n" + LONG), (52, LONG + "\n" + LONG)]
    rows += [(70, "w" * 200_000 + ". " + "no end " * 60_000), (71, "é. " * 50_000 + thirty), (72, "... " * 30 + sixteen)]
    got = linededup.drop_recurring_lines(frame(spark, rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(dedup_brute(rows))


def test_line_dedup_generalises_separate_fields(spark):
    """An early and a late field, a leading one, and a passage inside lines of different length."""
    form = "dear {} we thank you most warmly for the order that you have placed with our shop on the day of {}"
    passage = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" + ("." if i % 14 == 13 else "") for i in range(56))
    rows = [(1, form.format("Ann", "Monday")), (2, form.format("Bob", "Friday")), (3, form.replace("dear", "good").format("Cy", "Sunday"))]
    rows += [(4, f"Quite some own words here. {passage} And more that nobody else has."), (5, f"Another start of five. {passage} Own end of the other text."), (6, form.replace("order", "car").replace("thank", "ask").replace("shop", "yard").format("Al", "May"))]
    out = {r.doc_id: r.text for r in linededup.drop_recurring_lines(frame(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[4] == rows[3][1] and out[6] == rows[5][1]
    assert out[2] == out[3] == ""
    assert out[5].split() == ["Another", "start", "of", "five.", *passage.split()[:14], *"Own end of the other text.".split()]


def test_line_dedup_of_text_ids_and_clashing_columns(spark):
    names = ["id", "th", "line_no", "k", "n", "first", "dropped", "n_lines", "_x0", "_X1", "a.b"]
    docs = spark.createDataFrame([(f"d{i}", LONG, *range(len(names))) for i in range(3)] + [(None, LONG, *range(len(names)))], ["doc_id", "text", *names])
    out = linededup.drop_recurring_lines(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {(d, t, *range(len(names))) for d, t in [("d0", ""), ("d1", ""), ("d2", ""), (None, LONG)]}


def test_line_dedup_keeps_columns_and_rows(spark):
    out = linededup.drop_recurring_lines(frame(spark, [(1, LONG), (2, LONG + "\nown words here")]))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, LONG, len(LONG)), (2, "own words here", 14)}
    assert linededup.drop_recurring_lines(frame(spark, [])).count() == 0


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination_brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = terms(t), set(), set()
        for item, text in items:
            x = terms(text)
            n = min(10, len(x))
            wins = {tuple(x[s : s + n]) for s in range(len(x) - n + 1)} if x else set()
            for s in range(len(w) - n + 1 if x else 0):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(9)
    words = ["the", "of", "To", "été", "É1", "and", "x", "y", "z", "Ab", "c3"]
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 9, 10, 11, 30, 14, 25])] + [(90, ""), (91, None), (5, "zz top")]
    docs = []
    for i in range(60):
        parts = [rnd.choice(words + ["noise", "more-noise"]) for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            parts[len(parts) // 2 : len(parts) // 2] = re.sub(" ", ", ", rnd.choice(items[3:8])[1]).split(" ")
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (None, items[5][1]), (103, items[5][1]), (103, items[5][1]), (103, "other " + items[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame(spark, docs), bench)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert Counter(map(tuple, got)) == Counter(contamination_brute(docs, items))
    clean = decontaminate.drop_contaminated(frame(spark, docs), bench)
    assert clean.count() == sum(not r[5] for r in contamination_brute(docs, items))


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, [(1, "a b"), (2, None)]), none).where("contaminated").count() == 0
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_proximity(spark):
    item = spark.createDataFrame([(1, "quark gluon lepton")], "item_id long, text string")
    docs = [(1, "the lepton and the gluon or quark"), (2, "quark " + "x " * 50 + "gluon lepton"), (3, "quark gluon")]
    index = decontaminate.Index(frame(spark, docs), decontaminate.windows(item))
    assert {r.doc_id for r in index.proximity(8).collect()} == {1}
    assert {r.doc_id for r in index.proximity(60).collect()} == {1, 2}


def fingerprint_brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints(spark):
    texts = ["", None, "one", "Two words", "É a B c", "a\x0bb\x1cc d\x85e f", "x y z " * 40000, "word " * 3]
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: fingerprint_brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("tile", [4096, 7])
def test_components_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = random.Random(2)
    fps = [rnd.getrandbits(64) for _ in range(30)]
    for f in list(fps):
        for _ in range(rnd.randint(0, 4)):
            for _ in range(rnd.randint(1, 4)):
                f ^= 1 << rnd.randrange(64)
            fps.append(f)
    fps += [0, 3, 2**64 - 1, 2**63]
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    groups = lambda of: Counter(frozenset(g) for g in _groups(of).values())
    assert groups({f: got.get(f, f) for f in fps}) == groups({f: find(f) for f in fps})


def _groups(of):
    out = defaultdict(set)
    for k, v in of.items():
        out[v].add(k)
    return out


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {tuple(r) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_keep_one(spark):
    rows = [(3, LONG), (2, LONG), (2, LONG), (None, LONG), (7, None), (8, ""), (None, "only this text has no id"), (9, "another text altogether")]
    kept = simhash.keep_one(frame(spark, rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter([(2, LONG), (7, None), (None, "only this text has no id"), (9, "another text altogether")])
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_targets():
    t = mixing.targets([100, 1000, 10, 500, 0], [5, 2, 1, 5, 2])
    assert abs(sum(t) - 1610) < 1e-6 and t[0] == 300 and t[4] == 0
    assert all(x <= 3 * s + 1e-9 for x, s in zip(t, [100, 1000, 10, 500, 0]))
    assert abs(t[3] / t[1] - 2.5) < 1e-9


def test_splitting_tree_gives_disjoint_whole_quotas():
    import numpy as np

    quotas = np.array([7, 0, 100, 1])
    parts = [mixing.splits(quotas, 5, leaf) for leaf in range(5)]
    assert sum(q for q, _ in parts).tolist() == quotas.tolist()
    for s in range(4):
        seen = [x for q, st in parts for x in range(st[s], st[s] + q[s])]
        assert sorted(seen) == list(range(quotas[s]))
    assert max(q.sum() for q, _ in parts) - min(q.sum() for q, _ in parts) <= 1


@pytest.mark.parametrize("words", [200_000, 300])
def test_mix_meets_targets_and_agrees(spark, monkeypatch, words):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", words)
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(0, 60), "en", rnd.choice(["a", "a", "a", "b", "c", None]), 0, "x") for i in range(600)]
    rows += [(900, None, None, "d", None, None), (901, "v " * 9, None, "a", None, None), (901, "v " * 9, None, "a", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = mixing.mix(docs).collect()
    assert len(first) == len(rows)
    taken, target = Counter(), {}
    source = {(r[0], r[3]) for r in rows}
    of = dict((i, s) for i, s in source)
    for r in first:
        assert 0 <= r.copies <= 3 and all(x.shard < mixing.MIN_SHARDS for x in r.draws)
        taken[of[r.doc_id]] += r.size * r.copies
        target[of[r.doc_id]] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= 10, (s, taken[s], t)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(str, first)) == Counter(map(str, again))
    out = mixing.mixed(docs)
    assert out.count() == sum(r.copies for r in first)
    assert out.columns[: len(docs.columns)] == docs.columns


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None), (2, "")])).count() == 2


def distances(spark, vectors):
    """Squared distances of one group of vectors, in deviations."""
    rows = [(i, 1, *(round(v * quality.SCALE) for v in x)) for i, x in enumerate(vectors)]
    stats = spark.createDataFrame(rows, "doc_id long, grp long, " + ", ".join(f"{n} long" for n in quality.DIMS))
    return {r.doc_id: r.d2 for r in quality._distance(stats.join(quality.fit(stats, 1), "grp")).collect()}


@pytest.mark.parametrize("share", [0.2])
def test_quality_withstands_a_tight_cluster(spark, share):
    rnd = random.Random(8)
    bad = int(share * 1000)
    cluster = [[rnd.gauss(m, 0.1) for m in (0, 0, 0, 9, 7)] for _ in range(bad)]
    d2 = distances(spark, cluster + [[rnd.gauss(0, 1) for _ in quality.DIMS] for _ in range(bad, 1000)])
    assert all(d2[i] > quality.CUTOFF for i in range(bad))
    assert sum(d2[i] <= quality.CUTOFF for i in range(bad, 1000)) >= 0.99 * (1000 - bad)
    assert 3 < sorted(d2.values())[(1000 + bad) // 2] < 9


def test_quality_rejects_by_covariance_what_each_statistic_allows(spark):
    rnd = random.Random(9)
    clean = []
    for _ in range(500):
        a = rnd.gauss(0, 1)
        clean.append([rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1), a, -a + rnd.gauss(0, 0.2)])
    odd = [[0, 0, 0, 2, 2], [0, 0, 0, -2, -2]]
    d2 = distances(spark, odd + clean)
    assert min(d2[0], d2[1]) > quality.CUTOFF > 8  # 8 without covariances
    assert sum(d2[i] <= quality.CUTOFF for i in range(2, 502)) == 500


def test_quality_of_hard_columns(spark):
    """Clashing names, null languages, a statistic that no document varies in."""
    rnd = random.Random(10)
    text = lambda i: " ".join(chr(97 + rnd.randrange(26)) * rnd.randint(1, 5) for _ in range(60 + i))
    docs = spark.createDataFrame([(i, text(i), None, None, i, i, i, i) for i in range(90)], "doc_id long, text string, lang string, source string, grp long, th long, _h long, `a.b` long")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(90))


def test_stages_pass_on_columns_of_any_name_and_text_ids(spark):
    names = ["_h", "_id", "_th", "_d", "_t", "_x0", "_X1", "th", "id", "dropped", "n_lines", "mix_copy", "draws", "i", "o", "place", "root", "fp", "a.b", "term"]
    texts = [LONG, LONG.upper(), "quark gluon lepton " * 9, None, "", "pion kaon " * 40]
    rows = [(f"d{k}", t, "en", "s", *range(len(names))) for k, t in enumerate(texts)] + [("d0", LONG, "en", "s", *range(len(names)))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    items = spark.createDataFrame([("q", "gluon lepton quark")], "item_id string, text string")
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {"d0", "d2", "d3", "d5"}
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == ["d0", "d0", "d1", "d3", "d4", "d5"]
    mix = mixing.mixed(docs)
    assert mix.columns == [*(c for c in docs.columns if c != "mix_copy"), "mix_copy", "mix_shard", "mix_place"]
    assert all(r._h == 0 and r["a.b"] == names.index("a.b") for r in mix.collect())


def test_written_tables_are_released(spark):
    import os

    from cellweave.llm import common

    t = common.written(spark.range(3), "t")
    path = t._written.removeprefix("file:")
    assert os.path.isdir(path)
    common.released(t)
    assert not os.path.exists(path)
