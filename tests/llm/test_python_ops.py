"""Page text, secrets, toxicity, language and token counts."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from cellweave.llm import language, pagetext, secrets, tokencount, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, score string"


def docs_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", "x") for i, t in enumerate(texts)], DOCS)


def text_of(html):
    return pagetext.text_without(html)


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple &#233;\n\t x", "plain & simple é x"),
        ("<article><h1>T</h1><p>a <b>b</b>c<br>d</p></article><p>not this</p>", "T a bc d"),
        ("<body><nav>menu</nav><p>one<p>two<footer>f</footer></body>", "one two"),
        ("<p>a<script>if (x < 1) { '</p>' }</script>b</p><style>p{}</style><!-- c <p> -->", "ab"),
        ("<div class='ad-box'>buy</div><div class='add'>keep</div><form>f</form><aside>s</aside>", "keep"),
        ("<article>x<section class=comments>c</section><ul><li>1<li>2</ul></article>", "x 1 2"),
        ("<article><p><b>open<br><p>next</article><footer>f", "open next"),
        ("<div title='a > b'>q</div><img src=x>r", "q r"),
        ("<article>&amp;lt; &lt;b&gt;</article>", "&lt; <b>"),
        ("<p>unclosed <", "unclosed <"),
        ("<article><header><h1>H</h1></header>body</article><header>site</header>", "H body"),
        ("<div role=navigation>n</div><main>m</main>", "m"),
    ],
)
def test_segments(html, text):
    assert text_of(html) == text


def test_templates_are_counted_per_host(spark):
    page = lambda i, extra: f"<html><body><div><span>Follow our channel</span></div><div><p>own {i} text</p></div>{extra}</body></html>"
    rows = [(i, f"http://a.example/{i}", page(i, "")) for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", page(i, "<p>kept</p>")) for i in range(2)]
    rows += [(200, None, None), (201, "nohost", ""), (201, "nohost", "")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in pagetext.main_text(pages).collect()}
    assert pagetext.main_text(pages).count() == len(rows)
    assert all(got[i] == (f"own {i} text", len(f"own {i} text")) for i in range(30))
    assert got[100] == ("Follow our channel own 0 text kept", 34) and got[200] == ("", 0)
    assert pagetext.main_text(pages.limit(0)).count() == 0


def test_copied_articles_stay(spark):
    rows = [(i, f"http://a.example/{i}", "<nav>n</nav><article><p>the same words</p></article>", "x") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    assert {r.text for r in pagetext.main_text(pages).collect()} == {"the same words"}


def words_of(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_templates_inside_articles_and_text_beside_them(spark):
    rnd = random.Random(9)
    own, side = [words_of(rnd, 30) for _ in range(30)], [words_of(rnd, 30) for _ in range(30)]
    promo = "Read more of this in our weekly paper"
    page = lambda i: f"<body><article><h1>Note</h1><p>{own[i]}</p><ul><li>{promo}</ul><p>{promo}.</p></article><div>{side[i]}</div><div>every page</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i), "x") for i in range(30)]
    copy = words_of(rnd, 200).split(" ")
    for i in range(30):
        rows.append((100 + i, f"http://b.example/{i}", f"<article><p>{' '.join(copy)}</p><p>{own[0]}{i}</p></article>", "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in pagetext.main_text(pages).collect()}
    assert all(got[i] == f"Note {own[i]} {side[i]}" for i in range(30))
    # Nearly copied articles keep what they share.
    assert all(got[100 + i] == f"{' '.join(copy)} {own[0]}{i}" for i in range(30))


@pytest.mark.parametrize("most", [1_000, 0])
def test_templates_do_not_depend_on_the_size_of_the_host(spark, monkeypatch, most):
    monkeypatch.setattr(pagetext, "MAX_LIST", most)
    rnd = random.Random(11)
    own = [words_of(rnd, 12) for _ in range(600)]
    banner = "<div>Section of the day</div>"
    page = lambda i: f"<body>{banner if i < 6 else ''}<article>{banner if 6 <= i < 12 else ''}<p>{own[i]}</p></article></body>"
    rows = [(i, f"http://a.example/{i}", page(i), "x") for i in range(600)] + [(9, "http://c.example/", "<article>one</article>two", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r.text for r in pagetext.main_text(pages).collect()}
    assert got == {(i, f"http://a.example/{i}"): own[i] for i in range(600)} | {(9, "http://c.example/"): "one"}


def test_templates_alone_take_what_surrounds_the_text(spark):
    """No names, no article, no rules: only recurrence tells menus, alternating adverts and footers from text."""
    rnd = random.Random(12)
    own = [words_of(rnd, 40) for _ in range(60)]
    adverts = [words_of(rnd, 6) for _ in range(7)]
    page = lambda i: f"<body><div><a href=/{i}>Home</a> <a href=/x{i}>News</a></div><div>{adverts[i * i % 7]}</div><div><p>{own[i]}</p></div><div>Since 1999</div></body>"
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page(i), "x") for i in range(60)], "page_id long, url string, html string, host string")
    found = {r.h for r in pagetext.templates(pages).collect() if r.h is not None}
    assert all(pagetext.text_without(page(i), found, True, rules=False) == own[i] for i in range(60))
    assert all(pagetext.text_without(page(i), set(), True, rules=False) != own[i] for i in range(60))
    assert {r.page_id: r.text for r in pagetext.main_text(pages).collect()} == dict(enumerate(own))


def test_a_line_that_some_articles_share_stays(spark):
    rnd = random.Random(13)
    own = [words_of(rnd, 30) for _ in range(40)]
    shared = "By the river at the old mill"
    page = lambda i: f"<article><p>{own[i]}</p>{f'<p>{shared}</p>' if i % 4 == 0 else ''}</article>"
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", page(i), "x") for i in range(40)], "page_id long, url string, html string, host string")
    assert {r.page_id: r.text for r in pagetext.main_text(pages).collect()} == {i: own[i] + f" {shared}" * (i % 4 == 0) for i in range(40)}


@pytest.mark.parametrize("html,text", [("<div>" * 50_000 + "deep", "deep"), ("<b><p>" * 20_000 + "deep", "deep"), ('<i x="' * 30_000 + ">end", "end"), ("<i x='b>" * 20_001 + "end", "end"), ("<template>" * 20_000 + "end", "end"), ("<" * 100_000, "<" * 100_000), ("<!--" * 50_000, ""), ("\u0130" * 12 + "<script>s</script>Hello <SCRIPT>t</Script >world", "\u0130" * 12 + "Hello world"), ("w " * 300_000, ("w " * 300_000)[:-1])])
def test_hostile_pages_are_parsed_in_linear_time(html, text):
    started = time.process_time()
    assert text_of(html) == text and pagetext.Page(html).counted() is not None
    assert time.process_time() - started < 20


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_base_spans():
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice(["token", "é", " = ", "abc12", "AKIA", "Z9", "0af" * 9, ": ", '"', "API_KEY", "secret=", " ", "\n", "pass", "x" * 7]) for _ in range(30))
        assert secrets.base_spans(t) == brute_base(t)
    assert secrets.base_spans("") == []


def test_grammar_learns_a_format():
    rnd = random.Random(2)
    key = lambda: "".join(rnd.choice("0123456789ABCDEF") for _ in range(rnd.choice([8]))) + "-" + "".join(rnd.choice("0123456789") for _ in range(12))
    g = secrets.Grammar({"assign": [key() for _ in range(200)]})
    assert sum(g.likely(key()) == "assign" for _ in range(100)) >= 90
    assert g.likely("thatehonerethation12") is None
    assert g.spans("card 4829102938471029 and word thatehonerethation12", []) == []
    a = secrets.Automaton(["ab"] * 50 + ["abab"] * 50)
    assert a.likelihood("ab") > a.likelihood("ba")


def test_candidates_are_whole_parts_of_runs_as_short_as_the_format():
    rnd = random.Random(5)
    pick = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    short = lambda: pick("0123456789", 4) + pick("GHJKLMNPQR", 6)
    g = secrets.Grammar({"assign": [short() for _ in range(200)]})
    k = short()
    for before, after in (("", ""), ("auth=", ""), ("see ", "."), ("a/b/", "/c"), ('"', '"')):
        text = f"{before}{k}{after} end"
        assert g.spans(text, []) == [(len(before), "learned", len(before) + 10)]
    assert g.spans(f"token=abcdef,{k}", [(0, 0, 12)]) == [(13, "learned", 23)]
    digits = secrets.Grammar({"assign": [pick("0123456789", 12) for _ in range(200)]})
    assert len(digits.spans("no 482910293847 here", [])) == 1
    long = lambda: pick("0123456789abcdef", 100) + "-" + pick("GHJKLMNPQR", 28)
    g = secrets.Grammar({"hex": [long() for _ in range(200)]})
    assert g.likely(long()) == "hex" and g.likely(pick("0123456789abcdef", 129)) is None


def test_automata_keep_places_and_lengths():
    rnd = random.Random(14)
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    fixed = ["AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) for _ in range(200)]
    free = [some("0123456789abcdef", rnd.randint(20, 60)) for _ in range(300)]
    grammar = secrets.Grammar({"access": fixed, "hex": free})
    states = {k: len(a.next) for k, (a, _) in grammar.automata.items()}
    assert states["access"] >= 21 and states["hex"] < 21  # free lengths loop
    found = lambda g, x: [k for _, k, _ in g.spans(f"key {x} end", [])]
    other = ["ASIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) for _ in range(100)]
    assert sum(found(grammar, x) == ["learned"] for x in other) >= 90
    assert not any(found(grammar, x[:-1]) or found(grammar, x + "7") or found(grammar, "k" + x[1:]) for x in other)
    assert sum(found(grammar, some("0123456789abcdef", n)) == ["learned"] for n in range(22, 58)) >= 30
    # The method switched off finds none of them.
    assert not any(found(secrets.Grammar({}), x) for x in other)


def test_learned_spans_of_planted_formats_through_the_query(spark, tmp_path):
    rnd = random.Random(15)
    some = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = [(f"d{i}", f"some words token={some(18)} and more", i) for i in range(60)]
    rows += [(f"e{i}", f"plain words beside {some(18)} and 4411 2200 1234567890123456", i) for i in range(40)] + [("n", None, 0), ("n", None, 0), (None, "w " * 200_000, 1)]
    spark.createDataFrame(rows, "doc_id string, text string, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op3(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sum(r.n_learned for r in got if r.doc_id and r.doc_id[0] == "e") >= 36
    assert sum(r.n_learned for r in got if not r.doc_id or r.doc_id[0] != "e") == 0
    assert all(r.spans == f"learned:19:{19 + 18}" for r in got if r.n_learned)


def test_rare_kinds_keep_their_examples_in_a_large_table(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "if(id % 5000 = 7, concat('AKIA', substr(upper(md5(string(id))), 1, 16)), 'some text') as text")
    found = secrets.labelled(docs)
    assert len(found["access"]) == 12 and list(secrets.Grammar(found).automata) == ["access"]
    many = spark.range(2_000).selectExpr("id as doc_id", "concat('AKIA', substr(upper(md5(string(id))), 1, 16)) as text")
    want = sorted((r.text for r in many.collect()), key=secrets._hash)[: secrets.EXAMPLES]
    assert secrets.labelled(many.repartition(7))["access"] == want


def test_secrets_query(spark):
    rnd = random.Random(3)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(120)]
    texts = [f'é words token = "{h}" end' for h in hexes] + [None, "", "no secret here", f"stray {hexes[0][:20]}A1 x"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in secrets.scanned(docs, secrets.Grammar(secrets.labelled(docs))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        named = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in brute_base(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(got[i].spans.split(","))
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (1, 0, 1)
    assert secrets.scanned(docs.limit(0), secrets.Grammar({})).count() == 0


def toxic_texts(n, bad, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(["ta", "ro", "mi", "ne", "su", "lo"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    out = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(120)]
        if i % 3 == 0:
            for _ in range(8):
                w[rnd.randrange(120)] = rnd.choice(bad)
        out.append((i, " ".join(w), int(i % 3 == 0)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_texts(900, ["wixplog", "grumfaz", "brekkutz"], 1)
    docs = spark.createDataFrame([(i, t, None, None, "x") for i, t, _ in rows] + [(9000, None, None, None, "x"), (9001, "", None, None, "x")], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    label = {i: y for i, _, y in rows}
    held = [(r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.scored(docs, toxicity.learn(docs, none)).collect()] == [0.0, 0.0]
    assert toxicity.scored(docs.limit(0), toxicity.learn(docs, none)).count() == 0


@pytest.mark.parametrize("chunk", [5, 64, 1000])
def test_toxicity_windows_do_not_depend_on_pieces(monkeypatch, chunk):
    text = "alpha  beta\tgamma \u0130delta " * 50 + "w" * 300 + " end of it"
    whole = list(toxicity.windows(text))
    assert len(whole) == -(-204 // toxicity.WINDOW)
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    assert list(toxicity.windows(text)) == whole
    assert list(toxicity.windows("")) == list(toxicity.windows(None)) == []


def test_toxicity_of_hard_rows(spark):
    """Repeated and null ids, long texts through the query's functions, clashing names, text ids."""
    made = toxic_texts(80, ["wixplog"], 3)
    texts, bad = [t for _, t, _ in made], {i for i, _, y in made if y}
    rows = [(f"d{i}", t, i) for i, t in enumerate(texts)] + [("d0", texts[0], 0), (None, texts[1], 1), ("x", None, 2), ("long", "calm words here " * 40_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, toxic int")
    labels = spark.createDataFrame([(f"d{i}", int(i in bad)) for i in range(80)] + [(None, 1), ("d1", None)], "doc_id string, toxic int")
    got = toxicity.scored(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == "d0"}) == 1


def test_language(spark):
    rnd = random.Random(4)
    make = {"xx": ["tha", "wen", "ing", "sho"], "yy": ["été", "oui", "ail", "que"], "zz": ["sch", "ung", "ßen", "äch"]}
    text = lambda k, n: " ".join("".join(rnd.choice(make[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, text(k, rnd.randint(3, 60)), k, "s", "x") for i, k in enumerate(sorted(make) * 100)]
    rows += [(1000, None, "xx", "s", "x"), (1001, "12 !?", "xx", "s", "x"), (1002, text("zz", 5), None, "s", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identified(docs, language.learn(docs)).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _, _ in rows[:300])
    assert (got[1000].lang_pred, got[1001].lang_pred, got[1002].lang_pred) == ("und", "und", "zz")
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = docs.limit(0)
    assert language.identified(docs, language.learn(empty)).where("lang_pred != 'und'").count() == 0


@pytest.mark.parametrize("chunk", [1, 5, 6, 7, 100])
def test_long_texts_count_as_short_ones(monkeypatch, chunk):
    t = "ab cde,fghij \u0130klm \u00dfn  " * 100 + "x" * 50
    one = dict(zip(*(x.tolist() for x in language.grams(t))))
    monkeypatch.setattr(language, "CHUNK", chunk)
    assert dict(zip(*(x.tolist() for x in language.grams(t)))) == one


def test_rank_order_matches_plain_dictionaries():
    rnd = random.Random(16)
    make = lambda syllables, n: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    learned = {"a": make(["tha", "wen", "ing"], 400), "b": make(["wen", "ung", "sch"], 400)}

    def counts(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        return Counter(x for w in words for p in [f" {w} "] for x in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))])

    def code(gram):
        c = [0 if x == " " else ord(x) for x in gram]
        return c[0] if len(c) == 1 else (c[0] << 21 | c[1]) | (1 << 62) if len(c) == 2 else c[0] << 42 | c[1] << 21 | c[2]

    rank = lambda n: {g: i for i, (g, _) in enumerate(sorted(((code(g), k) for g, k in n.items()), key=lambda x: (-x[1], x[0]))[: language.TOP])}
    profiles = language.Profiles({k: [(code(g), n) for g, n in counts(t).items()] for k, t in learned.items()})
    for _ in range(40):
        text = make(["tha", "wen", "sch", "ung"], rnd.randint(1, 60)) + " 12, x!"
        own = rank(counts(text))
        away = {k: sum(abs(r - rank(counts(t)).get(g, r + language.TOP)) for g, r in own.items()) for k, t in learned.items()}
        near = {k: 1 - d / (language.TOP * len(own)) for k, d in away.items()}
        want = min(away, key=lambda k: (away[k], k))
        got, score = profiles.predict(text)
        assert got == want and abs(score - near[want] / sum(near.values())) < 1e-12


@pytest.fixture(scope="module")
def bpe():
    return tokencount.PrefixBpe(public_tokenizers.path("byte_bpe_50k.json"))


TRICKY = [
    "", " ", "hello world", "  two  spaces\n\n next\t", "don't we'll I'M it's 'tis", "été Über ñandú 漢字かな 🙂🙂 a b c", "x<|endoftext|>y <|endoftext|>",
    "<|endoftext", "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 8, "12345 67,890.12 -- ### $$$", "՘ ͸a\U0001e900", "tab\r\nline\x0b\x0c\x1c\x85end   ", "word " * 300,
]


def test_counts_are_the_librarys(bpe):
    rnd = random.Random(6)
    texts = TRICKY + ["".join(rnd.choice("ab' é\n1!漢 T") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    want = [len(e) for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.count(t) for t in texts] == want


def test_every_prefix(bpe):
    for t in [x for x in TRICKY if "<|" not in x and len(x) < 300]:
        p = bpe.prefixes(t)
        want = [len(bpe.tokenizer.encode(t[:i], add_special_tokens=False)) for i in range(len(t) + 1)]
        assert [p.at(i) for i in range(len(t) + 1)] == want
        for limit in range(8):
            assert p.longest(limit) == max(i for i, n in enumerate(want) if n <= limit)
            assert bpe.fit(t, limit) == (want[-1], p.longest(limit))


def test_fit_looks_prefixes_up(bpe, monkeypatch):
    """Once a text is counted, no limit encodes anything again."""
    text = "Pseudopneumonoultramicroscopic words and numbers 1234567890 " * 40
    total, _ = bpe.fit(text, 10)
    want = {limit: max(i for i in range(len(text) + 1) if len(bpe.tokenizer.encode(text[:i], add_special_tokens=False)) <= limit) for limit in (5, 77, 200)}
    monkeypatch.setattr(bpe, "prefix_counts", None)
    assert {limit: bpe.fit(text, limit) for limit in want} == {limit: (total, i) for limit, i in want.items()}


def test_token_query(spark, bpe):
    texts = TRICKY + [None]
    got = {r.doc_id: r for r in tokencount.counted(docs_of(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), 100).collect()}
    for i, t in enumerate(texts):
        n = len(bpe.tokenizer.encode(t or "", add_special_tokens=False))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
        assert len(bpe.tokenizer.encode((t or "")[: got[i].fit_chars], add_special_tokens=False)) <= 100
        assert got[i].fit_chars == len(t or "") if n <= 100 else 0 < got[i].fit_chars < len(t)
