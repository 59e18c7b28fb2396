"""URL filter, quality classifier, decontamination, personal data, HTML extraction."""

import random
import re
import time

import numpy as np
import pytest

from loomstone.llm import decontaminate, html_text, pii, quality, queries, url_filter


def test_url_rules_and_vocabulary(spark):
    urls = [
        (1, "http://A.Example.com/en/7x"), (2, "http://b.com/en/1"), (3, "https://casino-win.example.org/fr/1"), (4, "http://mycasinos.org/a"), (5, "http://free-bets.org/a?x=1#y"),
        (6, "http://free.org/free"), (7, None), (8, ""), (9, "no scheme casino"), (10, "http://x.net/de/1"), (11, "http://sub.example.net/de/8"), (12, "http://x?/en/://q"), (12, "http://x?/en/://q"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in urls], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    assert got == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("b.com", "/en/1", "com/en/", "block"), 3: ("casino-win.example.org", "/fr/1", None, "block"),
        4: ("mycasinos.org", "/a", None, "allow"), 5: ("free-bets.org", "/a", None, "block"), 6: ("free.org", "/free", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "block"), 10: ("x.net", "/de/1", "net/de/", "allow"), 11: ("sub.example.net", "/de/8", "example.net/de/8", "block"), 12: ("x", "", None, "allow"),
    }
    assert url_filter.filter_urls(df, queries.URL_RULES).count() == 13
    ties = [("a.com", "/x", "block"), ("com", "/x/y/z", "allow"), ("b.a.com", "", "allow"), ("a.com", "/y", "allow"), ("a.com", "/y", "block")]
    assert url_filter.longest_rule("b.a.com", "/x/y/z", ties) == ("com/x/y/z", "allow") and url_filter.longest_rule("b.a.com", "/x", ties) == ("a.com/x", "block")
    assert url_filter.longest_rule("a.com", "/y", ties) == ("a.com/y", "allow")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_vocabulary_of_a_table(spark):
    words = spark.createDataFrame([("Wager", "strict", None), ("gift", "soft", 3), ("gift", "soft", 1), ("card", "soft", 2), ("vip", "soft", 1), (None, "soft", 9)], "term string, kind string, weight int")
    strict, soft = url_filter.vocabulary(words)
    assert strict == ("wager",) and soft == {"gift": 3, "card": 2, "vip": 1}
    urls = ["http://a/wager", "http://a/wagers", "http://a/gift", "http://a/gift-card", "http://a/card-vip", "http://a/gift/gift", "http://a/card-vip-gift", "http://a/" + "x" * 2_000_000 + "/wager"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["soft_hits"], r["soft_weight"]) for r in url_filter.filter_urls(df, strict=strict, soft=soft, soft_limit=4).collect()}
    assert got == {0: ("block", 0, 0), 1: ("allow", 0, 0), 2: ("allow", 1, 3), 3: ("block", 2, 5), 4: ("allow", 2, 3), 5: ("allow", 1, 3), 6: ("block", 3, 6), 7: ("block", 0, 0)}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op3_quality(spark, sf).join(labels, "doc_id").where("held_out")
    right = got.selectExpr("avg(CAST(predicted = quality AS INT)) AS a", "min(score) AS lo", "max(score) AS hi").first()
    assert right["a"] > 0.95 and 0 <= right["lo"] < 0.5 < right["hi"] <= 1
    assert docs.count() == queries.op3_quality(spark, sf).count()


def test_quality_edge_cases(spark, docs):
    rows = [(i, f"plain words of text number {i} and more") for i in range(20)] + [(50 + i, f"BUY!! NOW!! {i}!! $$$") for i in range(20)] + [(90, None), (91, ""), (None, "x"), (92, "y " * 100_000)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(50 + i, 0) for i in range(20)] + [(0, 1), (None, 1), (93, None)], "doc_id long, quality int")
    model = quality.train(docs(*rows), labels)
    got = {r["doc_id"]: r["predicted"] for r in quality.score_documents(docs(*rows), model, 0.5).collect()}
    assert all(got[i] == 1 for i in range(20)) and all(got[50 + i] == 0 for i in range(20)) and 90 in got and 91 in got
    assert quality.keep_good(docs(*rows), model, 0.5).columns == docs().columns
    for few in (labels.where("quality = 1"), labels.limit(0)):
        one = quality.train(docs(*rows), few)
        assert {r["predicted"] for r in quality.score_documents(docs(*rows), one, 0.5).collect()} == {1}
    assert quality.score_documents(docs().limit(0), model).count() == 0


def test_dual_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)) for _ in range(60)]
    y = np.where([0 in r or 1 in r or 2 in r for r in rows], 1.0, -1.0)
    r = quality.log_count_ratio(rows, y)
    w, bias = quality.descend(rows, y, r, epochs=200)

    def primal(w, bias):
        loss = 0.0
        for idx, label in zip(rows, y, strict=True):
            x = r[idx] / np.linalg.norm(r[idx])
            loss += max(0.0, 1 - label * (w[idx] @ x + bias))
        return 0.5 * (w @ w + bias * bias) + loss

    best = primal(w, bias)
    for _ in range(200):
        assert primal(w + rng.normal(0, 0.05, len(w)) * (np.arange(len(w)) < 40), bias + rng.normal(0, 0.05)) >= best - 1e-6


def test_featurizer_is_the_same_in_pieces(monkeypatch):
    text = bytes(random.Random(1).choices(b"abc $!", k=5000))
    whole = set(quality.Featurizer()(text).tolist())
    monkeypatch.setattr(quality, "_PIECE", 100)
    assert set(quality.Featurizer()(text).tolist()) == whole


def test_decontamination_equals_brute_force(spark, docs):
    rnd = random.Random(2)
    items = [(i, " ".join(f"w{rnd.randint(0, 60)}" for _ in range(rnd.choice([3, 5, 8, 20, 55])))) for i in range(30)] + [(100, None), (101, "..."), (102, "Tiny, item")]
    rows = []
    for i in range(80):
        words = [f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(0, 300))]
        item = rnd.choice(items[:30])[1].split()
        for k in rnd.sample(range(len(item)), len(item) // 12):
            item[k] = "EDIT"
        at = rnd.randint(0, len(words))
        rows.append((i, " ".join(words[:at]) + " " + ", ".join(item).upper() + " " + " ".join(words[at:])))
    rows += [(200, None), (201, ""), (202, "a tiny item here"), (202, "a tiny item here")]
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")

    def grams(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    plain = lambda t: re.findall(r"[^\x00-\x20!-/:-@\[-`{-~]+", (t or "").lower())
    want = []
    for d, t in rows:
        for item, s in items:
            w = plain(s)
            own = grams(w, min(5, len(w))) if w else set()
            if own and len(own & grams(plain(t), min(5, len(w)))) >= 0.8 * len(own):
                want.append((d, item))
    for block in (20_000, 7):
        got = decontaminate.contaminated(docs(*rows), bench, block_items=block)
        assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted(want)
        kept = decontaminate.drop_contaminated(docs(*rows), bench, block_items=block)
        assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert len(want) > 40
    long = [(1, "x y " * 150_000 + rows[0][1] + " z" * 150_000), (2, "nothing here " * 100_000)]
    got = decontaminate.contaminated(docs(*long), bench).collect()
    assert {r["item_id"] for r in got} == {i for d, i in want if d == 0}
    assert decontaminate.contaminated(docs(*rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs().limit(0), bench).count() == 0


def test_sketches_bound_the_containment():
    """Whatever shingles a document lacks of those it may, the share of the sketch it holds meets the item's bound."""
    rnd = random.Random(4)
    for n in (1, 2, 4, 5, 9, 16, 31, 32, 100, 300):
        words = [b"i%d" % k for k in range(n + 4)]
        made = decontaminate.Sketches([(1, b" ".join(words))], 5, 0.8)
        _, need, own = made.of_item[0]
        assert len(own) == n and 1 <= need <= decontaminate.SPARE * 2 + n // 3
        for _ in range(20):
            gone = rnd.sample(range(n), decontaminate.may_miss(n, 0.8))
            runs = [b" ".join(words[k : k + 5]) for k in range(n) if k not in gone]
            hits = made.search(b" sep ".join(runs))
            assert hits and hits[0][0] == 1 and hits[0][2] >= n - len(gone)


def test_blocks_of_items_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    bench = spark.createDataFrame([(i, "w " * 20) for i in range(7)] + [(9, "long " * 50)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(bench, "item_id", "text", 20_000))
    assert sorted(len(b) for b in blocks) == [1, 1, 2, 2, 2] and sum(map(len, blocks)) == 8


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"\D", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("alphabet", ["a@.-+ 1", "12.. 5-", "+1() .-0x", "4 1-0", "é@a.b1 "])
def test_base_spans_equal_the_plain_patterns(alphabet):
    rnd = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_semi_markov_model_finds_generated_entities(model):
    hit = total = wrong = 0
    for text, spans in pii.training_lines(200, seed=99):
        got = set(model.decode(text))
        hit += len(got & set(spans))
        total += len(spans)
        wrong += len(got - set(spans))
    assert hit / total > 0.9 and wrong / total < 0.15


def labellings(n_tokens, scores, moves):
    """Every segmentation of a stretch with its score: ([(first token, tokens, kind)], score), by plain enumeration."""

    def rest(at, before):
        if at == n_tokens:
            yield [], 0.0
            return
        for n in range(1, pii.MAX_TOKENS + 1):
            for kind in range(pii.NONE + 1):
                if at + n > n_tokens or (n > 1 and kind == pii.NONE) or (kind < pii.NONE and (at, n) not in scores):
                    continue
                own = (scores[at, n][kind] if kind < pii.NONE else 0.0) + moves[before, kind]
                for tail, more in rest(at + n, kind):
                    yield [(at, n, kind), *tail], own + more

    yield from rest(0, pii.START)


def test_decoding_and_marginals_equal_enumeration(model):
    seen = 0
    for text, _ in pii.training_lines(60, seed=5):
        for run in pii.stretches(text):
            if len(run) > 4:
                continue
            cands = model.candidates(text, run)
            scores = model.scores(cands)
            every = list(labellings(len(run), scores, model.moves))
            best, top = max(every, key=lambda x: x[1])
            part = text[: run[-1][1]]
            got = [x for x in model.decode(part) if x[1] >= run[0][0]]
            assert got == [(pii.KINDS[k], *cands[i, n][:2]) for i, n, k in best if k < pii.NONE]
            z, probs, steps = pii.gradient(scores, len(run), model.moves)
            total = np.logaddexp.reduce([s for _, s in every])
            assert z == pytest.approx(total, abs=1e-8)
            for (i, n), p in probs.items():
                for kind in range(pii.NONE + 1):
                    want = sum(np.exp(s - total) for way, s in every if (i, n, kind) in way)
                    assert p[kind] == pytest.approx(want, abs=1e-8)
            assert steps.sum() == pytest.approx(sum(np.exp(s - total) * len(way) for way, s in every))
            seen += len(run) > 1
    assert seen > 20


def test_neighbours_kinds_are_learned():
    model = pii.train()
    assert model.moves.shape == (pii.START + 1, pii.START) and np.abs(model.moves).max() > 0.3


def test_spans_of_any_length(model):
    for length in (60, 360, 5000):
        secret = "".join(random.Random(length).choices("abcdef0123456789ABCDEF", k=length))
        text = f'the token = "{secret}" is set'
        assert ("secret", 13, 13 + length) in pii.all_spans(text, model)[1]


def test_personal_data_rows(spark, docs, model):
    text = 'é mail a.b@c.de, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ip 10.0.0.300 10.0.0.30'
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs((1, text), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (4, "@" * 3000 + "1" * 3000), (5, "wort 10.0.0.1 " * 100_000)), model).collect()}
    assert got[5]["n_ip"] == 100_000 == got[5]["n_spans"] and got[2]["n_spans"] == 0
    assert (got[1]["n_email"], got[1]["n_ip"], got[1]["n_card"], got[1]["n_phone"]) == (1, 1, 0, 0)
    assert got[1]["spans"].startswith("email:7:15,ip:") and "secret:26:66" in got[1]["spans"]
    assert got[None]["n_phone"] == 1 and got[2]["spans"] == got[3]["spans"] == ""
    assert pii.find_personal_data(docs().limit(0), model).count() == 0


ARTICLE = "".join(f"<p>Paragraph {i} has some words, commas and more words to be dense enough.</p>" for i in range(6))
PAGES = {
    "article": (f"<body><nav><a href=x>m</a></nav><article><h1>T</h1>{ARTICLE}</article><footer>f</footer>", 7),
    "classes": (f"<body><div class='site-header'>Site</div><div class=content><h1>T</h1>{ARTICLE}<p>ok</p></div><div id=comments>{ARTICLE}{ARTICLE}</div><div class='sidebar'>{ARTICLE}</div>", 8),
    "form": (f"<body><main><h1>T</h1><form><p>Your name</p></form>{ARTICLE}<script>var a='<p>no</p>';</script></main>", 7),
    "list": (f"<body><div><h1>T</h1>{ARTICLE}<ul><li>one<li>two</ul></div>", 9),
    "named": (f"<body><div class='page-header'>Site name</div><div class='content has-sidebar'><div class='entry-header'><h2>T</h2></div>{ARTICLE}</div>", 7),
    "bare": ("<p>one &amp; two<br>three<p>four", 2),
}


@pytest.mark.parametrize("name", PAGES)
def test_html_blocks(name):
    source, blocks = PAGES[name]
    got = html_text.extract(source).split("\n\n")
    assert len(got) == blocks, got


def test_html_articles_of_the_pages_table(spark):
    """The table's pages mark their articles, so a plain cut is the brute-force version."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        parts = (re.sub("[\\x20\\x09-\\x0D]+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p)))).strip() for p in re.split("</?p>|</?h1>", inner))
        assert html_text.extract(r["html"]) == "\n\n".join(p for p in parts if p)


def without_names(source):
    """The page without class, id and role, every sectioning element a div: only densities can tell its parts apart."""
    source = re.sub(r'\s(class|id|role)="[^"]*"', "", source)
    return re.sub(r"<(/?)(nav|header|footer|aside|article|main|section)\b", r"<\1div", source)


def test_html_articles_by_density_alone(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert all(html_text.extract(without_names(r["html"])) == html_text.extract(r["html"]) for r in rows)
    links = "".join(f"<li><a href=/{i}>Link number {i} of the menu</a></li>" for i in range(30))
    more = "".join(f"<div><a href=/x{i}>Another story with a long title, number {i}</a></div>" for i in range(20))
    for around in (("<div><ul>%s</ul></div>", "<div>%s</div><div>All rights reserved.</div>"), ("<table><tr><td><ul>%s</ul></td><td>", "</td><td>%s</td></tr></table>")):
        page = f"<body>{around[0] % links}<div><h1>T</h1>{ARTICLE}<p>Short.</p></div>{around[1] % more}</body>"
        got = html_text.extract(page).split("\n\n")
        assert got[0] == "T" and got[-1] == "Short." and len(got) == 8
    whole = html_text.extract(f"<body><div>{ARTICLE}</div><div>{ARTICLE}</div><div>{links}</div></body>")
    assert whole.count("Paragraph") == 12 and "Link" not in whole


@pytest.mark.parametrize(
    "source",
    ["<div>" * 20_000 + "x" + "</b>" * 100_000, "<b><article>" + "<div>" * 20_000 + "</b>" * 20_000, "<div>a" * 30_000, "<ul>" + "<li>x" * 50_000, "<body>" + "<div><p>some words</p></div>" * 20_000, "<a " + 'x="' * 100_000],
)
def test_html_time_is_linear(source):
    began = time.perf_counter()
    html_text.extract(source)
    assert time.perf_counter() - began < 5


def test_html_rules():
    assert html_text.extract("<p> a \n\t b&nbsp;&lt;x&gt; </p><p></p><p>c") == "a b\xa0<x>\n\nc"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<script>x") == html_text.extract("<!-- <p>a</p>") == ""
    assert html_text.extract('<p title="a>b">x</p>') == "x"
    assert html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.extract("text < 3 and <b>bold</b>") == "text < 3 and bold"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>é", "t"), (None, None, None, "t"), (2, "u", "", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(df).collect()), key=str)
    assert got == [(1, "é", 1), (2, "", 0), (2, "", 0), (None, "", 0)]
    assert html_text.extract_pages(df.limit(0)).count() == 0
