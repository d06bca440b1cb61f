"""Operators that work in tasks by numpy, against brute force, exact properties or held-out accuracy."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import bayes_quality, components, html_main, jaccard_join, langid, licenses, mixing, ngrams, pitman_yor
from wardline.llm.text import read

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def groups_by_force(rows):
    """component of every (doc_id, text), comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                parent[find(a)] = find(b)
    lowest = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            lowest[r] = min(i, lowest.get(r, i))
    return collections.Counter((i, len(s), lowest.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed, groups=12, size=9, words=60):
    """Groups of texts, each some words away from the one before: chains whose ends need not be similar."""
    r = random.Random(seed)
    rows, doc = [], 1000
    passage = [f"shared{k}" for k in range(25)]
    for g in range(groups):
        text = [f"g{g}w{r.randrange(40)}" for _ in range(words)]
        for _ in range(r.randint(1, size)):
            rows.append((doc, " ".join(text + passage * (g % 2))))
            doc += 1
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = f"new{r.randrange(1000)}"
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("frequent", "small", "seed"), [(64, 64, 1), (3, 1, 2)])
def test_jaccard_join_finds_every_link(documents, odd_rows, monkeypatch, frequent, small, seed):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = near_copies(seed)
    docs = documents([(i, t, "en", "s") for i, t in rows] + odd_rows, clash=True)
    got = collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(docs).collect())
    assert got == groups_by_force(rows + [(r[0], r[1]) for r in odd_rows])


def test_neighbouring_frequent_shingles_find_every_link():
    """All shingles frequent: two sets that are similar still have an index key in common."""
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(5, 200)
        x = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        y = x
        while True:
            z = np.unique(np.append(np.delete(y, r.randrange(len(y))), np.uint64(r.getrandbits(64)))) if r.random() < 0.5 else np.delete(y, r.randrange(len(y)))
            common = len(np.intersect1d(x, z))
            if 100 * common < 80 * (len(x) + len(z) - common) or len(z) < 5:
                break
            y = z
        keys = []
        for s in (x, y):
            run = s[: jaccard_join.reach(len(s))]
            keys.append(set(zip(run[:-1].tolist(), run[1:].tolist(), strict=True)))
        assert keys[0] & keys[1] or np.array_equal(x, y)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (1, 50, 3000):
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[n // 3 :], r.integers(0, 2**63, n // 4).astype(np.uint64)]))
        differ = sum(int(a ^ b).bit_count() if a ^ b >= 0 else 64 - int(~(a ^ b)).bit_count() for a, b in zip(
            jaccard_join.bitmap(x).tolist(), jaccard_join.bitmap(y).tolist(), strict=True))
        assert differ <= len(np.setxor1d(x, y))


def test_one_document_of_each_group_stays(documents, odd_rows):
    docs = documents([(i, t, "en", "s") for i, t in near_copies(3)] + odd_rows, clash=True)
    out = jaccard_join.representatives(docs)
    assert out.columns == docs.columns
    got = jaccard_join.join(docs).toPandas()
    left = out.toPandas()
    words = got[got.n_shingles > 0]
    assert len(left) == words.component_id.nunique() + (got.n_shingles == 0).sum()
    assert set(words.component_id) <= set(left.doc_id)


def test_jaccard_join_of_nothing(documents):
    assert jaccard_join.join(documents([])).count() == 0
    assert jaccard_join.join(documents([(1, None, None, None), (2, "", None, None)])).count() == 2


def test_words_and_slices(monkeypatch):
    texts = [None, "", " a  B\tc ", "é x\x00y " * 40, "w" * 9000 + " w", "one two"]
    whole = {r: s for r, s in ngrams.shingle_sets(pa.array(texts))}
    monkeypatch.setattr(ngrams, "SLICE", 64)
    for r, s in ngrams.shingle_sets(pa.array(["skip", *texts]).slice(1)):
        assert np.array_equal(s, whole[r]) and len(s) == len(shingle_set(texts[r]))


def test_components_are_those_of_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_languages_on_held_out_documents(spark):
    docs = read(spark, SF, "documents")
    got = langid.predict(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()


def test_rare_languages_are_learnt(documents):
    """270 languages, each with letters of its own."""
    text = lambda k: " ".join(chr(0x4E00 + 20 * k + j) * 2 + chr(0x4E00 + 20 * k + (j + i) % 20) for i in range(3) for j in range(20))
    n = 270
    rows = [(i, text(i % n), f"l{i % n:03d}", "s") for i in range(8 * n)]
    got = langid.predict(documents(rows)).toPandas()
    trained = {i % n for i in range(8 * n) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(trained) > 260
    right = [p == f"l{i % n:03d}" for i, p in zip(got.doc_id, got.lang_pred, strict=True) if i % n in trained]
    assert np.mean(right) > 0.98


def test_languages_of_odd_texts(documents, odd_rows):
    got = langid.predict(documents(odd_rows, clash=True)).collect()
    assert len(got) == len(odd_rows)
    assert all(x.lang_pred == "und" and x.score == 0 for x in got if x.doc_id in (1, 2, None))
    assert langid.predict(documents([])).count() == 0
    assert {x.lang_pred for x in langid.predict(documents([(1, "text", None, None)])).collect()} == {"und"}


def test_languages_do_not_use_lang_of_held_out(documents):
    rows = [(i, "alpha beta" if i % 2 else "gamma delta", "x" if i % 2 else "y", "s") for i in range(200)]
    wrong = [(i, t, "z" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s) for i, t, lang, s in rows]
    key = lambda df: sorted((x.doc_id, x.lang_pred, round(x.score, 6)) for x in df.collect())
    assert key(langid.predict(documents(rows))) == key(langid.predict(documents(wrong)))


def test_targets_fill_up_to_twice_a_source():
    got = mixing.targets([10, 1000, 10, 0])
    assert got[0] == 20 and got[2] == 20 and got[3] == 0 and sum(got) == 1020 * mixing.BUDGET
    assert mixing.targets([]) == [] and mixing.targets([0]) == [0]


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    p, rows = r.random(500), np.vstack([r.integers(1, 900, 500), np.ones(500)]).astype(float)
    q = mixing.fly(p, rows, r)
    assert np.allclose(rows @ q, rows @ p) and ((q > 0) & (q < 1)).sum() <= 2
    once = np.mean([mixing.fly(np.full(9, 0.3), np.vstack([np.arange(1, 10.0), np.ones(9)]), np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(once - 0.3).max() < 0.04


def test_mix_comes_near_its_targets_and_is_the_same_again(documents, odd_rows):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randint(1, 80)), "en", "hot" if i % 3 else r.choice("xyz")) for i in range(3000)] + odd_rows
    docs = documents(rows, clash=True)
    got = mixing.mix(docs, block=200).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    for source, part in got.groupby("source", dropna=False):
        if len(part) > 300:
            assert abs(part.taken.sum() - part.target.iloc[0]) <= 40, source
    again = mixing.mix(docs.repartition(7), block=200).toPandas()
    order = ["doc_id", "size", "source", "copies"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))
    assert mixing.mix(documents([])).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"] and out.filter("copies < 1").count() == 0


def unigrams(rows):
    counts, tokens = collections.Counter(), []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        tokens.append(w)
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(w)
    return counts, tokens


def test_base_scores_and_better_scores(documents, odd_rows):
    r = random.Random(6)
    rows = [(i, " ".join([f"{'ab'[i % 2]}{min(int(r.expovariate(0.1)), 60)}" for _ in range(r.randint(1, 60))]), "en", "s") for i in range(400)] + odd_rows
    counts, tokens = unigrams([(x[0], x[1]) for x in rows])
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)) for w in tokens)
    for frequent in (pitman_yor.FREQUENT, 20):
        got = pitman_yor.score(documents(rows, clash=True), frequent=frequent).toPandas()
        assert np.allclose(sorted(zip(got.n_tokens, got.n_known, got.base_score.round(5), strict=True)), want, atol=2e-5)
        assert (got.train_tokens == n).all() and np.allclose(got.perplexity, 10 ** (-got.score / got.n_tokens))
        held = got[got.held_out]
        assert held.score.sum() > held.base_score.sum()
        scores = got.sort_values(["doc_id", "n_tokens"]).score.to_numpy()
        assert frequent == pitman_yor.FREQUENT or np.allclose(scores, before)
        before = scores
    assert pitman_yor.score(documents([])).count() == 0


def test_probabilities_of_a_context_sum_to_one(spark, documents):
    r = random.Random(8)
    rows = [(i, " ".join(f"w{min(int(r.expovariate(0.2)), 30)}" for _ in range(40)), "en", "s") for i in range(60)]
    contexts = pitman_yor.frequent_words(documents(rows), 3)
    counts = pitman_yor.stage(pitman_yor.word_counts(documents(rows), contexts))
    states, discounts, totals = pitman_yor.fit(counts)
    got = pitman_yor.probabilities(counts, states, discounts).filter("c > 0").collect()
    used = states[1:]
    for u in range(4):
        total = sum(s.backoff(discounts[0])[u] * s.parent_probability(np.zeros(1), np.zeros(1), discounts[1])[0] for s in used) / len(used)
        for x in got:
            total += 10 ** x.lps[x.us.index(u)] if u in x.us else sum(s.backoff(discounts[0])[u] * p for s, p in zip(used, x.ps, strict=True)) / len(used)
        assert total == pytest.approx(1.0)


def test_every_preceding_word_has_its_restaurant(spark, documents):
    """Rare first words count as contexts, what each predicts sums to one, and a rare bigram beats its unigram."""
    r = random.Random(4)
    rows = [(i, " ".join(f"first{k} then{k}" for k in (r.randrange(60) for _ in range(20))), "en", "s") for i in range(120)]
    of = pitman_yor.seat(pitman_yor.stage(pitman_yor.pair_counts(documents(rows))))
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = collections.Counter(p for _, t, _, _ in train for p in zip(["<end>", *t.split()], [*t.split(), "<end>"], strict=True))
    assert of.contexts.filter("n > 0").count() == len({a for a, _ in count}) == 121
    assert of.pairs.filter("c > 0").count() == len(count) and of.n == sum(count.values())
    words = of.words.filter("c > 0").select("w")
    seen = of.pairs.filter("c > 0")
    full = of.contexts.filter("n > 0").select("u").crossJoin(words).join(seen, ["u", "w"], "left").fillna(0)
    of.pairs = full.select("u", "w", "c", "total", "t1", "t2")
    unknown = [(pitman_yor.STRENGTH + of.discounts[1] * t) / (of.v + 1) / (m + pitman_yor.STRENGTH) for m, t in of.parent[1:]]
    d = of.discounts[0]
    backoff = {x.u: [(1 + d * x.t1) / (x.n + 1), (1 + d * x.t2) / (x.n + 1)] for x in of.contexts.collect()}
    sums = collections.defaultdict(float)
    for x in pitman_yor.pair_probabilities(of).collect():
        sums[x.u] += 10**x.lp
    assert len(sums) == 121
    for u, total in sums.items():
        assert total + sum(a * b for a, b in zip(backoff[u], unknown, strict=True)) / 2 == pytest.approx(1.0)
    got = pitman_yor.score(documents(rows), frequent=30).toPandas()
    held = got[got.held_out]
    assert (held.score / held.n_tokens).mean() > 0.6 * (held.base_score / held.n_tokens).mean()


def test_pairs_met_once_by_frequent_words_are_joined_with_nothing(spark, documents):
    """They are most of all pairs; the totals of their words give what the join gave."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(60)), "en", "s") for i in range(150)]
    plain = pitman_yor.seat(pitman_yor.stage(pitman_yor.pair_counts(documents(rows))))
    want = {(x.u, x.w): x for x in pitman_yor.pair_probabilities(plain).collect()}
    few = pitman_yor.seat(pitman_yor.stage(pitman_yor.pair_counts(documents(rows))), frequent=40)
    known = spark.sparkContext.broadcast(pitman_yor.known_totals(*pitman_yor.totals_used(few), few.least))
    got = {(x.u, x.w): x for x in pitman_yor.pair_probabilities(few, known).collect()}
    assert got.keys() == {k for k, x in want.items() if x.total > 1 or x.n < few.least or x.wc < few.least}
    assert 0 < len(got) < len(want) and {x.total == 1 for x in got.values()} == {True, False}
    assert all(x.lp == pytest.approx(want[k].lp) for k, x in got.items())
    lp = [x.lp - (x.once1 if x.c else x.once0) for x in want.values() if x.total == 1]
    assert np.allclose(lp, 0)
    whole, small = (pitman_yor.score(documents(rows), frequent=k).toPandas().sort_values("doc_id") for k in (pitman_yor.FREQUENT, 40))
    for name in ("n_tokens", "n_known", "base_score", "score"):
        assert np.allclose(whole[name], small[name])
    assert whole.score.sum() == pytest.approx(sum(x.total * x.lp for x in want.values()))


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="page-12">
    <header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
    <div id="wrap"><div class="entry post-77"><h2>Title &amp; more</h2><p>First  para &lt;one&gt;
    goes on<p>Second <b>bold<p>Third &eacute; <a href='x>y'>link</a><script>var t = "</p>";</script></p>
    <ul><li>a<li>b</ul><form><p>search</p></form><div class="comments"><p>A reader says a lot of things here, more than all else in the page</p></div></div>
    <aside>related</aside></div><footer>(c)</footer></body></html>"""
    found = html_main.blocks(page)
    path, _ = html_main.best_path(found)
    assert html_main.text_under(found, path) == "Title & more\nFirst para <one> goes on\nSecond bold\nThird é link\na\nb"
    assert path.endswith("div.entry.post-#")
    for odd in ("", "plain", "<", "<p", "</div></div>", "<!-- open", "<div><div><p>x", "<script>x", "a < b > c"):
        html_main.text_under(html_main.blocks(odd), None)
    assert html_main.text_under(html_main.blocks("plain  text"), "/html/body/div") == "plain text"


def test_headline_lead_and_sections_stay(spark):
    inner = "<div class='content'><p>" + "the body of it all " * 30 + "</p></div>"
    rest = "<h1>Title</h1><p>A lead of some words</p>" + inner + "<div class='more'><p>" + "a further part " * 9 + "</p></div>"
    plain = "<html><body><div class='top'><p>Site</p></div><div class='wrap'>" + rest + "</div></body></html>"
    short = "<html><body><div class='wrap'>" + inner + "</div></body></html>"
    pages = [(1, "http://a.x/1", f"<html><body><article>{rest}</article></body></html>"), (2, "http://b.x/1", plain)]
    pages += [(3 + i, "http://c.x/1", short) for i in range(3)] + [(6, "http://c.x/2", plain)]
    got = {x.page_id: x.text for x in html_main.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in (1, 2, 6):
        assert got[k].startswith("Title\nA lead of some words\nthe body") and got[k].endswith("a further part") and "Site" not in got[k]


def test_hints_do_not_empty_a_page():
    text = "<p>" + "some running text of the page " * 9 + "</p>"
    for page in (f"<body class='post has-sidebar comments-open'>{text}</body>", f"<body><div class='content no-sidebar'>{text}</div></body>",
                 f"<body><main class='widget'>{text}</main></body>", f"<body><p>Top</p><form id='aspnet'><div>{text}</div></form></body>",
                 f"<body><div class='widget'>{text}<div class='comments'><p>{'a reader says ' * 90}</p></div></div></body>"):
        found = html_main.blocks(page)
        got = html_main.text_under(found, html_main.best_path(found)[0])
        assert "some running text" in got and "reader" not in got
    for name in ("sidebar", "cookie-notice", "site-footer", "nav-menu", "ad_box-12", "related-posts widget", "post-comments"):
        found = html_main.blocks(f"<body><div class='c'>{text}</div><div class='{name}'><p>left out</p></div></body>")
        assert [b[1][:4] for b in found] == ["some"], name


def test_hosts_agree_on_their_paths(spark):
    """The host's path holds for a page whose longest part is another one, as long as it has half as much of its text."""
    good = "<html><body><div class='m'><p>" + "main text here " * 9 + "</p></div><div class='x'><p>short</p></div></body></html>"
    odd = "<html><body><div class='m'><p>main one</p></div><div class='x'><p>" + "longer side " * 6 + "</p></div><div class='m'><p>and the main rest of it goes here</p></div></body></html>"
    rows = [(i, "http://h.example/a", good) for i in range(5)] + [(9, "http://H.example/b", odd), (9, "http://H.example/b", odd), (10, None, None), (11, "http://h.example", "")]
    got = {x.page_id: x.text for x in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "main one\nand the main rest of it goes here" and got[10] == "" and got[11] == "" and got[0].startswith("main text")
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_page_keeps_its_article_where_the_path_of_its_host_has_little(spark):
    usual = "<html><body><article><p>" + "main text here " * 30 + "</p></article></body></html>"
    odd = "<html><body><div class='x'><p>" + "prose of this page " * 50 + "</p></div><article><p>tiny</p></article></body></html>"
    rows = [(i, "http://h.example/a", usual) for i in range(5)] + [(9, "http://h.example/b", odd)]
    got = {x.page_id: x for x in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].path == "/html/body/article" and got[9].text.startswith("prose of this page prose") and len(got[9].text) > 900


@pytest.mark.parametrize("piece", ["<script ", '<p "', "<div class=abcdef>", "<!-- ", "<p '>\"", "<nav>", "</td><div>", "<script>a</scrip", "<!x "])
def test_broken_pages_take_time_in_proportion(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    found = html_main.blocks(page)
    html_main.text_under(found, "/html/body")
    assert time.perf_counter() - began < 3


def test_tags_as_browsers_see_them():
    said = lambda page: [b[1] for b in html_main.blocks(page)]
    assert said("<p>a < b</p><p title='x > y'>c</p>") == ["a < b", "c"]
    assert said("<p>one<!-- gone > --> two<script>if (a < b) '</p>'</script> three") == ["one two three"]
    assert said("<p>one</p><!-- never closed <p>two") == ["one"]
    assert said("<p>one</p><script>never closed <p>two") == ["one"]
    assert said('<p class="never closed>one</p><p>two</p>') == ["one", "two"]
    assert said("<!doctype html><?xml x?><p>one</p><p") == ["one", "<p"]
    deep = "<div>" * 1000 + "text" + "</div>" * 1000 + "<p>after</p>"
    assert said(deep) == ["text", "after"]


def test_articles_of_the_given_pages(spark):
    import html as entities
    import re

    pages = read(spark, SF, "pages").toPandas()
    got = html_main.extract(read(spark, SF, "pages")).toPandas().set_index("page_id").text
    for i, page in zip(pages.page_id, pages.html, strict=True):
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body).replace("<b>", "").replace("</b>", ""))
        want = [re.sub(r"\s+", " ", entities.unescape(x)).strip() for x in parts]
        assert got[i] == "\n".join(x for x in want if x)


def test_quality_of_labelled_documents(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = bayes_quality.judge(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    good = got[(got.quality == 1) & (got.toxic == 0)]
    assert good.kept.mean() > 0.95 and got[(got.quality == 0)].kept.mean() < 0.2


def test_quality_of_odd_tables(spark, documents, odd_rows):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (99, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    assert bayes_quality.judge(documents(odd_rows, clash=True), labels).count() == len(odd_rows)
    assert bayes_quality.judge(documents([]), labels).count() == 0
    assert bayes_quality.judge(documents(odd_rows), labels.limit(0)).count() == len(odd_rows)


def test_sparse_sites_are_drawn_to_the_whole(spark):
    rows = [("big", "p", 0.9)] * 200 + [("small", "p", 0.1)] + [("small", "q", 0.1)] + [("mid", "p", 0.2)] * 30
    df = spark.createDataFrame([(i, h, p, 0.0, x, 0.0, 0.1) for i, (h, p, x) in enumerate(rows)],
                               "doc_id long, host string, path string, r_quality double, p_quality double, r_toxic double, p_toxic double")
    got = bayes_quality.posteriors(df).groupBy("host").agg({"host_quality": "avg"}).collect()
    by = {x["host"]: x["avg(host_quality)"] for x in got}
    assert by["big"] > 0.85 and by["mid"] < 0.5 and 0.3 < by["small"] < 0.9


def test_licences(spark):
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/src/a.txt", "code and code\nmore code"),
        (3, "repo/src/sub/COPYING", "x y z\nThis work is licensed under the GNU General Public License, version 3.\n" + "w " * 90),
        (4, "repo/src/sub/deep/b.txt", "nothing"), (5, "repo/src/c.txt", "text\nLicensed under the Apache License, Version 2.0.\n" + "text " * 20),
        (6, "other/d.txt", None), (7, None, ""), (2, "repo/src/a.txt", "code and code\nmore code"), (8, "top.txt", "licensed words of no licence at all here"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()
    assert len(got) == len(rows)
    by = {x.key: (x.licence, x.origin, x.directory) for x in got}
    assert by[1] == ("MIT", "own", None) and by[2] == ("MIT", "inherited", "repo") and by[3][:2] == ("GPL-3.0", "own")
    assert by[4] == ("GPL-3.0", "inherited", "repo/src/sub") and by[5][:2] == ("Apache-2.0", "own")
    assert all(by[k] == (None, None, None) for k in (6, 7, 8))
    assert licenses.scan(spark.createDataFrame([], "key long, path string, text string")).count() == 0


def test_licence_texts_and_wrapped_headers(spark):
    import textwrap

    wrap = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(text, 70))
    rows = [(0, "p/x.txt", "code")]
    for k, (name, text) in enumerate(licenses.TEXTS.items()):
        rows += [(2 * k + 1, f"l{k}/LICENSE", "Copyright (c) 2024 Someone Else\n\n" + wrap(text)), (2 * k + 2, f"l{k}/src/a.c", "int a;\nint b;")]
    heads = {101: ("GPL-2.0", "# "), 102: ("GPL-3.0", " * "), 103: ("Apache-2.0", "// "), 104: ("AGPL-3.0", "")}
    rows += [(k, f"h/{k}.c", wrap(licenses.HEADERS[n], m) + "\n\n" + "int some_code = other_code;\n" * 40) for k, (n, m) in heads.items()]
    rows += [(105, "h/n.txt", "This program is licensed under the GNU General\nPublic License, version 2.\n\n" + "words of text\n" * 30)]
    rows += [(200 + k, f"z/{k}.txt", f"plain prose {k} about the use of this and that") for k in range(60)]
    by = {x.key: (x.licence, x.origin) for x in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    for k, name in enumerate(licenses.TEXTS):
        assert by[2 * k + 1] == (name, "own") and by[2 * k + 2] == (name, "inherited"), name
    assert {k: by[k] for k in heads} == {k: (n, "own") for k, (n, _) in heads.items()} and by[105] == ("GPL-2.0", "own")
    assert by[0] == (None, None) and all(by[200 + k] == (None, None) for k in range(60))


def test_cosine_against_dense_vectors():
    idf = {t: 1.0 + k % 3 for k, t in enumerate(licenses.template_terms())}
    m = licenses.Matcher(idf, 4.0)
    line = "This file is Licensed under the Apache License, Version 2.0, by us"
    space = sorted(set(idf) | set(licenses.terms(line)))
    vector = lambda t: np.array([licenses.terms(t)[x] * idf.get(x, 4.0) for x in space])
    cos = [vector(line) @ vector(p) / np.linalg.norm(vector(line)) / np.linalg.norm(vector(p)) for _, p in licenses.NOTICES]
    got = m.best(line)
    assert (got is None and max(cos) < licenses.MIN_COSINE) or got[0] == pytest.approx(max(cos))
