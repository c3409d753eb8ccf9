"""The training-data operators on rows with nulls, empties, repeats, long texts and clashing columns, against brute force."""

import json
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, html_extract, line_dedup, lm_score, ngram_join, packing, quality, queries, text_features, topk, toxicity, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [words(rng, rng.randrange(3, 120)) for _ in range(30)]
    near = [" ".join(w if rng.random() > 0.01 else "zzz" for w in b.split()) for b in base[:10]]
    return [*base, *near, base[3], base[3], None, "", "  \n ", "One two", "one  TWO", words(rng, 6000), "a\nb\nlong line of six words here\nb", "c\nlong line of six words here"]


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    kept = ngram_join.keep_one(docs(spark, texts).withColumn("component_id", F.lit(1)))
    assert {r.doc_id for r in kept.collect()} == set(label)


def brute_lines(rows, min_words=5):
    seen, out = {}, []
    split = [None if t is None else t.split("\n") for t in rows]
    windows = []
    for d, lines in enumerate(split):
        for s in range(len(lines or [])):
            for e in range(s + 1, len(lines) + 1):
                if sum(len([w for w in x.split(" ") if w]) for x in lines[s:e]) >= min_words:
                    windows.append((d, s, e))
    for d, s, e in windows:
        seen.setdefault(tuple(split[d][s:e]), (d, s))
    for d, lines in enumerate(split):
        gone = {p for x, s, e in windows if x == d and seen[tuple(lines[s:e])] != (d, s) for p in range(s, e)}
        out.append(None if lines is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out



def test_line_dedup_runs(spark):
    rng = random.Random(4)
    pool = [words(rng, rng.randrange(0, 5), 9) for _ in range(12)] + [""]
    rows = [None, "", *("\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(40))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(spark, rows).withColumn("start", F.lit(0))).collect()}
    want = brute_lines(rows)
    # a document from which every line goes has the empty text
    assert {i: r.text for i, r in got.items()} == dict(enumerate(want))
    assert got[0].n_lines == 0 and got[0].removed_runs == [] and got[1].n_lines == 1
    kept = line_dedup.drop_copied_lines(docs(spark, ["x y z u v", "x y z u v", None, ""])).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3]


def test_decontamination(spark):
    rng = random.Random(2)
    item = words(rng, 40)
    edited = item.split()
    edited[3:4], edited[20] = ["new", "words"], "other"
    far = " ".join(w if i % 2 else "x" for i, w in enumerate(item.split()))
    rows = [f"{words(rng, 50)} {item.upper()}. {words(rng, 9)}", f"{words(rng, 300)} {' '.join(edited)}", words(rng, 500), far, None, "", item, item]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "the end"), (5, words(rng, 30)), (None, "a b c d e f")], "item_id long, text string")
    spans = decontaminate.find_leaks(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in spans} == {(0, 1, 0), (1, 1, 3), (6, 1, 0), (7, 1, 0)}
    assert {(r.doc_id, r.start_word, r.end_word) for r in spans if r.doc_id < 2} == {(0, 50, 90), (1, 300, 341)}
    clean = decontaminate.drop_leaks(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 5] and clean.columns == docs(spark, []).columns
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_edit_distance():
    rng = np.random.default_rng(0)

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
            d = e
        return min(d[j] for j in range(len(b) + 1))

    for _ in range(50):
        n, most = 12, 4
        a, b = rng.integers(0, 4, (1, n)), rng.integers(0, 4, (1, n + most))
        got, _ = decontaminate.edit_distance(a, b, most)
        assert min(got[0], most + 1) == min(plain(a[0], b[0]), most + 1)


def test_recall_of_the_sampled_keys():
    rng = random.Random(3)
    items = [(i, words(rng, rng.randrange(15, 60), 3000)) for i in range(60)]
    index, found = decontaminate.ItemIndex(items, 0.2, 5, 2, 0.99), 0
    for i, t in items:
        w = t.split()
        for k in rng.sample(range(len(w)), len(w) // 5):
            w[k] = "q"
        found += any(s["item_id"] == i for s in decontaminate.spans([" ".join(w)], index)[0])
    assert found >= 0.95 * len(items)


def test_windows_walk_while_an_item_is_open(monkeypatch):
    """An exact copy meets at once and closes what overlaps it; others walk only until they have met the items that they can be near."""
    rng = random.Random(12)
    items = [(i, words(rng, 40, 3000)) for i in range(6)]
    w = items[1][1].split()
    w[5:6], w[20], w[30] = ["new", "words"], "other", "third"
    texts = [f"{words(rng, 99)} {items[0][1]} {words(rng, 99)}", f"{words(rng, 99)} {' '.join(w)} {words(rng, 99)}", words(rng, 500, 3000)]
    index, walked, measured = decontaminate.ItemIndex(items, 0.2, 5, 2, 0.99), [], []
    embed, distance = decontaminate.embed, decontaminate.edit_distance
    monkeypatch.setattr(decontaminate, "embed", lambda x, *a: walked.append(len(x)) or embed(x, *a))
    monkeypatch.setattr(decontaminate, "edit_distance", lambda x, *a: measured.append(len(x)) or distance(x, *a))
    got = decontaminate.spans(texts, index)
    assert [[(s["item_id"], s["start_word"], s["end_word"], s["edits"]) for s in x] for x in got] == [[(0, 99, 139, 0)], [(1, 99, 140, 4)], []]
    windows, draws = walked[0], decontaminate.repetitions(0.2, 2, 0.99)
    assert len(walked) <= draws and sum(walked) < 0.6 * draws * windows and sum(measured) < windows


def test_packing(spark, texts):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = [*texts, "Don't  <|endoftext|> stop\u00a0now\u2003É\u0301 'S İstanbul 12ab!!", "x" * 5000]
    made = packing.pack(docs(spark, rows).withColumn("piece", F.lit("clash")), path, capacity=256, group_rows=20).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(rows)}
    for i, want in ids.items():
        own = sorted((r for r in made if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(want), 256)) and [r.piece for r in own] == list(range(len(own)))
        for r in own:
            piece = want[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes()) and (r.length == 256 or r is own[-1])
    bins = {}
    for r in made:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in made]), 256) + 2
    assert packing.pack(docs(spark, []), path).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(300)]
    rows += [(500, None), (None, [1.0] * 8), (550, [float("nan")] * 8), (600, [1.0] * 7 + [None]), (650, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r)[:4] for r in topk.top_k(df, df.where("vec_id % 50 = 0"), block_rows=64).collect())
    v = {i: np.floor(256 * np.float32(x).astype(float)) for i, x in rows[:300]}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_ties_repeats_lengths_and_large_values(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.5, 0.25]), (3, [0.5, 0.0]), (3, [0.5, 0.5]), (9, [0.5, 9.0]), (50, [1.0, 0.0, 0.0]), (51, [1.0, 2.0, 3.0]), (100, [1e16, 0.0]), (101, [1e30, 0.0]), (102, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("run", F.lit(2))
    got = sorted(tuple(r)[:4] for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=3, block_rows=2).collect())
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if i != 101]
    want = []
    for q, x in v:
        if q % 50 == 0:
            scores = sorted((-min(2**63 - 1, sum(a * b for a, b in zip(x, y))), i) for i, y in v if i != q and len(y) == len(x))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:3])]
    assert got == sorted(want) and len(got) == 3 + 1 + 3


def test_top_k_leaves_lists_unread(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    read = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), block_rows=512).agg(F.avg("read"), F.max("read")).first()
    assert read[0] < 0.3 and read[1] < 1
    # a block that can't reach the carried score isn't read
    values = np.arange(40).reshape(20, 2)
    *found, share = topk.nra_block(np.arange(20), values, np.array([99, 98]), np.array([[1, 1], [-1, 0]]), 2, np.array([1000.0, -1.0]))
    assert share.tolist() == [0, share[1]] and share[1] > 0 and [x.tolist() for x in found] == [[1], [0], [0]]


def test_top_k_sends_no_side_to_all_tasks_and_meets_by_one_exchange_each(spark):
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(700, 4)) * 256)
    df = spark.createDataFrame([(i, [float(c) / 256 for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    made = topk.top_k(df, df, k=3, block_rows=16, chain=2)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange") == 3
    scores = v @ v.T
    want = [(q, r + 1, i, int(scores[q, i])) for q in range(700) for r, i in enumerate(sorted((i for i in range(700) if i != q), key=lambda i: (-scores[q, i], i))[:3])]
    assert sorted(tuple(r)[:4] for r in made.collect()) == want


def test_lm_score(spark, texts):
    rows = docs(spark, texts)
    made = {r.doc_id: r for r in lm_score.score_documents(rows, known_words=50, outputs=20).collect()}
    tokens = {i: (t or "").encode().lower().split() for i, t in enumerate(texts)}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = made[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(x in c for x in [*w, None]), n, i not in train)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]))
        assert r.score < 0


def test_lm_is_normalised():
    words_, counts = np.arange(1, 41).astype(np.uint64), np.arange(40, 0, -1)
    vocabulary = lm_score.Vocabulary(words_, counts, 12, 30, 30 + int(counts.sum()), 41)
    model = lm_score.LogBilinear(vocabulary, 4)
    items = np.delete(np.arange(len(vocabulary.top)), lm_score.OTHER)
    for a, b in ((0, 1), (3, 2)):
        logp = model.log10(np.full(len(items), a), np.full(len(items), b), items)
        assert (10.0**logp).sum() == pytest.approx(1, abs=1e-5)
    other = counts[10:]
    assert ((other + 1).sum() + 1) / vocabulary.other_mass == pytest.approx(1)


def test_lm_words_beyond_the_heads_are_normalised():
    words_, counts = np.arange(1, 41).astype(np.uint64), np.arange(40, 0, -1)
    tail = np.array([[4, 3], [2, 2], [0, 0], *[[1, 1]] * 12])
    vocabulary = lm_score.Vocabulary(words_, counts, 12, 30, 48 + int(counts.sum()), 58, tail, 7)
    model = lm_score.LogBilinear(vocabulary, 4)
    rng = np.random.default_rng(1)
    items = np.delete(np.arange(len(vocabulary.top)), lm_score.OTHER)
    for _ in range(30):  # also after it has learned
        model.learn(*(rng.choice(items, 64) for _ in range(3)), rng, 8)
    a, b = np.full(len(items), 3), np.full(len(items), 20)
    logp = model.log10(a, b, items)
    assert (10.0**logp).sum() == pytest.approx(1, abs=1e-5)
    assert vocabulary.mass.tolist()[:4] == [8, 5, 1, 3] and vocabulary.size == 12 + 5 + 2 and len(set(vocabulary.find(words_)[0].tolist())) == 40

    def slow(item):  # by its path: output, member
        r, v = model.first[3] + model.second[20], vocabulary

        def share(w, bias, k, low, high):
            s = np.exp(w[low:high] @ r + bias[low:high])
            return s[k - low] / s.sum()

        p = share(model.out, model.bias, v.top[item], 0, v.size)
        if item >= v.first_member:
            k = item - v.first_member
            p *= share(model.inner, model.slope, k, v.low[k], v.high[k])
        return math.log10(p)

    assert logp == pytest.approx([slow(i) for i in items], abs=1e-4)


def test_lm_predicts_words_beyond_the_outputs(spark):
    rng = random.Random(8)
    rows = [" ".join(f"x{k} y{k}" for k in (rng.randrange(60) for _ in range(60))) for _ in range(2500)]
    got = [r for r in lm_score.score_documents(docs(spark, rows), outputs=6).collect() if r.held_out]
    assert got and sum(r.score for r in got) > sum(0.95 * r.base_score for r in got)


def test_lm_learns_better_than_counts(spark, sf):
    got = queries.op10_lm_score(spark, "/root/testdata/sf0.01").groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
    assert all(r.s > r.b for r in got)


PAGE = """<html><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-banner">Accept</div><!-- x --><article><h1>T &amp; U</h1>
<p>one <b>two</b>&nbsp;three<script>var a="</p>"</script><p>fo<i>ur</i></p>{more}</article><div id="comments"><p>bad</p></div><aside>side</aside><form>go</form><footer>end</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://a.x/1", PAGE.format(more="")), (2, "http://a.x/2", PAGE.format(more="<ul><li>5</li><li>6</li></ul>")), (3, None, None), (4, "u", ""), (5, "http://b.x", "<p>only</p> text"), (6, "http://a.x/1", PAGE.format(more="")[:230])]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "T & U\none two three\nfour" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "T & U\none two three\nfour\n5\n6"
    assert [got[i].text for i in (3, 4, 5)] == ["", "", "only\ntext"]
    assert got[6].text.startswith("T & U")


def test_html_main_region_by_page(spark):
    long = "long words of an article " * 12
    rows = [(1, None, "<article><p>story</p></article>"), (2, None, "<div><p>no article here</p></div>")]
    rows += [(10 + i, "http://copies.x", f"<div><p>{long}</p></div>") for i in range(6)]
    rows += [(20 + i, "http://news.x", f"<div class=top><p>same line</p></div><div class=text><p>story {i}</p></div>") for i in range(6)]
    rows += [(30, "http://c.x", f"<div class=has-sidebar><article><p>{long}</p></article></div>"), (31, "http://d.x", f"<div class=page-header-wrap><p>{long}</p></div>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1], got[2]) == ("story", "no article here")
    assert {got[i] for i in (*range(10, 16), 30, 31)} == {long.strip()}
    assert [got[20 + i] for i in range(6)] == [f"story {i}" for i in range(6)]


def tokens(found):
    out, open_ = [], []
    for e in found:
        if not e:
            out.append(f"</{open_.pop()}>")
        elif e[0] is None:
            out.append("#")
        else:
            open_.append(e[0])
            out.append(f"<{e[0]}>")
    return "".join(out)


def random_page(rng, depth=0):
    parts = []
    for _ in range(rng.randrange(1, 5)):
        k = rng.randrange(7)
        if k < 3 or depth > 3:
            parts += [f"<p>{words(rng, 3)}</p>"] * rng.randrange(1, 4)
        elif k == 3:
            parts.append(f"<ul>{''.join(f'<li>{words(rng, 2)}</li>' for _ in range(rng.randrange(1, 4)))}</ul>")
        elif k == 4:
            parts += ["<h2>h</h2><p>t</p>"] * rng.randrange(1, 4)
        else:
            parts.append(f"<div class=c{rng.choice('ab')}>{random_page(rng, depth + 1)}</div>")
    return "".join(parts)


def test_wrappers_fit_their_pages():
    rng = random.Random(5)
    for _ in range(60):
        pages = [html_extract.events(random_page(rng)) for _ in range(6)]
        wrapper = html_extract.page_wrapper(pages[0])
        for p in pages[1:]:
            wrapper = html_extract.align(wrapper, html_extract.page_wrapper(p))
        expression = re.compile(html_extract.written(wrapper).replace(".", r"\."))
        assert all(expression.fullmatch(tokens(p)) for p in pages)
        assert json.loads(json.dumps(wrapper)) == wrapper
        # every block finds its slot, and each slot has counted what it holds
        chars = lambda item: item[3] if len(item) == 7 else sum(map(chars, item[2]))  # noqa: E731, B023
        blocks = [e for p in pages for e in p if e and e[0] is None]
        assert chars(wrapper) == sum(len(e[1]) for e in blocks)
        assert all(k == 2 for p in pages for _, _, k in html_extract.matched(p, html_extract.judged(wrapper, 99)))


def test_wrapper_decides_by_place():
    # the same path twice: the text before the story is the same on all pages, the story isn't
    pages = [html_extract.events(f"<div><p>Welcome to the site</p></div><h1>t{i}</h1><div><p>story {i}</p><p>more {i}</p></div>") for i in range(6)]
    wrapper = html_extract.page_wrapper(pages[0])
    for p in pages[1:]:
        wrapper = html_extract.align(wrapper, html_extract.page_wrapper(p))
    assert html_extract.written(wrapper) == "<div><p>#</p></div><h1>#</h1><div>(<p>#</p>)+</div>"
    assert [t for t, _, k in html_extract.matched(pages[2], html_extract.judged(wrapper, 5)) if k == 2] == ["t2", "story 2", "more 2"]


def test_html_of_article_parts_with_telling_names():
    page = "<article><p>one</p><div class='side-effects'><p>two</p></div><div class='notice-of-appeal'>three</div><div class='share-buttons'>x</div><div class=comments>y</div></article>"
    wrapper = html_extract.judged(html_extract.page_wrapper(html_extract.events(page)), 5)
    assert html_extract.page_text(page, wrapper) == "one\ntwo\nthree"


@pytest.mark.parametrize("page", ["<p class=\"a>text " * 8001, "<div>x" * 8000, "<p>a</p>" * 20_000, "a < b " * 8000, "<" * 8000 + "<a" * 8000, "<li>" * 8000 + "</ul>" * 8000, "<a href='" * 8000, "<p>" + "<!--" * 8000])
def test_html_of_odd_pages_takes_linear_time(page):
    began = time.time()
    found = html_extract.events(page)
    html_extract.page_text(page, html_extract.judged(html_extract.page_wrapper(found), 5))
    assert time.time() - began < 5


def test_url_filter(spark):
    urls = [None, "no scheme", "HTTP://A.Example.ORG/es/x?q", "http://example.org/en/12", "https://b.com/fr/1#t", "x://c.com/de/", "http://d.net", "http://d.net?x=/", "http://notexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i + 100, 0) for i in range(30)] + [(6, 0), (None, 1)], "page_id long, good int")
    more = spark.createDataFrame([(i + 100, "http://bad.net/x") for i in range(30)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages.union(more), outcomes, queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(9)] == [
        ("", "", None), ("", "", None), ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.com", "/fr/1", "com/fr/"), ("c.com", "/de/", "com/de/"), ("d.net", "", None), ("d.net", "", None), ("notexample.org", "/es/", "org/"),
    ]
    assert [got[i].verdict for i in (2, 3, 4, 5, 8)] == ["block", "block", "allow", "block", "allow"]
    assert got[100].verdict == "block" and got[0].verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), outcomes.limit(0), []).count() == 0


def test_new_hosts_take_their_parents_reputation(spark):
    bad = [(i, f"http://h{i % 5}.bad.net/x") for i in range(200)]
    good = [(200 + i, f"http://h{i % 5}.good.org/x") for i in range(400)]
    new = [(900, "http://new.bad.net/"), (901, "http://new.good.org/"), (902, "http://else.net/"), (903, "http://a.b.museum/"), (904, None)]
    pages = spark.createDataFrame(bad + good + new, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i >= 200)) for i in range(600)], "page_id long, good int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes, []).collect()}
    assert [got[i].verdict for i in range(900, 905)] == ["block", "allow", "block", "allow", "allow"]  # all pages under .net were bad, of .museum none is known
    assert got[0].reputation < got[900].reputation < got[903].reputation and got[904].reputation is None


def test_suffixes_of_two_labels(spark):
    bad = [(i, f"http://h{i}.bad.co.uk/x") for i in range(60)]
    good = [(60 + i, f"http://h{i}.good.co.uk/x") for i in range(60)]
    pages = spark.createDataFrame([*bad, *good, (900, "http://new.bad.co.uk/"), (901, "http://new.good.co.uk/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "page_id long, good int")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes, []).collect()}
    assert (got[900].verdict, got[901].verdict) == ("block", "allow")
    one = {r.page_id: r for r in url_filter.filter_urls(pages, outcomes, [], two_label=()).collect()}
    assert one[900].reputation == one[901].reputation  # both are hosts of co.uk then


def test_worst_of_repeated_labels(spark):
    rng = random.Random(3)
    rows = [words(rng, 40) + (" awful junk" if i % 2 else "") for i in range(120)]
    once = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, good int")
    again = once.union(spark.createDataFrame([(i, 1) for i in range(120)], "doc_id long, good int"))
    scores = [{r.doc_id: (r.p_document, r.p_quality) for r in quality.score_quality(docs(spark, rows), labels).collect()} for labels in (once, again)]
    assert scores[0] == scores[1]


def labelled(spark, n=200):
    rng = random.Random(6)
    toxic = [i % 4 == 0 for i in range(n)]
    junk = [i % 5 == 0 for i in range(n)]
    rows = [words(rng, 40) + (" vile" if t else "") + (" aaa%%% bbb%%%" if j else "") for t, j in zip(toxic, junk)]
    labels = spark.createDataFrame([(i, int(not j), int(t)) for i, (t, j) in enumerate(zip(toxic, junk))][: n * 3 // 4] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return rows, labels, toxic, junk


def test_toxicity(spark):
    rows, labels, toxic, _ = labelled(spark)
    kept = toxicity.drop_toxic(docs(spark, [*rows, None, ""]).withColumn("p_toxic", F.lit("clash")), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(toxic) if not t} | {len(rows), len(rows) + 1}
    assert toxicity.drop_toxic(docs(spark, rows), labels.limit(0)).count() == len(rows)
    assert toxicity.drop_toxic(docs(spark, []), labels).count() == 0


def test_quality(spark):
    rows, labels, _, junk = labelled(spark)
    good = labels.select("doc_id", (F.col("quality") == 1).cast("int").alias("good"))
    got = quality.score_quality(docs(spark, [*rows, None]), good).collect()
    assert {r.doc_id for r in got if not r.keep} <= {i for i, j in enumerate(junk) if j} | {len(rows)}
    assert sum(r.keep for r in got if r.doc_id < len(rows)) == junk.count(False)
    none = quality.score_quality(docs(spark, rows), good.limit(0)).collect()
    assert {r.p_quality for r in none} == {0.5}


def test_sparse_sites_shrink_to_their_parents(spark):
    rows = [("a", "x", 1)] * 90 + [("a", "y", 0)] * 10 + [("b", "x", 0)]
    base, hosts, paths = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good int"))
    h = {r.host: r.host_post for r in hosts.collect()}
    assert 0 < h["b"] < base < 1 and abs(h["a"] - 0.9) < 0.1


def test_features_read_whole_texts():
    import pyarrow as pa

    t = ["word " * 50_000 + "needle", None, ""]
    found = {i: set() for i in range(3)}
    for first, _, row, feature in text_features.features(pa.array(t), size=1000):
        for r, f in zip(row, feature):
            found[first + r].add(int(f))
    alone = next(text_features.features(pa.array(["needle"])))[3]
    assert set(alone.tolist()) <= found[0] and not found[1] and not found[2]


def test_pipeline(spark, sf):
    import corpus_pipeline

    read = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "pack"]
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert ids and ids <= {r.doc_id for r in read.select("doc_id").collect()} and len(ids) > read.count() // 2


def concentration(rows):
    """rows of (n, k, prior): (1 - rho) / rho by moments."""
    spread = sum(n * (n - 1) * p * (1 - p) for n, _, p in rows)
    if not spread:
        return 2.0
    rho = (sum((k - n * p) ** 2 for n, k, p in rows) - sum(n * p * (1 - p) for n, _, p in rows)) / spread
    rho = min(0.5, max(0.0001, rho))
    return (1 - rho) / rho


def test_quality_by_hand(spark):
    rng = random.Random(9)
    outcomes = [(f"h{h}", f"p{p}", int(rng.random() < (h + 1) / 8)) for h in range(6) for p in range(3) for _ in range(rng.randrange(0, 30))]
    base, hosts, paths = quality.site_posteriors(spark.createDataFrame(outcomes + [("h0", "p0", None)], "host string, path string, good int"))
    n, k = Counter((h, p) for h, p, _ in outcomes), Counter((h, p) for h, p, g in outcomes if g)
    host_n, host_k = Counter(h for h, _, _ in outcomes), Counter(h for h, _, g in outcomes if g)
    want = (sum(k.values()) + 0.5) / (len(outcomes) + 1)
    assert base == pytest.approx(want)
    c = concentration([(host_n[h], host_k[h], want) for h in host_n])
    host = {h: (host_k[h] + c * want) / (host_n[h] + c) for h in host_n}
    assert {r.host: r.host_post for r in hosts.collect()} == pytest.approx(host)
    c = concentration([(n[x], k[x], host[x[0]]) for x in n])
    path = {x: (k[x] + c * host[x[0]]) / (n[x] + c) for x in n}
    assert {(r.host, r.path): r.path_post for r in paths.collect()} == pytest.approx(path)


def test_toxicity_scores_by_hand(spark):
    rows, labels, _, _ = labelled(spark)
    rows = [*rows, None, "", rows[0], rows[0], "vile " * 20_000]
    table = docs(spark, rows).withColumn("row", F.lit("clash")).withColumn("logits", F.lit(1)).withColumn("p_toxic", F.lit("replaced"))
    chain = toxicity.fit(table, toxicity.categories(labels))
    made = toxicity.score(table, chain)
    assert set(made.columns) == {*table.columns, "p_low_quality"} and len(chain.kept) <= 2048
    import pyarrow as pa

    places = {int(f): i for i, f in enumerate(chain.kept)}
    for r in made.collect():
        own = {places[int(f)] for *_, found in text_features.features(pa.array([rows[r.doc_id]], pa.string())) for f in found if int(f) in places}
        before = []
        for model in chain.models:
            x = sum(model.weights[i] for i in own) + sum(w * p for w, p in zip(model.earlier, before)) + model.bias
            before.append(1 / (1 + math.exp(-max(-30, min(30, x)))))
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(tuple(before), abs=1e-6) and r.row == "clash"


def test_decontamination_finds_what_a_search_of_all_places_finds(spark):
    rng = random.Random(11)
    items = {i: [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 40))] for i in range(12)}
    items |= {20: ["w1", "w2"], 21: ["w1"]}  # short ones are looked for as whole texts
    rows = []
    for _ in range(60):
        own = items[rng.randrange(12)][:]
        for _ in range(rng.randrange(0, len(own) // 4 + 1)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = rng.choice([[], ["zz"], ["w5"]])
        rows.append(" ".join([*(f"w{rng.randrange(60)}" for _ in range(rng.randrange(30))), *own, *(f"x{rng.randrange(9)}" for _ in range(rng.randrange(30)))]))
    rows += ["w1 w2", "W1, w2!", "w1", "w1 w2 w3", rows[0], rows[0]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs(spark, rows).withColumn("spans", F.lit(1)), bench).collect()}

    def near(item, text):
        if len(item) < 5:
            return item == text
        d = list(range(len(item) + 1))
        best = d[-1]
        for w in text:
            e = [0]
            for j, x in enumerate(item, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (w != x)))
            d = e
            best = min(best, d[-1])
        return best <= int(0.2 * len(item))

    want = {(d, i) for d, t in enumerate(rows) for i, w in items.items() if near(w, decontaminate.words_of(t))}
    assert found <= want and len(found) >= 0.97 * len(want) and {(60, 20), (61, 20), (62, 21)} <= found
    clash = docs(spark, rows).withColumn("spans", F.lit("kept")).withColumn("row", F.lit(1))
    clean = decontaminate.drop_leaks(clash, bench)
    assert clean.columns == clash.columns and {r.doc_id for r in clean.collect()} == set(range(len(rows))) - {d for d, _ in found}


def test_decontamination_of_very_long_items_and_texts(spark):
    rng = random.Random(12)
    item = words(rng, 3000, 9000)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.find_leaks(docs(spark, ["short", words(rng, 20_000, 9000), f"{words(rng, 500)} {item} end", None]), bench).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.edits) for r in got] == [(2, 500, 3500, 0)]


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = ["a b c d e f\nx", "a b c d e f\ny", None]
    table = docs(spark, rows)
    for c in ("_k1", "_k2", "_runs", "runs", "_lines", "lines", "row", "_text", "_id", "pos", "h1"):
        table = table.withColumn(c, F.lit(c))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table).collect()}
    assert [got[i].text for i in range(3)] == ["a b c d e f\nx", "y", None] and {got[1][c] for c in ("_k1", "_runs", "lines")} == {"_k1", "_runs", "lines"}
    kept = line_dedup.drop_copied_lines(table)
    assert kept.columns == table.columns and {(r.doc_id, r.n_chars, r.row) for r in kept.collect()} == {(0, 13, "row"), (1, 1, "row"), (2, None, "row")}
    # words are parted by any white space; a long line without blanks counts, too
    rows = ["a\tb\u000bc\td e\n1", "a\tb\u000bc\td e\n2", "田" * 120 + "\n3", "田" * 120 + "\n4"]
    assert [r.text.split("\n")[0] for r in line_dedup.dedup_lines(docs(spark, rows)).orderBy("doc_id").collect()] == [rows[0][:9], "2", "田" * 120, "4"]


def test_line_dedup_of_long_runs(spark):
    rng = random.Random(13)
    run = [str(k % 7) if k % 3 else "" for k in range(40)]  # lines of a word at most: windows of several lines
    rows = ["\n".join([*run, *(words(rng, 6) for _ in range(3))]) for _ in range(4)] + ["\n".join(run[5:20]), "\n" * 300, "\n" * 300]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == dict(enumerate(brute_lines(rows)))


def test_packing_certificate(spark):
    rng = random.Random(14)
    rows = [words(rng, rng.randrange(1, 90)) for _ in range(300)] + [None, ""]
    made = packing.pack(docs(spark, rows).withColumn("row_id", F.lit("clash")), queries.tokenizer_path(), capacity=128, group_rows=40)
    rows_ = made.collect()
    bins, bound = packing.certificate(made, 128)
    assert bins == len({r.sequence_id for r in rows_}) and bound == packing.lower_bound(np.array([r.length for r in rows_]), 128) and bound <= bins <= 1.02 * bound + 2  # groups of 40 rows are small


@pytest.mark.parametrize("name", [k for k in queries.queries()])
def test_empty_tables(spark, sf, tmp_path, name):
    for table in ("documents", "labels", "pages", "benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{sf}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_extra_columns_and_repeated_rows(spark):
    rows = ["one two three four five six", "one two three four five six", None, ""]
    table = docs(spark, rows, ids=[1, 1, None, 2])
    for c in ("row_id", "word", "score", "host", "path", "features", "slot", "component_id", "n", "region", "most"):
        table = table.withColumn(c, F.lit("x"))
    scored = lm_score.score_documents(table).collect()
    assert len(scored) == 4 and len({r.score for r in scored if r.doc_id == 1}) == 1 and [r.n_tokens for r in scored if r.doc_id != 1] == [1, 1]
    assert sorted((r.doc_id or 0, r.n_shingles) for r in ngram_join.jaccard_components(table).collect()) == [(0, 0), (1, 2), (1, 2), (2, 0)]
    assert len(quality.score_quality(table, spark.createDataFrame([(1, 1)], "doc_id long, good int")).collect()) == 4
    pages = spark.createDataFrame([(1, "http://a.b", "<p>x</p>", "y"), (1, "http://a.b", "<p>x</p>", "y"), (None, None, None, None)], "page_id long, url string, html string, wrapper string")
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract(pages).collect()) == [(0, ""), (1, "x"), (1, "x")]


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(15)
    text = lambda n=120: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [text() for _ in range(200)]
    toxic = set(range(0, 200, 4))
    rows = [f"{t} vile" if i in toxic else t for i, t in enumerate(rows)]
    item, line = text(30), text(60)
    rows += [rows[1], " ".join([*rows[2].split()[:-1], "other"]), f"{text(40)} {item} {text(9)}", f"{line}\n{text()}", f"{text()}\n{line}", f"{text()} vile", None, ""]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = set(range(208)) - toxic - {200, 201, 202, 205}
    assert {r.doc_id for r in out} == want
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    size = lambda t: len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    rows[204] = rows[204].split("\n")[0]  # the later copy of the line is cut
    assert {r.doc_id: r.length for r in out} == {i: size(rows[i]) for i in want}


def test_lm_sums_by_tables_are_those_of_scores():
    words_, counts = np.arange(5, 305, dtype=np.uint64), np.arange(300, 0, -1)
    tail = np.array([[9, 4], [9, 3], [0, 0]])
    vocabulary = lm_score.Vocabulary(words_, counts, 20, 30, 48 + int(counts.sum()), 308, tail, 17)
    model, rng = lm_score.LogBilinear(vocabulary, 8), np.random.default_rng(2)
    for x in model.parts()[:3]:
        x *= 10
    a, b, item = (rng.integers(0, n, 3000) for n in (len(vocabulary.top), 30, len(vocabulary.top)))
    item[item == lm_score.OTHER] = lm_score.END
    want = []
    for i, j, k in zip(a, b, item):
        r = (model.first[i] + model.second[j]).astype(float)
        s = model.out @ r + model.bias
        own = s[vocabulary.top[k]] - np.log(np.exp(s).sum())
        if k >= vocabulary.first_member:
            m = k - vocabulary.first_member
            rows = slice(vocabulary.low[m], vocabulary.high[m])
            s = model.inner[rows] @ r + model.slope[rows]
            own += s[m - vocabulary.low[m]] - np.log(np.exp(s).sum())
        want.append(own / math.log(10))
    plain = model.log10(a, b, item)
    model.factors(cells=100 * vocabulary.size)  # tables of a part of the rows
    assert len(model.tables[0]) == 100
    assert np.allclose(plain, want, atol=1e-4) and np.allclose(model.log10(a, b, item), want, atol=1e-4)
    # factors beyond exact range leave the tables out
    model.first *= 1e3
    model.tables = tuple(x[:0] for x in model.tables)
    model.factors()
    assert not len(model.tables[0]) and np.isfinite(model.log10(a, b, item)).all()


def test_fit_starts_no_workers_for_rows_of_its_own(spark, monkeypatch):
    rows, labels, toxic, _ = labelled(spark)
    table, given, make = docs(spark, rows), [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: given.append(type(data)) or make(self, data, *a, **b))
    kept = toxicity.drop_toxic(table, labels).collect()
    assert {r.doc_id for r in kept} == {i for i, t in enumerate(toxic) if not t} and list not in given


def test_maps_give_memory_back_after_their_task():
    """Python workers live on: what a task has freed must not stay beside the tasks of later stages."""
    import subprocess
    import sys

    code = """
import sys
import numpy as np, psutil, pyarrow as pa
from textloom.llm import text_features
held = lambda: psutil.Process().memory_full_info().uss / 2**20
rng = np.random.default_rng(1)
texts = lambda: [" ".join(map(str, rng.integers(0, 1 << 40, 150))) for _ in range(8000)]
batch = lambda: pa.RecordBatch.from_arrays([pa.array(np.arange(8000)), pa.array(texts())], names=["key", "text"])
task = lambda: sum(out.num_rows for out in text_features._featured(batch() for _ in range(2)))
before = held()
assert task() == 16000
print(held() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=packing.__file__.rsplit("/", 3)[0])
    assert float(done.stdout) < 57, done.stdout  # 40 MB; 74 if nothing is given back
