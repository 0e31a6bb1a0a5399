"""Circulant MinHash, whitening and spelling variants: edge cases and brute force."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from tessera.llm import circulant, spelling, whitening

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def read(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").df()


# -------------------------------------------------------- circulant MinHash

def word_set(text, size=2):
    w = (text or "").encode().lower().split()
    k = min(size, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def linked_components(sets, percent=80):
    """Least index reachable, for a list of sets, by comparing all pairs."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def near_texts(seed):
    """Groups of copies whose likeness lies around the threshold, chains,
    short texts and strangers that share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for group in range(6):
        base = rng.choices(words, k=60)
        for _ in range(25):
            copy = list(base)
            for at in rng.sample(range(60), rng.choice([1, 2, 3, 4, 5])):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * 3
    chain = rng.choices(words, k=80)
    for step in range(12):
        chain = chain[4:] + rng.choices(words, k=4)
        texts.append(" ".join(chain))
    passage = rng.choices(words, k=40)
    texts += [" ".join(passage + rng.choices(words, k=15)) for _ in range(40)]
    texts += [" ".join(rng.choices(words[:4], k=k)) for k in range(1, 8) for _ in range(4)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block,broadcast", [(1024, 1024), (7, 0)])
def test_near_duplicates_are_the_components_of_all_pairs(spark, monkeypatch, block, broadcast):
    """In one block, and with buckets and components in many small ones."""
    monkeypatch.setattr(circulant, "BLOCK", block)
    monkeypatch.setattr(circulant, "BROADCAST_ROWS", broadcast)
    texts = near_texts(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    o = circulant.near_duplicates(df).orderBy("doc_id").collect()
    sets = [word_set(t) for t in texts]
    assert [r.component_id for r in o] == linked_components(sets)
    assert [r.n_shingles for r in o] == list(map(len, sets))
    assert all(r.kept == (r.doc_id == r.component_id) for r in o)


def test_shared_counts_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, top, n, dtype=np.uint64)) for top in (30, 300, 10 ** 6) for n in (1, 5, 40, 200, 200, 200)]
    sets += [sets[4]] * 20
    want = [[np.intersect1d(a, b).size for b in sets] for a in sets]
    for rare, columns in ((16, 8192), (2, 7), (100, 50)):
        got = circulant.shared_counts(sets, rare, columns)
        np.fill_diagonal(got, 0)
        assert (got == np.array(want) - np.diag(np.diag(want))).all()


def test_near_duplicates_edges(spark):
    schema = "doc_id long, text string, label long, node long, key string, n long, a long"
    long_text = " ".join(f"w{i % 977}" for i in range(120_000))
    rows = [(1, "one two three"), (2, "One  TWO\tthree"), (2, "One  TWO\tthree"), (3, None), (4, ""), (5, " \n "), (None, "one two three"),
            (6, "word"), (7, "WORD"), (8, "word word"), (9, long_text), (10, long_text + " end"), (None, None), (None, "alone here"), (11, "É é")]
    df = spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in rows], schema)
    o = circulant.near_duplicates(df).collect()
    assert len(o) == len(rows)
    by = defaultdict(list)
    for r in o:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(2, 1, True)] and by[2] == [(2, 1, False)] * 2
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(1, 6, True)] and by[7] == [(1, 6, False)] and by[8] == [(1, 8, True)]
    assert by[9][0][1] == by[10][0][1] == 9
    assert sorted(by[None], key=str) == sorted([(2, 1, False), (0, None, True), (1, None, True)], key=str)
    assert circulant.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        circulant.near_duplicates(df, percent=50)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8, 0.95):
        got = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, int(600 * share), dtype=np.uint64)
            own = [rng.integers(0, 1 << 63, int(600 * (1 - share) / 2), dtype=np.uint64) for _ in "ab"]
            a, b = (circulant.signature(np.unique(np.concatenate([both, x]))) for x in own)
            got.append((a == b).mean())
        assert abs(np.mean(got) - share) < 0.03
    x = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert (circulant.signature(x) == circulant.signature(x, step=37)).all()
    assert np.unique(circulant._permute(np.arange(1 << 16, dtype=np.uint32) * np.uint32(65_537), 0x7FEB352D, 0x846CA68B)).size == 1 << 16


# ---------------------------------------------------------------- whitening

def brute_whitening(vectors, components=16):
    """Exact covariance of the distinct integer vectors, numpy's eigenvectors."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, dim = len(fit), len(x[0])
    s = [sum(v[d] for v in fit) for d in range(dim)]
    z = [[Fraction(n * v[d] - s[d], n) for d in range(dim)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in z) / n) for j in range(dim)] for i in range(dim)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    deviation = [sum((n * v[d] - s[d]) ** 2 for d in range(dim)) for v in x]
    centred = np.array([[float(Fraction(n * v[d] - s[d], n)) for d in range(dim)] for v in x])
    k = min(components, dim)
    return n, deviation, centred @ (vecs[:, :k] / np.sqrt(values[:k])), values[:k] / np.trace(cov)


@needs_tables
def test_op12_against_exact_covariance(spark):
    name = next(n for n in E.queries() if n.startswith("op12_"))
    o = E.queries()[name](spark, SF).toPandas().sort_values(["vec_id", "component"])
    rows = read("embeddings").sort_values("vec_id")
    n, deviation, white, explained = brute_whitening([v[:64] for v in rows.embedding])
    assert o.component.tolist() == list(range(1, 17)) * len(rows) and (o.n == n).all()
    assert o.deviation.tolist() == [d for d in deviation for _ in range(16)]
    got = o.whitened.to_numpy().reshape(-1, 16)
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-9
    assert np.allclose(o.explained.to_numpy()[:16], explained, rtol=1e-12)
    assert o.identity_error.nunique() == 1 and o.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), np.r_[np.ones(10), 1 + 1e-9 * np.arange(10), np.linspace(2, 3, 20)],
    np.r_[np.ones(20), 2 * np.ones(20)], np.r_[1 + 1e-13 * np.arange(5), 1e-8 * np.arange(1, 6), 5], np.ones(8),
    np.r_[np.zeros(4), 1, 2], np.logspace(-6, 6, 40), 1e30 * np.linspace(1, 2, 10), np.zeros(3)], ids=range(9))
def test_eigenvectors_to_double_precision(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.normal(size=(len(values),) * 2))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.refined_eigenvectors(a)
    size = np.abs(values).max() or 1
    x = x.astype(np.longdouble)
    assert np.abs(a.astype(np.longdouble) @ x - x * e).max() <= 3e-16 * size
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 3e-16
    assert (np.diff(e) <= 0).all() and np.allclose(e, np.sort(values)[::-1], atol=1e-14 * size)


def test_float32_alone_is_not_enough():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 50))
    a = a + a.T
    _, rough = np.linalg.eigh(a.astype(np.float32))
    e, x = whitening.refined_eigenvectors(a)
    left = [np.abs(a @ v - v * np.einsum("ij,ij->j", v, a @ v)).max() for v in (rough.astype(float), x)]
    assert left[0] > 1e-7 and left[1] < 1e-13


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    schema = "vec_id long, embedding array<float>, n long, x string, w long, component string"
    good = [(i, [float(i % 3), float(i % 5) / 7, -0.3 * i]) for i in range(12)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 1.0]), (93, [inf, 1.0, 1.0]), (94, [-inf, 0.0, 0.0]),
           (95, [3e30, 0.0, 0.0]), (96, [1.0, 2.0]), (97, [])]
    more = [(0, good[0][1]), (0, good[0][1]), (None, good[5][1])]
    df = spark.createDataFrame([(*r, 1, "x", 2, "c") for r in good + bad + more], schema)
    o = whitening.whiten(df).toPandas()
    assert len(o) == 3 * (len(good) + len(more)) and set(o.component) == {1, 2, 3} and (o.n == 12).all()
    f32 = [[float(np.float32(c)) for c in v] for _, v in good]
    _, deviation, white, explained = brute_whitening(f32)
    got = o[o.vec_id.notna()].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    assert got.deviation.tolist()[::3] == deviation and abs(got.explained.iloc[0] - explained[0]) < 1e-12
    assert np.abs(np.abs(got.whitened.to_numpy().reshape(-1, 3)) - np.abs(white)).max() < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 97")).count() == 0
    same = whitening.whiten(df.filter("vec_id = 0")).toPandas()
    assert len(same) == 9 and same.whitened.isna().all() and same.deviation.eq(0).all() and same.identity_error.isna().all()
    # one direction without variance: null there only
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat).toPandas()
    assert rows[rows.component == 2].whitened.isna().all() and rows[rows.component == 1].whitened.notna().all()


def test_whitening_of_large_entries_is_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1e12, 1e12) for _ in range(3)]) for i in range(50)]
    o = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    n, deviation, white, _ = brute_whitening([v for _, v in rows])
    got = o.sort_values(["vec_id", "component"])
    assert [None if d != d else int(d) for d in got.deviation[::3]] == [d if d < 2 ** 63 else None for d in deviation]
    assert np.abs(np.abs(got.whitened.to_numpy().reshape(-1, 3)) - np.abs(white)).max() < 1e-9


# ----------------------------------------------------------------- spelling

def brute_words(docs, least=7, every=31):
    counts = Counter()
    for doc_id, text in docs:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", lower)).items():
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += n
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    near = defaultdict(set)
    by = defaultdict(set)
    for w in words:  # words one edit apart share one of these
        for i in range(len(w)):
            by[w[:i] + w[i + 1:]].add(w)
        by[w].add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda u: (-words[u], u))
            if words[best] >= 10 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def as_dict(rows):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@needs_tables
def test_op13_against_brute_force(spark):
    name = next(n for n in E.queries() if n.startswith("op13_"))
    docs = read("documents")
    rows = E.queries()[name](spark, SF).collect()
    want = brute_variants(brute_words(zip(docs.doc_id, docs.text)))
    assert len(rows) == len(want) and as_dict(rows) == want


def test_spelling_of_dense_words(spark):
    """Words over three letters: many neighbours, long shared prefixes, chains of forms."""
    rng = random.Random(4)
    docs = []
    for i in range(60):
        docs.append((i, " ".join("".join(rng.choices("abé", k=rng.randint(7, 9))) for _ in range(80))))
    docs += [(100 + i, "colour " * 1 + "colours colorful " * 2) for i in range(3)]
    docs += [(200, "aaaaaaa " * 3000 + "aaaaaab " * 250 + "aaaaabb " * 20 + "aaaabbb aaaabbb")]
    docs += [(300, "x" * 500 + " " + "x" * 499 + " " + "x" * 500 + " " + "x" * 499)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = as_dict(spelling.spelling_variants(df).collect())
    assert got == brute_variants(brute_words(docs))


def test_spelling_edges(spark):
    schema = "doc_id long, text string, word string, n long, form string, node string"
    texts = [(1, None), (2, ""), (3, " \t 123 ,, "), (4, "Straßen STRASSEN straßen straßem straßem"), (None, "nothing nothing nothin nothin"),
             (5, "naïvely×naïvely÷naïvety naïvety"), (6, "łódźłódź łódź abcdefgł abcdefg abcdefg 漢字abcdefh漢字abcdefh"),
             (7, "repeated row"), (7, "repeated row"), (8, "ABCDEFGÀ ABCDEFGà abcdefgà"), (9, "éclairs éclairs eclairs eclairs")]
    df = spark.createDataFrame([(*t, "w", 1, "f", "x") for t in texts], schema)
    assert as_dict(spelling.spelling_variants(df).collect()) == brute_variants(brute_words(texts))
    assert spelling.spelling_variants(df.limit(0)).count() == 0
    assert spelling.spelling_variants(df.filter("doc_id < 4")).count() == 0
    whole = spelling.word_counts(df, every=10 ** 9).select("word").collect()
    assert {"straßen", "repeated", "nothing", "abcdefgà"} <= {r.word for r in whole}


def test_runs_are_those_of_the_pattern():
    rng = random.Random(0)
    letters = "aZéÀÿ×÷ĀłÅß \n-_0漢😀́ªµ¿"
    for _ in range(300):
        text = "".join(rng.choices(letters, k=30))
        lower = text.translate({c: c + 32 for c in range(65, 91)})
        assert [r.decode() for r in spelling.runs(text.encode())] == re.findall("[A-Za-zÀ-ÿ]+", lower)


def test_roots_follow_long_chains(spark):
    df = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(df).collect()}
    assert got == {**{f"w{i}": "w37" for i in range(37)}, "x": "w37"}
    assert spelling.roots(df.limit(0)).count() == 0


def test_unknown_neighbours_at_task_ends_keep_pairs(spark):
    words = ["abcdefgh", "abcdefgx", "abcdefg", "zbcdefgh", "abcdefghi", "hgfedcba", "hgfedcbx"]
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(7)
    got = {(r.word, r.other) for r in spelling.neighbours(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


# -------------------------------------------------- pages in time of their length

PIECES = {"nested": ("<div>", ""), "unclosed tags": ("<a ", ""), "scripts": ("<script>", ""), "ads": ("<div class=ad>", ""),
          "comments": ("<!--", ""), "cdata": ("<![CDATA[>", ""), "inline": ("<b>", "</i>"), "ends": ("<div>", "</p>"),
          "items": ("<ul><li><div>", ""), "cells": ("<p><table><td><div>", ""), "noscript": ("<noscript>x", ""),
          "quotes": ("<a b=\">'<c d='>", ""), "signs": ("< ", ""), "forms": ("<form><nav>", ""), "bang": ("<!x ", "")}


@pytest.mark.parametrize("name", PIECES)
def test_broken_pages_of_a_megabyte(name):
    import time
    from tessera.llm import html_extract, langid
    a, b = PIECES[name]
    n = 1_000_000 // len(a + b)
    page = "<p>before</p>" + a * n + b * n + "<p>after"
    model = html_extract.potentials({})
    for f in (lambda: html_extract.main_text(page, model), lambda: langid.visible_text(page)):
        began = time.process_time()
        f()
        assert time.process_time() - began < 12  # linear: about a second on a free machine; quadratic takes many minutes


def test_visible_text_leaves_furniture_out():
    from tessera.llm.langid import visible_text
    page = ("<html><HEAD><title>t</title></head><p>a<!-- c --> b</p><div class='ad big'>buy</div><div class=x>keep</div>"
            "<section class=\"menu\">m</section><script>s</SCRIPT >d<style>unclosed e<nav>n</nav>f<footer>gone")
    assert visible_text(page).split() == "a b keep d unclosed e f".split()
    assert visible_text("x <!-- open <b>y</b>").split() == ["x", "y"] and visible_text(None) == ""


def test_math_examples_and_page_wide_forms_are_text():
    from collections import Counter
    from tessera.llm import html_extract as h
    pages = ["<html><nav><a>home</a></nav><article><h1>Title of it</h1><p>Some words of the text here.</p></article><footer>f</footer></html>"] * 30
    counts = Counter()
    for p in pages:
        h.count_page(p, counts)
    model = h.potentials(counts)
    assert h.main_text("<article><p>The sum <math><mi>x</mi><mo>+</mo></math> is 1</p></article>", model) == "The sum x+ is 1"
    assert h.main_text("<article><p>a word</p><xmp><b> &lt; </xmp><p>more words</p></article>", model) == "a word\n<b> &lt;\nmore words"
    body = "<nav><a>home</a></nav><article><h1>T</h1><p>All the words of the text.</p></article>"
    assert h.main_text(f"<form action=/>{body}</form>", model) == "T\nAll the words of the text."
    assert h.main_text(f"<div>{body}<form>Name <input> Mail</form></div>", model) == "T\nAll the words of the text."
    assert h.main_text("only text &amp; more", h.potentials({})) == "only text & more"


def test_a_page_is_no_evidence_for_itself(spark):
    """On a host of one page the host says what the others of its domain say."""
    from tessera.llm import langid
    texts = [("en", "the house and the river with this one"), ("de", "das haus und der fluss mit diesem einen")] * 30
    model = langid.train_text_model(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string"))
    one = "<p>das haus und der fluss"
    pages = spark.createDataFrame([(1, "http://a.x.org/", one)] + [(10 + i, f"http://b.y.com/{i}", "<p>the river and the house") for i in range(20)],
                                  "page_id long, url string, html string")
    alone = langid.identify(pages, model).where("page_id = 1").first()
    p = model.posterior(langid.visible_text(one))
    base = np.array([sum(model.posterior(langid.visible_text(r.html))[i] for r in pages.collect()) for i in range(2)])
    base = (base + 0.5) / (base.sum() + 1)
    every = langid.identify(pages, model)
    # domain and host hold no other page: both priors are the whole's; markup and suffix of others
    rest = base * 0 + np.array([sum(model.posterior("the river and the house")[i] for _ in range(20)) for i in range(2)])
    markup = (rest + langid.SMOOTHING * base) / (20 + langid.SMOOTHING)
    logs = np.log(p) + np.log(base) + np.log(markup / base)
    assert abs(alone.confidence - np.exp(logs - logs.max()).max() / np.exp(logs - logs.max()).sum()) < 1e-9
    assert every.count() == 21
