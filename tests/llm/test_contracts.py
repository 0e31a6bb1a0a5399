"""The registered queries over the driver tables against brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import imatch
from tessera.llm.common import row_hash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def read(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def of(prefix):
        if prefix not in done:
            name = next(n for n in E.queries() if n.startswith(prefix))
            done[prefix] = E.queries()[name](spark, SF).toPandas()
        return done[prefix]
    return of


def simhash(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(fps, distance=4):
    u = sorted(set(fps))
    parent = {x: x for x in u}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    a = np.array(u, dtype=np.uint64)
    for i, x in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= distance):
            parent[find(u[i + 1 + int(j)])] = find(x)
    return [find(x) for x in fps]


def test_op1_targets_and_words(result):
    o, docs = result("op1_"), read("documents")
    assert sorted(o.doc_id) == sorted(docs.doc_id)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    size = {i: len(word.findall(t or "")) for i, t in zip(docs.doc_id, docs.text)}
    assert all(size[i] == n for i, n in zip(o.doc_id, o["size"]))
    total = docs.assign(n=docs.doc_id.map(size)).groupby("source").n.sum()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total.index, key=str.encode))}
    left, budget, target = set(total.index), 1.5 * total.sum(), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * total[s]]
        if not over:
            target.update({s: level * weight[s] for s in left})
            break
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
            left.remove(s)
    by = o.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert all(abs(by.target[s] - target[s]) < 1e-6 and abs(by.taken[s] - target[s]) < 1.001 for s in target)
    assert (o.taken <= 2 * o["size"]).all()


def test_op2_fingerprints_and_components(result):
    o, docs = result("op2_"), read("documents")
    text = dict(zip(docs.doc_id, docs.text))
    assert sorted(o.doc_id) == sorted(docs.doc_id)
    fps = [int(f, 16) for f in o.fingerprint]
    assert fps == [simhash(text[i]) for i in o.doc_id]
    assert (o.assign(root=roots(fps)).groupby("root").doc_id.transform("min") == o.component_id).all()


def test_op3_read_back(result):
    o, c = result("op3_"), read("conversations")
    k = "<|im_end|><|im_start|>assistant ok"
    c = pd.concat([c, pd.DataFrame({"conv_id": -1, "turn": [0, 1], "role": ["user", "assistant"], "text": [k, k]})])
    want = {}
    for conv, g in c.sort_values("turn").groupby("conv_id"):
        said = "".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text))
        loss = "".join(t for r, t in zip(g.role, g.text) if r == "assistant")
        want[conv] = (len(g), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in o.itertuples()} == want


def test_op4_held_out_ranking(result):
    o = result("op4_")
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(o.doc_id, o.held_out))
    assert o.score.between(0, 1).all() and ((o.score >= 0.3) == (o.predicted == 1)).all()


def test_op4_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    o = E.queries()["op4_toxicity"](spark, sf).toPandas().merge(read("labels", sf), on="doc_id")
    o = o[o.held_out]
    rank, toxic = o.score.rank(), o.toxic == 1
    n, m = toxic.sum(), (~toxic).sum()
    assert (rank[toxic].sum() - n * (n + 1) / 2) / (n * m) > 0.93
    assert o.predicted[toxic].mean() > 0.85 and o.toxic[o.predicted == 1].mean() > 0.85


def test_op5_law(result):
    o, docs = result("op5_"), read("documents")
    text = {i: (t or "").encode() for i, t in zip(docs.doc_id, docs.text)}
    assert sorted(o.doc_id) == sorted(docs.doc_id)
    assert all(s == len(text[i]) + 1 and c == zlib.crc32(text[i]) for i, s, c in zip(o.doc_id, o["size"], o.text_crc32))
    n = o.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(n) == 16 and n["size"].max() - n["size"].min() <= 1
    assert (n["max"] == n["size"] - 1).all() and (n["nunique"] == n["size"]).all()
    assert (o.law == "rows").all() and o.grown_shard.isna().all()


def test_op6_article_blocks(result):
    import html
    o, pages = result("op6_"), read("pages")
    page = dict(zip(pages.page_id, pages.html))
    for r in o.itertuples():
        body = re.search(r"<article>(.*?)(</article>|$)", page[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_op7_rules(result):
    o, pages = result("op7_"), read("pages")
    url = dict(zip(pages.page_id, pages.url))
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]
    assert sorted(o.page_id) == sorted(pages.page_id)
    for r in o.itertuples():
        rest = (url[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(q), a, q) for a, q in rules
                if (host == q.split("/")[0] or host.endswith("." + q.split("/")[0]))
                and path.startswith("/" + q.partition("/")[2])]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        assert (r.rule, r.verdict) == (max(fits)[2], max(fits)[1]) if fits else r.rule is None


def test_op8_edited_texts(result):
    o = result("op8_")
    docs = read("documents").sort_values("doc_id", ascending=False)
    texts = [t or "" for t in docs.text]
    want, same = {}, {}
    for i, a, b in zip(docs.doc_id, texts, texts[1:] + texts[:1]):
        want[i] = (len(a), hashlib.sha256((a[:len(a) - len(a) // 2] + b[:len(a) // 2]).encode()).hexdigest())
        same[i] = a == b
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in o.itertuples()} == want
    prints = o.assign(text=o.doc_id.map(dict(zip(docs.doc_id, texts)))).groupby("text").fingerprint.nunique()
    assert (prints == 1).all()
    other = o[~o.doc_id.map(same)]
    assert other.near_edited.between(0, 1).all() and (other.near_edited > other.near_next).mean() > 0.9
    assert (o[o.doc_id.map(same)].near_next == 1).all()


def test_op9_language(result):
    o = result("op9_").merge(read("pages"), on="page_id")
    assert len(o) == len(read("pages"))
    declared = o.html.str.extract(r'<html lang="(\w+)"')[0]
    assert (o.lang == declared).mean() > 0.97 and (o.text_lang == declared).mean() > 0.95


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(lower))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for text in docs:
        w = word.findall((text or "").translate(lower))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i:i + n]), ())
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_op10_windows(result):
    o, docs, items = result("op10_"), read("documents"), read("benchmark")
    want = dict(zip(docs.doc_id, contamination(docs.text, zip(items.item_id, items.text))))
    for r in o.itertuples():
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


def plain_copies(rows, weights=(5, 2, 1), share=1.5, most=2):
    """How often a mix has each row ``(key, size, source)``: every source a
    queue in key order, offered again until its quota of words is taken."""
    total = {}
    for _, n, s in rows:
        total[s] = total.get(s, 0) + n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, budget, target = set(names), share * sum(total.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > most * total[s]]
        for s in full or left:
            target[s] = most * total[s] if full else level * weight[s]
        budget -= sum(most * total[s] for s in full)
        left -= set(full or left)
    copies, upto = {}, 0.0
    for s in names:
        quota = int(np.floor(upto + target[s] + 1e-6)) - int(np.floor(upto + 1e-6))
        upto += target[s]
        queue = sorted((k, n) for k, n, of in rows if of == s)
        at = 0
        for _ in range(most):
            for k, n in queue:
                took = min(n, quota - at)
                if n and took > 0 and 2 * took >= n:
                    copies[k] = copies.get(k, 0) + 1
                at += n
    return copies


def test_pipeline_stage_by_stage(spark, tmp_path, result):
    """Each stage over what the one before it kept, against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == len(corpus_pipeline.STAGES) - 1 or after.columns == docs.columns
        kept[name] = (docs.toPandas(), after.toPandas())
        docs = after
    before, after = kept["toxicity"]
    scored = result("op4_")
    assert sorted(after.doc_id) == sorted(scored[scored.predicted == 0].doc_id) and 0 < len(after) < len(before)
    before, after = kept["near_duplicates"]
    fps = [simhash(t) for t in before.text]
    least = before.assign(root=roots(fps)).groupby("root").doc_id.min()
    assert sorted(after.doc_id) == sorted(least)
    before, after = kept["decontamination"]
    items = read("benchmark")
    hits = contamination(before.text, zip(items.item_id, items.text))
    assert sorted(after.doc_id) == sorted(i for i, h in zip(before.doc_id, hits) if not h[1])
    before, after = kept["mixing"]
    assert set(after.doc_id) <= set(before.doc_id) and after.groupby("doc_id").size().max() <= 2
    rows = spark.read.parquet(f"{tmp_path}/2")
    keyed = rows.select("doc_id", F.lower(F.lpad(F.hex(row_hash(rows, 11)), 16, "0")).alias("key")).toPandas()
    key = dict(zip(keyed.doc_id, keyed.key))
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = plain_copies([(key[r.doc_id], len(word.findall(r.text or "")), r.source) for r in before.itertuples()])
    assert {key[i]: n for i, n in after.groupby("doc_id").size().items()} == want
    before, after = kept["sharding"]
    assert sorted(after.doc_id) == sorted(before.doc_id)
    n = after.groupby("shard").slot.agg(["size", "max"])
    assert n["size"].max() - n["size"].min() <= 1 and (n["max"] == n["size"] - 1).all()


def test_op8_fingerprints_and_likeness_in_plain_python(result):
    """Every part, and the likeness to the edited and the next text, over the whole table."""
    o = result("op8_").set_index("doc_id")
    docs = read("documents").sort_values("doc_id", ascending=False)
    texts = [t or "" for t in docs.text]
    words = [{xxhash.xxh64_intdigest(w) & ~1 for w in t.encode().lower().split()} for t in texts]
    df = {}
    for w in words:
        for x in w:
            df[x] = df.get(x, 0) + 1
    n = len(texts)
    band = {x for x, k in df.items() if k > 1 and k * imatch.RARE >= n and k * imatch.COMMON <= n}
    common = {x for x, k in df.items() if k > 1 and k * imatch.COMMON > n}
    factors, full = [int(f) for f in imatch._FACTORS[:, 0]], (1 << 64) - 1
    rates = [h for h in range(imatch.HALVINGS) for _ in range(imatch.EACH)] + [
        h for h in range(imatch.HALVINGS_OTHER) for _ in range(imatch.EACH_OTHER)]

    def parts(text):
        terms = {xxhash.xxh64_intdigest(w) & ~1 for w in text.encode().lower().split()}
        terms = sorted((terms - common) or terms)
        out = []
        for i, (f, h) in enumerate(zip(factors, rates)):
            total, some = 0, False
            for t in terms:
                if (t in band) == (i < imatch.KNOWN) and ((t >> 32) * f) % (1 << 32) < (1 << 32 >> h):
                    t |= t in band
                    total, some = (total + ((t ^ (t >> 29)) * 0x9E3779B97F4A7C15)) & full, True
            total = (((total ^ (total >> 32)) * 0x9E3779B97F4A7C15) & full) >> 48
            out.append(max(total, 1) if some else 0)
        return out

    def expected_misses(each, halvings, k):
        return sum(each * (1 - 0.5 ** h) ** k for h in range(halvings))

    def terms_for(each, halvings, misses):
        lo, hi = 0.0, 1e6
        if misses >= each * halvings:
            return 0.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if expected_misses(each, halvings, mid) > misses else (lo, mid)
        return lo

    def like(a, b):
        apart = together = 0.0
        for at, to, each, halvings, weight in ((0, imatch.KNOWN, imatch.EACH, imatch.HALVINGS, 1.0), (
                imatch.KNOWN, imatch.LEXICONS, imatch.EACH_OTHER, imatch.HALVINGS_OTHER, imatch.OUTSIDE)):
            apart += weight * terms_for(each, halvings, sum(x == y for x, y in zip(a[at:to], b[at:to])))
            together += weight * terms_for(each, halvings, sum(x == y == 0 for x, y in zip(a[at:to], b[at:to])))
        return 1 - apart / together if together else 1.0
    own = [parts(t) for t in texts]
    for i, doc_id in enumerate(docs.doc_id):
        following = texts[(i + 1) % n]
        half = len(texts[i]) // 2
        changed = parts(texts[i][:len(texts[i]) - half] + following[:half])
        r = o.loc[doc_id]
        assert r.fingerprint == "".join(f"{x:04x}" for x in own[i]) and r.edited_fingerprint == "".join(f"{x:04x}" for x in changed)
        assert abs(r.near_edited - like(own[i], changed)) < 0.01 and abs(r.near_next - like(own[i], own[(i + 1) % n])) < 0.01


def plain_templates(paths, most=32):
    """``{(host, path): template}`` for ``{(host, path): urls}``, node by node."""
    variable = lambda s: bool(re.search("[0-9]", s)) or len(s) > 40
    out, level = {}, {}
    for (host, path), n in paths.items():
        level.setdefault((host, ""), []).append((path, path.split("/")[1:], n))
    while level:
        deeper = {}
        for (host, template), rows in level.items():
            kids = {}
            for _, rest, n in rows:
                if rest and not variable(rest[0]):
                    kids[rest[0]] = kids.get(rest[0], 0) + n
            total = sum(kids.values())
            rare = {s for s, n in kids.items() if len(kids) > most and n * most < total}
            for path, rest, n in rows:
                if len(rows) <= most or not rest:
                    out[host, path] = template + "".join("/" + ("*" if variable(s) else s) for s in rest)
                else:
                    s = "*" if variable(rest[0]) or rest[0] in rare else rest[0]
                    deeper.setdefault((host, f"{template}/{s}"), []).append((path, rest[1:], n))
        level = deeper
    return out


def plain_url_judgement(urls, rules, z_limit=1.96, smoothing=4.0, least=0.5):
    """``{(host, path): (rule, verdict)}``: rules, templates, merged siblings, smoothed purity."""
    paths = {}
    for u in urls:
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        key = ("".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^/?#]*([^?#]*)", rest).group(1))
        paths[key] = paths.get(key, 0) + 1
    fits = {}
    for host, path in paths:
        found = [(len(q), a, q) for a, q in rules if (host == q.split("/")[0] or host.endswith("." + q.split("/")[0]))
                 and path.startswith("/" + q.partition("/")[2])]
        fits[host, path] = max(found)[1:] if found else (None, None)
    templates = plain_templates(paths)
    t = {}
    for key, n in paths.items():
        a, b = t.get((key[0], templates[key]), (0, 0))
        action = fits[key][0]
        t[key[0], templates[key]] = (a + n * (action == "allow"), b + n * (action == "block"))
    whole = [sum(x) for x in zip(*t.values())]
    overall = (whole[0] + 1) / (sum(whole) + 2)

    def branch(template):
        literal = re.match(r"^(.*?)((?:/\*{1,2}|/)*)$", template).group(1)
        m = re.match(r"^(.*)/[^/]*$", literal)
        return literal, m.group(1) if m else ""
    branches, node = {}, {}
    for (host, template), (a, b) in t.items():
        literal, above = branch(template)
        for d, k in ((branches, (host, above, literal)), (node, (host, above))):
            x = d.get(k, (0, 0))
            d[k] = (x[0] + a, x[1] + b)
    merged, pool = {}, {}
    for (host, above, literal), (a, b) in branches.items():
        na, nb = node[host, above]
        n, m = a + b, na + nb - a - b
        p = (na + 1) / (na + nb + 2)
        z = abs((a + p) / (n + 1) - (na - a + p) / (m + 1)) / np.sqrt(p * (1 - p) * (1 / (n + 1) + 1 / (m + 1)))
        merged[host, above, literal] = n > 0 and m > 0 and z < z_limit
        if merged[host, above, literal]:
            x = pool.get((host, above), (0, 0))
            pool[host, above] = (x[0] + a, x[1] + b)
    everywhere = {}
    for (_, template), (a, b) in t.items():
        x = everywhere.get(template, (0, 0))
        everywhere[template] = (x[0] + a, x[1] + b)
    out = {}
    for key in paths:
        action, rule = fits[key]
        template = templates[key]
        literal, above = branch(template)
        a, b = pool[key[0], above] if merged[key[0], above, literal] else branches[key[0], above, literal]
        ea, eb = everywhere[template]
        prior = (ea + smoothing * overall) / (ea + eb + smoothing)
        purity = (a + smoothing * prior) / (a + b + smoothing)
        out[key] = (rule, action or ("allow" if purity >= least else "block"), template, None if rule else purity)
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op7_against_a_plain_version(spark, sf):
    folder = f"/root/testdata/{sf}"
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    o = E.queries()["op7_url_filter"](spark, folder).toPandas()
    want = plain_url_judgement(read("pages", folder).url, rules)
    for r in o.itertuples():
        rule, verdict, template, purity = want[r.host, r.path]
        assert (r.rule if isinstance(r.rule, str) else None, r.verdict, r.template) == (rule, verdict, template)
        assert purity is None or abs(purity - r.purity) < 1e-9


def test_url_trees_of_any_depth(spark):
    """Wide nodes far down the path, next to one very deep path."""
    from tessera.llm import url_filter
    deep = "/".join(["d"] * 11)
    urls = [f"http://h.com/{deep}/{a}/x" for a in [f"k{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(5)]]
    urls += [f"http://h.com/{deep}/often/{chr(97 + i)}" for i in range(20)] * 3 + ["http://h.com/" + "/".join(["s"] * 400)]
    urls += [f"http://g.com/{i}/a" for i in range(40)] + ["http://g.com", "http://g.com/", None, "x", "http://h.com//a//b/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    o = url_filter.judge_urls(df, [("block", "h.com/d/")]).toPandas()
    want = plain_url_judgement(urls, [("block", "h.com/d/")])
    assert all(want[r.host, r.path][2] == r.template and want[r.host, r.path][1] == r.verdict for r in o.itertuples()) and len(o) == len(urls)
    assert f"/{deep}/*/x" in set(o.template) and f"/{deep}/often/a" in set(o.template)
