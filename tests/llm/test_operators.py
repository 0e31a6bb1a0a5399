"""Operators on their own: edge cases, and their parts against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import (chat, decontam, html_extract, imatch, langid, mixing, sharding, simhash, toxicity,
                         url_filter)
from tessera.llm.common import row_hash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, fp long, shard int, `key` string"
LONG = " ".join(f"w{i % 977}" for i in range(120_000))
ROWS = [(1, "The quick brown fox jumps over the lazy dog.", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
        (4, "The quick brown fox jumps over the lazy dog.", "en", "b"), (4, "The quick brown fox jumps over the lazy dog.", "en", "b"),
        (None, "no id here, just some more words", "en", None), (5, LONG, "en", "b"), (6, " \t\n ", "de", "a"),
        (7, "\x00 \U0001F600 é İ <|x|> \\", "fr", "c"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 9, "x", 1, 99, "k") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------- mixing

def test_mixing_edges(spark, docs, none):
    o = mixing.mix_report(docs).toPandas()
    assert len(o) == len(ROWS) and (o.taken <= 2 * o["size"]).all()
    assert (o[o["size"] == 0].taken == 0).all()
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again))


def test_mixing_source_holding_most_rows_and_many_ranges(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
                                  F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), (F.col("id") % 11).cast("string")))
                                  .otherwise(F.lit("hot")).alias("source"))
    a = mixing.mix_report(df).toPandas().sort_values("doc_id")
    small, mixing.RANGE_ROWS = mixing.RANGE_ROWS, 1
    try:
        b = mixing.mix_report(df).toPandas().sort_values("doc_id")
    finally:
        mixing.RANGE_ROWS = small
    assert a.reset_index(drop=True).equals(b.reset_index(drop=True))  # the cut in ranges does not show
    by = a.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.target - by.taken) <= 1).all()
    taken = a[a.passes > 0].sort_values("first_position")
    assert taken.first_position.is_unique and taken.first_position.min() == 0


def test_mixing_targets_all_at_their_limit(spark):
    df = spark.createDataFrame([("a", 10), ("b", 20), (None, 30)], "source string, size long")
    o = {r.source: r.target for r in mixing.source_targets(df, share=5.0).collect()}
    assert o == {"a": 20.0, "b": 40.0, None: 60.0}
    o = {r.source: (r.target, r.quota) for r in mixing.source_targets(df, weights=(1.0,), share=1.0).collect()}
    assert o == {"a": (20.0, 20), "b": (20.0, 20), None: (20.0, 20)}


# ------------------------------------------------------------------ simhash

def test_simhash_edges(docs, none):
    o = simhash.simhash_dedup(docs).toPandas()
    assert len(o) == len(ROWS)
    blank = o[o.doc_id.isin([3, 6])]
    assert (blank.fingerprint == "0" * 16).all() and (blank.component_id == 2).all()
    assert (o[o.doc_id == 4].component_id == 1).all()
    assert simhash.simhash_dedup(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(kept.toPandas().doc_id.fillna(-1)) == [-1, 1, 2, 5, 7]  # the null id with a text of its own stays
    assert simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("distance,block", [(4, 2048), (4, 5), (2, 3), (3, 2048), (6, 7)])
def test_links_against_all_pairs(spark, distance, block):
    """Also where a bucket is dealt into blocks."""
    rng = random.Random(distance * 100 + block)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for x in base for _ in range(25)}
    fps |= {0, (1 << 64) - 1, 1, 3, 7, 15}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(df, distance, block)
    label = {x: x for x in signed}
    label.update({r.node: r.label for r in simhash.components(links).collect()})
    parent = {x: x for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance:
            parent[find(a)] = find(b)
    groups, want = {}, {}
    for x in signed:
        groups.setdefault(label[x], set()).add(x)
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    """Spark takes the 66 rows of a fingerprint for one, so a small table's may look fit for a broadcast."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(folder := f"{tmp_path}/fps")
    links = simhash.near_links(spark.read.parquet(folder))
    links.collect()
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    o = {r.node: r.label for r in simhash.components(links).collect()}
    assert {o[i] for i in range(n)} == {0} and o[1001] == o[1000] == 1000


# --------------------------------------------------------------------- chat

def tree(spark, rows):
    return spark.createDataFrame(rows, "conv long, node long, parent long, role string, text string, score double")


def test_chat_branches_and_ranking(spark):
    t = tree(spark, [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0),
                     (1, 4, 3, "user", "thanks", 0.0), (1, 5, 4, "assistant", "bye", 4.0), (2, 1, 99, "user", "orphan", 0.0),
                     (3, 1, 2, "user", "a", 0.0), (3, 2, 1, "user", "b", 0.0), (None, 1, None, None, None, None)])
    o = {(r.conv, r.leaf): r for r in chat.format_trees(t, branches=2).collect()}
    assert set(o) == {(1, 5), (1, 2), (2, 1), (None, 1)}  # the circle has no path
    assert o[1, 5].branch_rank == 1 and o[1, 5].n_turns == 4 and o[1, 5].branch_score == 9.0 / 4
    assert o[1, 5].formatted == ("<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
                                 "<|im_start|>user\nthanks<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n")
    assert [o[1, 5].formatted[s.start:s.end] for s in o[1, 5].loss_spans] == ["good", "bye"]
    assert o[None, 1].formatted == "<|im_start|>\n<|im_end|>\n"
    assert chat.format_trees(t.limit(0)).count() == 0


def test_chat_round_trip_of_control_strings(spark):
    parts = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|", "<", "|", "\\", "\n", "x", "😀", "<|n|>"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 9))) for _ in range(200)]
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", "a<|b\nc", ""]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_trees(chat.conversation_nodes(df))
    o = done.select("conv", chat.read_back(F.col("formatted")).alias("turns"),
                    chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in o:
        want = [(x[2], x[3]) for x in rows if x[0] == r.conv]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")


def test_chat_deep_chain(spark):
    n = 150
    t = tree(spark, [(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(n)])
    r = chat.format_trees(t).first()
    assert r.n_turns == n and r.formatted.startswith("<|im_start|>user\n0<") and r.branch_score == 1.0


# ----------------------------------------------------------------- toxicity

def test_toxicity_learns_and_covers_edges(spark, docs, none):
    rng = random.Random(5)
    words = "table river stone window garden paper letter bottle winter yellow".split()
    rows = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = "gronk"
        rows.append((i, " ".join(w) + ".", int(i % 4 == 0)))
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(train)
    assert "gronk" in model.terms and "river" not in model.terms
    o = toxicity.score_toxicity(docs, model).toPandas()
    assert len(o) == len(ROWS) and o.score.between(0, 1).all() and (o.predicted == 0).all()
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.drop_toxic(docs, model).schema == docs.schema
    test = spark.createDataFrame([(1, "you are a gronk"), (2, "he said you are a gronk, allegedly"), (3, "you are not a gronk"),
                                  (4, "the river by the table")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score_toxicity(test, model).collect()}
    assert s[1] > 0.3 > s[4] and s[1] > s[2] and s[1] > s[3]


def test_toxicity_without_labels(spark, none):
    model = toxicity.train(none.select("text", F.lit(1).alias("toxic")))
    a = model.automaton()
    x = np.array([toxicity.features(a, t) + [1.0] for t in ("you idiot", "a fine day")])
    s = 1 / (1 + np.exp(-x @ np.array(model.weights)))
    assert s[0] > s[1]


def test_toxicity_choice_does_not_fall_with_purity():
    n = [2_578, 319]
    assert set(toxicity._chosen({"gronk$": [0, 37], "zib$": [0, 6], "day$": [40, 6]}, n)) == {"gronk", "zib"}
    z = [toxicity._root_ratio(no, 37, n) for no in range(300)]
    assert z == sorted(z, reverse=True)
    assert toxicity._fewest(n) == 5 and toxicity._fewest([1_000, 1_000]) > 5


def test_toxicity_base_words_used_innocently_stay_out(spark):
    rows = [(f"row {i} calls the dish bastard sauce and the sun will burn you", 0) for i in range(40)]
    rows += [(f"row {i} you are a trottel of number {i * i}", 1) for i in range(20)]
    terms = toxicity.train(spark.createDataFrame(rows, "text string, toxic int")).terms
    assert "bastard" not in terms and "burn you" not in terms
    assert "trottel" in terms and "kill you" in terms


def test_toxicity_clauses():
    a = toxicity.Model({"gronk": ("I", 1.0, False), "kill you": ("T", 1.0, False)}).automaton()

    def kinds(text):
        f = toxicity.features(a, text)
        return {k for k, x in zip(toxicity.KINDS, f) if x}
    assert kinds("You gronk!") == {("insult", "aimed", "direct")}
    assert kinds("a gronk is a bird") == {("insult", "open", "direct")}
    assert kinds("he is not a gronk") == {("insult", "aimed", "negated")}
    assert kinds("not today. gronk") == {("insult", "open", "direct")}  # negation ends with its clause
    assert kinds('the paper wrote "gronk"') == {("insult", "open", "direct")} or \
        kinds('the paper wrote "gronk"') == {("insult", "open", "reported")}
    assert kinds("they said gronk") == {("insult", "aimed", "reported")}
    assert kinds("I will kill you") == {("threat", "open", "direct")}
    assert kinds("gronkish ungronk") == set()


# ----------------------------------------------------------------- sharding

def test_sharding_edges(docs, none):
    o = sharding.external_shuffle(docs, shards=4)
    assert [c for c in o.columns if c not in ("shard", "slot")] == [c for c in docs.columns if c != "shard"]
    p = o.toPandas()
    n = p.groupby("shard").slot.agg(["size", "max", "nunique"])
    assert len(p) == len(ROWS) and sorted(n["size"]) == [2, 2, 3, 3] and (n["max"] == n["size"] - 1).all()
    again = sharding.external_shuffle(docs.repartition(7), shards=4).toPandas()
    key = ["shard", "slot"]
    assert p.sort_values(key).doc_id.fillna(-1).tolist() == again.sort_values(key).doc_id.fillna(-1).tolist()
    assert sharding.external_shuffle(none).count() == 0


def test_sharding_bucket_is_fisher_yates_of_its_seed():
    t = pa.table({"row": list(range(9)), "row_key": [5, 3, 8, 1, 9, 2, 7, 4, 6], "bucket": [3] * 9})
    out = sharding._shuffled(17)(t)
    by_key = sorted(range(9), key=lambda i: t["row_key"][i].as_py())
    order = np.random.Generator(np.random.PCG64([17, 3])).permutation(9)
    assert out["row"].to_pylist() == [by_key[i] for i in order] and out["place"].to_pylist() == list(range(9))


def test_sharding_shuffles_records_once_and_places_them_as_plain_python(spark, monkeypatch):
    """With no broadcast join too; 100 of the 500 rows come twice."""
    monkeypatch.setattr(sharding, "MIN_BUCKETS", 7)
    df = spark.range(500).select((F.col("id") % 400).alias("doc_id"), (F.col("id") % 400).cast("string").alias("text"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        o = sharding.external_shuffle(df, shards=3)
        formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        exchanged = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*)\]", o._jdf.queryExecution().explainString(formatted))
        got = o.orderBy("shard", "slot").toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(exchanged) > 1 and sum("row#" in columns for columns in exchanged) == 1
    key = row_hash(df, 17)
    keyed = df.select("doc_id", key.alias("key"), F.pmod(F.xxhash64(key), F.lit(7)).alias("bucket")).toPandas()
    want = []
    for b, rows in keyed.sort_values("key").groupby("bucket"):
        want += rows.doc_id.iloc[np.random.Generator(np.random.PCG64([17, b])).permutation(len(rows))].tolist()
    assert got.doc_id.tolist() == want
    assert got.shard.tolist() == [at * 3 // 500 for at in range(500)]
    assert got.slot.tolist() == [at - math.ceil(at * 3 // 500 * 500 / 3) for at in range(500)]


def test_write_shards(spark, tmp_path):
    df = spark.range(200).select("id", F.col("id").cast("string").alias("text"))
    sharding.write_shards(sharding.external_shuffle(df, shards=3), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").toPandas()
    assert back.groupby("shard").slot.agg(["size", "max"]).eval("size - max").eq(1).all() and len(back) == 200


# --------------------------------------------------------------- page text

MODEL = html_extract.potentials({
    ("0|tag=article", 1): 50, ("0|all", 1): 50, ("0|all", 0): 500, ("1|all", 1): 400, ("1|all", 0): 3, ("1|tag=p", 1): 300,
    ("1|len=5", 1): 300, ("0|len=5", 0): 2, ("0|tag=ul", 0): 60, ("0|tag=li", 0): 200, ("0|len=-1", 0): 200, ("0|len=-1", 1): 50})


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("<html><body><script>x</script></body>", ""),
    ("<article><h1>A &amp; B</h1><p>one\n two<p>three<br>four<ul><li>x</ul></article><footer>f</footer>", "A & B\none two\nthree four\nx"),
    ("<nav><a href=/>home</a></nav><article><p>t<div class=ad>buy</div><p>u</article>", "t\nu"),
    ("<article><p>text<aside>side</aside><form>name<input></form><p>more<!-- no --><style>p{}</style></article>"
     "<section class='comments'><p>first!</section>", "text\nmore"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>cut <a hre", "cut"), ("<article><p>5 < 6 &lt;b&gt; &#233;&nbsp;x</p></article>", "5 < 6 <b> é x"),
])
def test_main_text(page, text):
    assert html_extract.main_text(page, MODEL) == text


@pytest.mark.parametrize("attribute,kept", [
    ('data-title="The hidden valley"', True), ('title="hidden"', True), ('aria-hidden="false"', True), ("data-src=a/hidden.png", True),
    ("title='x' data-id=menu data-class=\"sidebar\"", True), ('lang=en title="a"b" hidden', False), ("HIDDEN", False),
    ('title="x"hidden=""', False), ('title="a=b" style="display: none"', False)])
def test_attributes_are_whole_names(attribute, kept):
    assert html_extract.main_text(f"<article {attribute}><p>the text</p></article>", MODEL) == ("the text" if kept else "")


@pytest.mark.parametrize("name", ["research", "researchers", "discussion", "shareholders", "commentary", "unavailable",
                                  "recommendations", "illegally", "shared-history"])
def test_furniture_names_are_whole_words(name):
    page = f"<article><p>first</p><section id={name}><p>{'some long text ' * 20}</p></section></article>"
    assert html_extract.main_text(page, MODEL) == "first\n" + ("some long text " * 20).strip()


@pytest.mark.parametrize("name", ["site-nav", "siteNav", "topnav", "footer_widgets", "ad", "commentlist", "share-buttons", "relatedPosts"])
def test_furniture_names(name):
    assert html_extract.main_text(f"<article><p>text</p><div class={name}>more</div></article>", MODEL) == "text"


def test_names_inside_an_article_label_nothing():
    nodes, _ = html_extract.parse("<article><p>a</p><div class=legal><p>b</p><footer>c</footer></div></article><div class=legal>d</div>")
    labels = html_extract.landmark_labels(nodes)
    assert [labels[id(n)] for n in nodes] == [0, 1, 1, None, None, None, 0]


def test_marginals_against_all_labellings():
    page = "<body><div class=menu><ul><li>a</li></ul></div><article><p>some text here</p><div><p>x</p></div></article></body>"
    nodes, _ = html_extract.parse(page)
    place = {id(n): i for i, n in enumerate(nodes)}

    def factor(i, above, y):
        edge = MODEL[f"{above}|all"]
        own = edge + max(-12.0, min(12.0, sum(MODEL.get(f"{above}|{f}", 0.0) for f in html_extract.node_features(nodes[i]))))
        return math.exp(own if y else 0.0) / (1 + math.exp(edge))
    mass, total = np.zeros(len(nodes)), 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        p = factor(0, 0, labels[0])
        for i, n in enumerate(nodes[1:], 1):
            p *= factor(i, labels[place[id(n.parent)]], labels[i])
        mass += p * np.array(labels)
        total += p
    assert np.allclose(html_extract.marginals(nodes, MODEL), mass / total, atol=1e-9)


def test_main_text_without_landmarks():
    text = "a long paragraph with many words in it that goes on and on " * 3
    page = f"<body><ul class=menu><li><a href=/>home</a></ul><div><p>{text}<p>{text}</div><div id=footer>f</div></body>"
    assert html_extract.main_text(page, MODEL) == f"{text.strip()}\n{text.strip()}"


def test_pages_frame(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<article><p>t</article>", "y"), (2, "u", "", "z")] * 2,
                                  "page_id long, url string, html string, text string")
    o = html_extract.extract_pages(pages, html_extract.train(pages)).collect()
    assert len(o) == 6 and sorted(r.text for r in o) == ["", "", "", "", "t", "t"]
    assert html_extract.extract_pages(pages.limit(0), html_extract.train(pages.limit(0))).count() == 0


# --------------------------------------------------------------------- urls

def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Com", "x://h?q", "x://h#f/y", "http://Sub.Example.COM/en/1", "http://b.net/es/2?x#y",
            "http://b.net/de/2", "http://b.net/a/b/c/d/e/f/g/h/i/j/k", "http://com/x", "http://dotcom/x"] * 2
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("block", "net/es/")]
    o = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(o) == len(urls)
    assert [(o[i].host, o[i].path) for i in range(7)] == [("", "")] * 4 + [("a.com", ""), ("h", ""), ("h", "")]
    assert (o[7].rule, o[7].verdict, o[8].rule, o[8].verdict) == ("example.com/en/", "block", "net/es/", "block")
    assert o[4].rule is None and o[11].rule == "com/" and o[12].rule is None and o[10].template == "/a/b/c/d/e/f/g/h/i/j/k"
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_url_tree_learns_templates(spark):
    rows = [f"http://h.org/good/{i}" for i in range(40)] + [f"http://h.org/bad/{i}" for i in range(40)]
    rows += [f"http://h.org/{chr(97 + i // 26)}{chr(97 + i % 26)}x/p" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = [("allow", "h.org/good/1"), ("block", "h.org/bad/1")]
    o = url_filter.judge_urls(pages, rules).toPandas()
    verdict = o.assign(kind=o.path.str.split("/").str[1]).groupby("kind").verdict.agg(set)
    assert o[o.path.str.startswith("/good/2")].verdict.eq("allow").all()
    assert o[o.path.str.startswith("/bad/2")].verdict.eq("block").all()
    assert len(verdict) == 62 and (o[o.path.str.endswith("x/p")].template == "/*/p").all()


# ------------------------------------------------------------------- imatch

def test_imatch_edges(docs, none):
    o = imatch.edit_report(docs).toPandas()
    assert len(o) == len(ROWS) and o.near_edited.between(0, 1).all()
    assert o[o.doc_id == 4].fingerprint.nunique() == 1
    assert o[o.n_chars == 0].near_edited.eq(1).all()
    assert imatch.edit_report(none).count() == 0
    one = imatch.edit_report(docs.filter("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_imatch_follows_overlap():
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(5000)]
    text = rng.sample(vocabulary, 400)
    lexicon = imatch.Terms(imatch.Terms().of(" ".join(vocabulary)))
    own = imatch.fingerprint(" ".join(text), lexicon)
    assert (own == imatch.fingerprint(" ".join(reversed(text * 2)), lexicon)).all()  # order and repeats do not matter
    shares = []
    for keep in (390, 300, 200, 0):
        other = text[:keep] + rng.sample(vocabulary, 400 - keep)
        shares.append(imatch.likeness(own, imatch.fingerprint(" ".join(other), lexicon)))
    assert shares == sorted(shares, reverse=True) and shares[0] > 0.8 and shares[2] > shares[3] + 0.1


@pytest.mark.parametrize("inside", [8, 15, 16, 17, 40])
def test_imatch_one_word_at_any_length(inside):
    rng = random.Random(inside)
    vocabulary = [f"t{i}" for i in range(5000)]
    lexicon = imatch.Terms(imatch.Terms().of(" ".join(vocabulary)))
    left = []
    for _ in range(30):
        text = rng.sample(vocabulary, inside) + [f"common{i}" for i in rng.sample(range(50), inside)]
        own = imatch.fingerprint(" ".join(text), lexicon)
        left.append(imatch.likeness(own, imatch.fingerprint(" ".join(text[1:]), lexicon)))
    assert np.mean(left) > 1 - 2.5 / inside


def test_imatch_lexicon_counts_all_documents(spark):
    df = spark.createDataFrame([(f"the w{i % 10} x{i}",) for i in range(200)], "text string")
    got = set(imatch.lexicon(df, rare=20, common=5).tolist())
    assert got == set(imatch.Terms().of(" ".join(f"w{i}" for i in range(10))).tolist())


# ----------------------------------------------------------------- language

def test_language_edges(spark):
    texts = [("en", "the house and the river with this one"), ("de", "das haus und der fluss mit diesem einen")] * 30
    model = langid.train_text_model(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, lang string, text string"))
    pages = spark.createDataFrame([
        (1, "http://a.de/1", '<html lang="de"><p>das haus und der fluss'), (2, None, None), (3, "", ""),
        (4, "http://a.de/2", "<html><body></body>"), (5, "http://b.uk/2", "<html LANG='en-GB'><p>the river"),
        (5, "http://b.uk/2", "<html LANG='en-GB'><p>the river"), (None, "x", "<p>the river and the house</p>")],
        "page_id long, url string, html string")
    o = langid.identify(pages, model).toPandas()
    by = {i: l for i, l in zip(o.page_id.fillna(-1), o.lang)}
    assert len(o) == 7 and by[1] == "de" and by[5] == "en" and by[-1] == "en" and by[4] == "de"  # by its host
    assert o.confidence.between(0, 1).all() and o[o.page_id == 5].declared.eq("en").all()
    assert langid.identify(pages.limit(0), model).count() == 0
    empty = langid.train_text_model(spark.createDataFrame([], "doc_id long, lang string, text string"))
    assert langid.identify(pages, empty).toPandas().lang.isna().all()


# ---------------------------------------------------------- decontamination

def test_decontamination_edges(spark, docs, none):
    items = spark.createDataFrame([(1, "Brown FOX jumps"), (2, None), (3, " ,,, "), (None, "lazy dog"), (4, "fox"), (1, "Brown FOX jumps")],
                                  "item_id long, text string")
    rows = decontam.find_contamination(docs, items).collect()
    o = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert o[1].items == ["1", "4", "null"] and o[1].n_hit == 5 and o[1].n_words == 9
    text = ROWS[0][1]
    assert [text[s.from_char:s.to_char] for s in o[1].spans] == ["brown fox jumps", "lazy dog"]
    assert o[2].n_words == 0 and o[2].items == [] and o[5].n_words == 120_000 and o[5].n_hit == 0
    assert decontam.find_contamination(none, items).count() == 0
    assert decontam.find_contamination(docs, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    kept = decontam.drop_contaminated(docs, items)
    assert kept.schema == docs.schema and kept.count() == len(ROWS) - 3


def test_decontamination_offsets_and_several_automata(spark, monkeypatch):
    df = spark.createDataFrame([(1, "é😀—Alpha beta; gamma… DELTA é alpha BETA")], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "gamma delta", "delta é", "zeta"])], "item_id long, text string")
    one = decontam.find_contamination(df, items).collect()
    monkeypatch.setattr(decontam, "AUTOMATON_CHARS", 5)
    monkeypatch.setattr(decontam, "HELD", 2)  # four automata: two passes
    many = decontam.find_contamination(df, items).collect()
    assert [r.asDict(True) for r in one] == [r.asDict(True) for r in many]
    text = df.first().text
    # "…" and "—" are word characters here: only ASCII separates words; neighbouring hits are one span
    assert [text[s.from_char:s.to_char] for s in one[0].spans] == ["DELTA é alpha BETA"] and one[0].items == ["0", "2"]


def test_decontamination_builds_an_automaton_once(monkeypatch):
    monkeypatch.setattr(decontam, "_AUTOMATA", type(decontam._AUTOMATA)())
    blocks = {f"k{i}": {f" w{i} ".encode(): ["1"]} for i in range(decontam.HELD + 1)}
    held = list(blocks)[:decontam.HELD]
    first = {k: decontam._automaton(k, blocks[k]) for k in held}
    for _ in range(5):  # batch after batch, in turn
        assert all(decontam._automaton(k, blocks[k]) is first[k] for k in held)
    decontam._automaton(list(blocks)[-1], blocks[list(blocks)[-1]])
    assert len(decontam._AUTOMATA) == decontam.HELD


def test_decontamination_windows_of_items(spark):
    items = spark.createDataFrame([(1, "Aa bb-cc dd"), (2, "bb CC dd"), (None, "é Aa"), (3, None), (4, " ,;")], "item_id long, text string")
    got = {r.text: r["items"] for r in decontam.item_windows(items, 3, "item_id", "text").collect()}
    assert got == {"aa bb cc": ["1"], "bb cc dd": ["1", "2"], "é aa": ["null"]}
