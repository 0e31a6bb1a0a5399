"""Vocabularies, packing, BPE, numbering and run-log operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import runlog as rl
from tessera.operators import tokens as tk
from tessera.operators.numbering import positions_within, prefix_sum


def test_word_vocab_size(spark):
    df = spark.createDataFrame([("the quick brown fox jumps over the lazy dog " * 20,)], "text string")
    v = tk.word_vocab(df)
    assert v.count() == 13
    assert {r.token: r.id for r in v.collect()}["brown"] == 5


def test_char_vocab_sorted_code_points(spark):
    df = spark.createDataFrame([("baéa",)], "text string")
    assert [r.token for r in tk.char_vocab(df).orderBy("id").collect()] == ["a", "b", "é"]


def test_packing_windows(spark):
    docs = spark.createDataFrame([(0, list(range(0, 7))), (1, list(range(7, 12))), (2, list(range(12, 21)))],
                                 "doc_id bigint, ids array<bigint>")
    out = tk.pack_sequences(docs, 5).orderBy("seq_id").collect()
    assert len(out) == 4
    assert [r.input_ids for r in out] == [list(range(i, i + 5)) for i in (0, 5, 10, 15)]
    assert [r.labels for r in out] == [list(range(i + 1, i + 6)) for i in (0, 5, 10, 15)]
    assert [r.split for r in out] == ["train", "train", "train", "validation"]


def test_packing_matches_python_on_random_docs(spark):
    random.seed(2)
    docs, stream = [], []
    for i in range(60):
        n = random.randint(0, 40)
        ids = [random.randint(0, 99) for _ in range(n)]
        docs.append((i, ids))
        stream += ids
    L = 16
    n = (len(stream) - 1) // L
    df = spark.createDataFrame(docs, "doc_id bigint, ids array<bigint>")
    got = {r.seq_id: (r.input_ids, r.labels) for r in tk.pack_sequences(df, L).collect()}
    assert len(got) == n
    for k in range(n):
        assert got[k] == (stream[k * L:k * L + L], stream[k * L + 1:k * L + L + 1])


def _bpe_reference(words: Counter, n_merges: int, min_frequency: int = 2):
    seqs = {w: list(w) for w in words}
    merges = []
    for _ in range(n_merges):
        pc = Counter()
        for w, s in seqs.items():
            for a, b in zip(s, s[1:]):
                pc[(a, b)] += words[w]
        pc = {p: c for p, c in pc.items() if c >= min_frequency}
        if not pc:
            break
        (a, b), c = min(pc.items(), key=lambda kv: (-kv[1], kv[0]))
        merges.append((a, b, c))
        for w, s in seqs.items():
            out, i = [], 0
            while i < len(s):
                if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[w] = out
    return merges


def test_bpe_merges_match_brute_force(spark):
    text = "aaaaa low lower lowest newer newest wider aa.a $ab$ ab\\c " * 3
    df = spark.createDataFrame([(text,)], "text string")
    got = [(r.left, r.right, r["count"]) for r in tk.bpe_merges(df, n_merges=8, checkpoint_every=3).orderBy("rank").collect()]
    assert got == _bpe_reference(Counter(text.split()), 8)


def test_prefix_sum_and_positions(spark):
    random.seed(4)
    rows = [(i * 3, random.randint(1, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, w bigint")
    got = {r.k: r.offset for r in prefix_sum(df, ["k"], "w", cell_rows=9).collect()}
    acc = 0
    for k, w in rows:
        assert got[k] == acc
        acc += w
    # one hot key holding most rows, spread over many ordering buckets
    ev = spark.createDataFrame([(0 if i % 3 else 1, i, float(i)) for i in range(900)], "u bigint, t bigint, v double")
    pos = {(r.u, r.t): r.pos for r in positions_within(ev, ["u"], ["t"], cell_rows=40).collect()}
    for u in (0, 1):
        ts = sorted(t for (uu, t) in pos if uu == u)
        assert [pos[(u, t)] for t in ts] == list(range(len(ts)))


def test_rolling_mean_tail_and_latency(spark):
    data = [(1, i, float(i)) for i in range(250)]
    df = spark.createDataFrame(data, "run bigint, t bigint, v double")
    r = {x.t: x.mean_100 for x in rl.rolling_mean(df, "run", ["t"], "v", 100).collect()}
    assert r[0] == 0.0 and r[9] == 4.5 and r[249] == sum(range(150, 250)) / 100
    assert rl.tail_n(df, "run", ["t"], 10).count() == 10
    lat = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    s = rl.latency_summary(lat, "x").first()
    assert (s.median_ms, s.p95_ms, s.p99_ms) == (50.0, 95.0, 99.0)


def test_leaderboard_first_best(spark):
    t = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.9), (3, 0.1)], "trial bigint, score double")
    best = rl.leaderboard(t, "trial", "score").where("is_best").first()
    assert best.trial == 1


def test_layer_rules(spark):
    cand = spark.createDataFrame([
        (1, "fast", 1.0, 1.0, 0.5, 0.0, 0.1), (1, "slow", 50.0, 100.0, 150.0, 80.0, 5.0)],
        "run int, name string, forward_time_ms double, memory_mb double, grad_norm double, "
        "dead_neuron_pct double, grad_to_weight_ratio double")
    types = [r.type for r in rl.layer_issues(cand, "run", "name").orderBy("issue_rank").collect()]
    assert types == ["slow_layer", "memory_hog", "exploding_gradient", "dead_neurons", "high_grad_ratio"]


def test_bom_rollup_fixture(spark):
    from tessera.operators import bom
    comps = spark.createDataFrame([(1, 0, "servo_micro", 2, 0.5), (1, 1, "arduino_nano", 1, 1.0),
                                   (1, 2, "lipo_2s_2200", 1, None), (1, 3, "unknown_part", 1, 1.0)],
                                  "robot_id int, pos int, type string, quantity int, duty_cycle double")
    r = bom.bom_rollup(comps).first()
    assert (r.total_weight_g, r.total_current_idle_ma, r.total_current_active_ma, r.total_power_w) == (145.0, 70, 262, 1.31)
    assert r.voltage_rails == "5.0=servo_micro,arduino_nano" and r.battery == "lipo_2s_2200"
    assert r.battery_life_minutes == 503.8 and r.current_within_limits


def test_forward_fill_hot_key_many_buckets(spark):
    from tessera.operators.numbering import fill_forward_backward
    rows = [(0 if i % 4 else 1, i, (float(i) if i % 7 == 0 else None)) for i in range(700)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, v double")
    got = {(r.k, r.t): r.v for r in fill_forward_backward(df, ["k"], ["t"], "v", cell_rows=30).collect()}
    last = {}
    for k, t, v in rows:
        if v is not None:
            last[k] = v
        assert got[(k, t)] == (v if v is not None else last.get(k))
    back = {(r.k, r.t): r.v for r in fill_forward_backward(df, ["k"], ["t"], "v", backward=True, cell_rows=30).collect()}
    nxt = {}
    for k, t, v in reversed(rows):
        if v is not None:
            nxt[k] = v
        assert back[(k, t)] == (v if v is not None else nxt.get(k))


def test_cells_split_hot_values(spark):
    from tessera.operators.numbering import cells
    random.seed(8)
    rows = [(5.0, float(i)) for i in range(600)] + [(random.random() * 100, float(i)) for i in range(600, 800)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "k double, t double")
    got = {r.t: r.offset for r in prefix_sum(df, ["k", "t"], cell_rows=40).collect()}
    assert got == {t: i for i, (k, t) in enumerate(sorted(rows))}
    same = spark.range(900).selectExpr("1 as k")  # equal in everything
    assert sorted(r.offset for r in prefix_sum(same, ["k"], cell_rows=40).collect()) == list(range(900))
    assert cells(same, ["k"], 40).groupBy("__cell").count().agg(F.max("count")).first()[0] < 200


def test_positions_of_nulls_nan_and_shared_prefixes(spark):
    """Null keys are groups; nulls, NaN, long common prefixes and big numbers are ordered as a sort does."""
    rows = [(None if i % 3 == 0 else "g", "https://example.com/path/%05d" % (i * 7919 % 1000), (1 << 60) + i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, url string, big long")
    for order, place in ((["url"], 1), (["big"], 2)):
        pos = {(r.k, r[place]): r.pos for r in positions_within(df, ["k"], order, cell_rows=25).collect()}
        assert len(pos) == 600
        for k in (None, "g"):
            mine = sorted(r[place] for r in rows if r[0] == k)
            assert [pos[(k, x)] for x in mine] == list(range(len(mine)))
    vals = [None, None, float("nan"), 1.0, -1.0, float("inf"), float("-inf"), 2.5] * 9
    odd = spark.createDataFrame(list(enumerate(vals)), "i long, x double")
    a = [r.i for r in odd.orderBy("x", "i").collect()]
    got = {r.i: r.offset for r in prefix_sum(odd, ["x", "i"], cell_rows=5).collect()}
    assert [got[i] for i in a] == list(range(len(vals)))


def test_sequences_keep_null_runs_across_cells(spark):
    from tessera.operators.numbering import lag_within, trailing_mean
    rows = [(None if i % 2 else 1, i, float(i % 13), i) for i in range(400)] + [(2, 0, 1e-12, 0)]
    df = spark.createDataFrame(rows, "run long, t long, v double, n long")
    lag = {(r.run, r.t): r.prev for r in lag_within(df, ["run"], ["t"], "n", out="prev", cell_rows=30).collect()}
    mean = {(r.run, r.t): r for r in trailing_mean(df, ["run"], ["t"], "v", 50, out="m", cell_rows=30).collect()}
    assert len(lag) == len(mean) == 401
    for run in (None, 1, 2):
        mine = [r for r in rows if r[0] == run]
        for i, r in enumerate(mine):
            assert lag[(run, r[1])] == (mine[i - 1][3] if i else None)
            window = [x[2] for x in mine[max(0, i - 49):i + 1]]
            got = mean[(run, r[1])]
            assert got.pos == i and got["__total"] == len(mine) and abs(got.m - sum(window) / len(window)) <= 1e-12 * got.m
    share = rl.share_of_total(spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, v double"), "g", "v")
    assert sorted(r.share_pct for r in share.collect()) == [25.0, 75.0, 100.0]


def test_positions_hot_key_identical_times(spark):
    rows = [(1, 100, i) for i in range(500)] + [(2, i, i) for i in range(100)]
    df = spark.createDataFrame(rows, "u bigint, ts bigint, eid bigint")
    pos = {(r.u, r.eid): r.pos for r in positions_within(df, ["u"], ["ts", "eid"], cell_rows=30).collect()}
    assert [pos[(1, i)] for i in range(500)] == list(range(500))
    assert [pos[(2, i)] for i in range(100)] == list(range(100))


def test_encode_words_join_path_for_large_vocabularies(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "b a zz b"), (2, "  c  "), (3, ""), (4, None), (4, None)], "doc_id bigint, text string")
    vocab = tk.word_vocab(docs)
    fast = {r.doc_id: r.ids for r in tk.encode_words(docs, vocab).collect()}
    monkeypatch.setattr(tk, "MAP_VOCAB_LIMIT", 2)
    slow = {r.doc_id: r.ids for r in tk.encode_words(docs, vocab).collect()}
    assert fast == slow == {1: [6, 5, 8, 6], 2: [7], 3: [], 4: None}
    assert tk.encode_words(docs, vocab).count() == 5
    ids = spark.createDataFrame([(1, [5, 99, 8]), (2, []), (3, None)], "doc_id bigint, ids array<bigint>")
    joined = {r.doc_id: r.text for r in tk.decode_ids(ids, vocab).collect()}
    monkeypatch.undo()
    assert joined == {r.doc_id: r.text for r in tk.decode_ids(ids, vocab).collect()} == {1: "a ? zz", 2: "", 3: None}


def test_packing_refuses_too_little_data(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="Not enough data"):
        tk.pack_sequences(docs, 8, n_tokens=F.length("text"), encode_fn=tk.char_encoder(tk.char_vocab(docs)))


def test_pipeline_rejects_whole_table_steps_on_streams(spark, tmp_path):
    from tessera.plans.pipeline import Pipeline, PipelineError
    (tmp_path / "a.json").write_text('{"x": 1}\n')
    stream = spark.readStream.schema("x long").json(str(tmp_path))
    p = Pipeline("s", spark).add_source("s", stream)
    p.add_step("filter_rows", {"column": "x", "operator": ">", "value": "0"})
    p.build()
    p.add_step("sort", {"column": "x"})
    with pytest.raises(PipelineError):
        p.build()


def test_offsets_by_key_with_and_without_repeats(spark):
    from tessera.operators.numbering import offsets_by_key
    rows = [(k, w, "x" * w) for k, w in zip([5, None, 1, 9, 3, 7], [2, 4, 1, 3, 5, 2])]
    df = spark.createDataFrame(rows, "k int, w int, wide string")
    got = {r.k: (r.o, r.i, r.wide) for r in offsets_by_key(df, ["k"], "w", out="o", number="i", cell_rows=2).collect()}
    at, want = 0, {}
    for i, (k, w, s) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))):
        want[k] = (at, i, s)
        at += w
    assert got == want
    twice = df.union(df)
    o = sorted((r.o, r.w) for r in offsets_by_key(twice, ["k"], "w", out="o").collect())
    assert [x for x, _ in o] == [sum(w for _, w in o[:i]) for i in range(12)] and len(o) == 12


def _naive_bpe(word, ranks):
    parts = list(word)
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        rank, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_pieces_follow_the_ranks():
    from tessera.operators.subwords import bpe_pieces
    rng = random.Random(3)
    for _ in range(200):
        alphabet, ranks = list("abcé"), {}
        symbols = list(alphabet)
        for r in range(12):
            a, b = rng.choice(symbols), rng.choice(symbols)
            if (a, b) not in ranks:
                ranks[a, b] = len(ranks)
                symbols.append(a + b)
        word = "".join(rng.choices(alphabet, k=rng.randrange(0, 25)))
        assert bpe_pieces(word, ranks) == _naive_bpe(word, ranks)
    assert len(bpe_pieces("ab" * 50_000, {("a", "b"): 0, ("ab", "ab"): 1})) == 25_000


def test_wordpiece_by_longest_match(spark):
    from tessera.operators import subwords as sw
    ids = {"un": 5, "##aff": 6, "##able": 7, "a": 8, "##b": 9, "##": 10, "#": 11, "##affa": 12}
    trie = sw.piece_trie(ids)
    assert sw.wordpiece_ids("unaffable", trie) == [1] and sw.wordpiece_ids("ab", trie) == [8, 9]  # ##affa, then "ble": unknown
    assert sw.wordpiece_ids("##b", trie) == [10, 9] and sw.wordpiece_ids("x", trie) == [1]
    df = spark.createDataFrame([(1, "ab  a\tunaff"), (2, None), (3, " "), (4, "zz ab")], "doc_id int, text string")
    vocab = spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), *ids.items()], "token string, id bigint")
    enc = sw.encode_wordpiece(df, vocab)
    assert {r.doc_id: r.ids for r in enc.collect()} == {1: [8, 9, 8, 5, 6], 2: None, 3: [], 4: [1, 8, 9]}
    assert {r.doc_id: r.text for r in sw.decode_wordpiece(enc, vocab).collect()}[1] == "ab a unaff"


def test_wordpiece_merges_by_score(spark):
    from tessera.operators import subwords as sw
    text = "hug " * 10 + "pug " * 5 + "pun " * 12 + "bun " * 4 + "hugs " * 5
    df = spark.createDataFrame([(text[:60],), (text[60:],), (None,)], "text string")
    words = {}
    for part in (text[:60], text[60:]):
        for w in part.split():
            words[w] = words.get(w, 0) + 1
    split = {w: [w[0]] + ["##" + c for c in w[1:]] for w in words}
    want = []
    for _ in range(6):
        pairs, one = {}, {}
        for w, s in split.items():
            for x in s:
                one[x] = one.get(x, 0) + words[w]
            for p in zip(s, s[1:]):
                pairs[p] = pairs.get(p, 0) + words[w]
        best = min((p for p in pairs if pairs[p] >= 2), key=lambda p: (-pairs[p] / (one[p[0]] * one[p[1]]), -pairs[p], p))
        want.append((*best, pairs[best]))
        for s in split.values():
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == best:
                    s[i:i + 2] = [s[i] + s[i + 1][2:]]
                i += 1
    got = sw.wordpiece_merges(df, n_merges=6, checkpoint_every=4).orderBy("rank").collect()
    assert [(r.left, r.right, r["count"]) for r in got] == want
    vocab = sw.subword_vocab(df, sw.wordpiece_merges(df, n_merges=3), wordpiece=True)
    enc = {tuple(r.ids) for r in sw.encode_wordpiece(df, vocab, keys=()).where("ids is not null").collect()}
    assert all(1 not in ids for ids in enc)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joined_vocabularies_copy_no_row_per_word(spark, monkeypatch):
    """A chunk's distinct words go through the join, not every word with its whole row."""
    words = [f"w{i % 97}" for i in range(3000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w1  w0 new"), (3, None)], "doc_id bigint, text string").coalesce(1)
    vocab = tk.word_vocab(docs.where("doc_id = 1"))
    monkeypatch.setattr(tk, "MAP_VOCAB_LIMIT", 2)
    enc = tk.encode_words(docs, vocab)
    dec = tk.decode_ids(enc, vocab)
    assert {r.doc_id: r.text for r in dec.collect()} == {1: " ".join(words), 2: "w1 w0 [UNK]", 3: None}
    for df in (enc, dec):
        assert "explode" not in _plan(df)


def test_slices_hold_a_bounded_part_of_a_batch():
    import pyarrow as pa
    texts = ["a" * 10, None, "b" * 35, "", "c" * 10, "d" * 10]
    rb = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts), pa.array([[1] * len(t or "") for t in texts])], names=["k", "t", "l"])
    cut = list(tk.in_slices([rb], 1, 20))
    assert [s.column(0).to_pylist() for s in cut] == [[0, 1], [2], [3, 4, 5]]
    assert [s.column(0).to_pylist() for s in tk.in_slices([rb], 2, 160)] == [[0, 1], [2], [3, 4, 5]]
    assert [t for s in cut for t in s.column(1).to_pylist()] == texts


def test_merges_and_vocabulary_share_one_word_count(spark):
    from tessera.operators import subwords as sw
    docs = spark.createDataFrame([(1, "aaaa abab ab ba"), (2, "baab aaaa $a$a x")], "doc_id bigint, text string")
    counted = tk.word_counts(docs)
    for train, wordpiece in ((tk.bpe_merges, False), (sw.wordpiece_merges, True)):
        merges = train(docs, n_merges=6)
        shared = train(docs.limit(0), n_merges=6, counted=counted)  # the texts are not read again
        assert merges.collect() == shared.collect() and merges.count()
        vocab = sw.subword_vocab(docs, merges, wordpiece=wordpiece)
        assert sorted(vocab.collect()) == sorted(sw.subword_vocab(docs.limit(0), shared, wordpiece=wordpiece, counted=counted).collect())
