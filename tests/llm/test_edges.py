"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import (chat, components, html_extract, langid, minhash, mixing, packing, simhash, suffix_dedup, topk,
                           url_filter)
from sparkprep.llm.common import rank_in_group
from sparkprep.llm.html_blocks import leaf_blocks
from sparkprep.llm.queries import CHAT_SCHEMAS, tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 30000
PASSAGE = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(900))
ROWS = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two", None, None, 7), (4, LONG, "en", "b", len(LONG)),
        (5, "é" * 500, "fr", "b", 500), (6, f"x {PASSAGE} y", "en", "a", 0), (7, f"{PASSAGE}", "en", None, 0),
        (7, f"{PASSAGE}", "en", None, 0), (None, "no id here at all", "en", "c", 0), (8, "\ud7ff \U0001f600 \u0000", "de", "c", 5)]
CLASH = ["_d", "_t", "_row", "spans", "parts", "size", "copies", "fp", "piece", "sequence_id", "_copies", "_key", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[2].fingerprint == ""
    assert len(got[3].fingerprint) == minhash.BINS
    rows = minhash.edit_similarity(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    twin = [r for r in rows if r.doc_id == 7]
    assert max(r.near_next for r in twin) == 1.0
    assert minhash.edit_similarity(none).count() == 0
    one = minhash.edit_similarity(docs.where("doc_id = 3")).collect()
    assert one[0].near_next == 1.0


def test_densification_is_unbiased():
    mh = minhash.MinHash()
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        words = [f"w{i}" for i in rng.integers(0, 10**9, 30)]
        a, b = words[:24], words[6:]
        texts = [" ".join(x).encode() for x in (a, b)]
        digits, some = mh.digits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        truth = 14 / 26
        errors.append(minhash.likeness(digits[:1], some[:1], digits[1:], some[1:])[0] - truth)
    assert abs(np.mean(errors)) < 0.03
    few, many = np.full((1, 512), 2**64 - 1, np.uint64), np.full((1, 512), 2**64 - 1, np.uint64)
    few[0, [3, 77, 400]] = many[0, [3, 77, 400]] = [5, 6, 7]
    mh._densify(few)  # by the table of first visits
    full = np.array([[3, 77, 400]])
    for i in range(512):  # and by walking the probe sequence
        attempt = 0
        while (j := int(mh._probe(np.array([i]), attempt)[0])) not in full[0]:
            attempt += 1
        assert few[0, i] == (many[0, j] if i not in full[0] else many[0, i])


def test_top_k(spark):
    rows = [(0, [0.5, 0.5]), (50, [1.0, -1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]),
            (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (0, [0.5, 0.5]),
            (9, [-1e30, 1.0]), (10, [-0.001, 0.003])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.search(df, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [
        (0, 1, 1, 32768), (0, 2, 2, 32768), (0, 3, 6, 32768), (50, 1, 6, 65536), (50, 2, 0, 0), (50, 3, 0, 0)]
    assert topk.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    rng = np.random.default_rng(0)
    x = rng.integers(-2**20, 2**20, (600, 19)) / 256.0  # integers beyond 32 bits once multiplied
    big = spark.createDataFrame([(i, [float(c) * 300 for c in v]) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    q = np.floor(256 * x * 300).astype(np.int64)
    for r in topk.search(big, F.col("vec_id") == 100, k=4).collect():
        score = q @ q[100]
        score[100] = -2**62
        assert r.vec_id == np.argsort(-score, kind="stable")[r["rank"] - 1] and r.score == score[r.vec_id]


def test_top_k_keeps_every_finite_vector(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e8, 0.0]), (2, [3.0, 3.0]), (3, [-1e300, 1e-300]), (4, [2.0**53, -(2.0**52)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.search(df, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
    want = sorted(((int(a * 256) * 256 + int(b * 256) * 512, -i) for i, (a, b) in rows[1:]), reverse=True)
    assert [(r.score, -r.vec_id) for r in got] == want[:3] and got[0].score == 256 * 256 * 10**8
    with pytest.raises(Exception, match="BIGINT"):  # the fourth score, -6.5e304, is no bigint
        topk.search(df, F.col("vec_id") == 0, k=4).collect()


def test_url_filter(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://WWW.Example.COM/en/x?y#z"), (4, "http://example.com"), (5, "x://a.net/fr/" + "p" * 5000),
            (6, "http://?q"), (1, None), (None, "http://b.org/é")]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash"))
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/fr/")]
    got = {r.page_id: r for r in url_filter.judge(df, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("", "", None)
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[4].rule is None and got[5].rule == "net/fr/" and got[6].host == ""
    assert url_filter.judge(df.where("false"), rules).count() == 0
    only = url_filter.judge(df.where("page_id = 2"), rules).collect()
    assert only[0].verdict == "allow"


def test_url_model_held_out(spark):
    urls = spark.range(3000).select("id", F.concat(F.lit("http://"), F.when(F.col("id") % 3 == 0, "cheap-pills").otherwise("library"),
                                                   (F.col("id") % 97).cast("string"), F.lit(".org/page/"), F.col("id").cast("string")).alias("url"),
                                    (F.col("id") % 3 == 0).cast("int").alias("block"))
    host, path = url_filter.host_path(F.col("url"))
    rows = urls.select("id", "block", host.alias("host"), path.alias("path"))
    model = url_filter.fit(rows.where("id < 400").select("host", "path", "block"))
    held = url_filter.block_probability(rows.where("id >= 400"), model)
    assert held.where((F.col("p_block") >= 0.5) == (F.col("block") == 1)).count() >= 0.99 * 2600


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == 0 and by[1].component_id == by[2].component_id == 1
    assert by[7].component_id == 7 and by[None].component_id is None
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_tree_finds_every_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:600] ^ (np.uint64(1) << rng.integers(0, 62, 600).astype(np.uint64))
    dense = base[0] ^ np.array([(1 << a) | (1 << b) for a in range(20) for b in range(a)], np.uint64)
    fps = np.unique(np.concatenate([base, near, near ^ np.uint64(1 << 40), dense]))
    monkeypatch.setattr(simhash, "SHARD_ROWS", 200)
    classes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    found = components.connected_components(simhash.links(classes)).collect()
    label = {r.node: r.component for r in found}
    mine = [label.get(int(f), int(f)) for f in fps.view(np.int64)]
    want = fps.view(np.int64).copy()
    linked = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    while True:
        new = np.array([want[r].min() for r in linked])
        if (new == want).all():
            break
        want = new
    assert mine == want.tolist()


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == 1000 for i in range(1000, 1400)) and len(got) == 701
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs, tokenizer_path()).toPandas()
    assert got[got.doc_id == 1].length.tolist() == [1] and len(got[got.doc_id == 7]) == 2 * len(got[got.doc_id == 7].piece.unique())
    assert got.doc_id.isna().sum() >= 1
    rows = got.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    assert rows.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_word_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    words = packing.WordIds(tokenizer_path())
    texts = ["", " ", "  a", "a  b", "a \n b", "a\n\n b", "a \n", "it's we're I'll  x", "é\u00a0 b", "\u2003x \u2003 y", "tab\t x", "1 23 %%% &&& ",
             " lead", "trail ", "\x85 x", "x \x85y", "a \u00a0 b", "<|endoftext|> x", "\U0001f600 \U0001f600", "a" * 300 + " b", "\x1c x \x1cy"]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_keeps_every_constraint():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 100, 500).astype(float)
    demands = np.stack([lengths, np.ones(500), lengths ** 2], axis=1)
    for capacity in ([100, 4, 10_000], [100, 100, 4_000 + 99 ** 2], [100, 2, 10_000]):
        bins = packing.best_fit(demands, np.array(capacity, float), np.array([1.0, 0.1, 0.1]))
        assert set(bins) == set(range(bins.max() + 1))
        for d, c in zip(demands.T, capacity):
            assert np.bincount(bins, d).max() <= c
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[200.0, 1, 1]]), np.array([100.0, 1, 1]), np.ones(3))


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs)
    rows = [(r.id, r.n_bytes, r.n_removed, r.kept) for r in got.select(
        F.col("_row.doc_id").alias("id"), "n_bytes", "n_removed", suffix_dedup.joined_text(F.col("parts")).alias("kept")).collect()]
    by = {r[0]: r for r in rows}
    assert len(rows) == len(ROWS)
    assert by[1][1:] == by[2][1:] == (0, 0, "")
    assert by[4][3] == "" and by[5][3] == ""  # periodic texts repeat inside themselves
    assert by[6][3] == "x  y" and by[7][3] == ""
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_random_overlaps(spark):
    rng = np.random.default_rng(11)
    for alphabet, match, k in (("ab", 24, 8), ("abcé", 16, 5), ("a", 12, 4)):
        pool = "".join(rng.choice(list(alphabet), 400))
        texts = []
        for _ in range(60):
            parts = []
            for _ in range(rng.integers(0, 4)):
                a = int(rng.integers(0, 380))
                parts += [pool[a:a + int(rng.integers(1, 60))], "".join(rng.choice(list(alphabet), int(rng.integers(0, 9))))]
            texts.append("".join(parts))
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        got = {r.id: [(s.lo, s.hi) for s in r.spans] for r in suffix_dedup.remove_repeats(df, match=match, seed_bytes=k).select(
            F.col("_row.doc_id").alias("id"), "spans").collect()}
        raw = [t.encode() for t in texts]
        seen = {}
        for i, t in enumerate(raw):
            for p in range(len(t) - match + 1):
                seen.setdefault(t[p:p + match], []).append((i, p))
        for i, t in enumerate(raw):
            gone = np.zeros(len(t) + 2, int)
            for places in seen.values():
                if len(places) > 1:
                    for j, p in places:
                        if j == i:
                            gone[1 + p:1 + p + match] = 1
            edge = np.diff(gone)
            want = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
            assert got[i] == want, (alphabet, i)


def test_language(spark, docs, none):
    model = langid.fit_text_model(docs)
    rows = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    got = langid.identify(rows, model, id_cols=["doc_id"]).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: r.lang for r in got}[1] is None
    assert langid.identify(rows.where("false"), model, id_cols=["doc_id"]).count() == 0
    assert langid.fit_text_model(none).shape == (langid.BUCKETS, 5)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = docs.where("doc_id % 2 = 1")
    model = langid.fit_text_model(docs.where("doc_id % 2 = 0"))
    none = F.lit(None).cast("string")
    got = langid.identify(held.select("doc_id", "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host")), model,
                          id_cols=["doc_id"]).join(held.select("doc_id", F.col("lang").alias("true")), "doc_id")
    assert got.where(F.col("lang") == F.col("true")).count() >= 0.98 * held.count()


def test_html(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (4, "u", "<article><p>a<p>b</article>" * 2),
            (5, "u", "<div <p>broken <b>x</i> &amp; &#65; </div><!-- open"), (1, "u", None),
            (6, "u", "<html><body><nav><a>m</a></nav><article>" + "<p>w x y z.</p>" * 3000 + "</article></body></html>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    labeller = html_extract.fit_labeller(pages, train_pages=60)
    got = {r.page_id: r for r in html_extract.extract(df, labeller).collect()}
    assert got[1].text == "" and got[2].text == "" and got[1].n_chars == 0
    assert got[6].text == "\n".join(["w x y z."] * 3000)
    assert html_extract.extract(df.where("false"), labeller).count() == 0
    html_extract.fit_labeller(pages.where("false"))


def test_leaf_blocks():
    blocks = leaf_blocks('<p>a  <b>b</b>\n c<p>d<br>e<script>if (a<b) "</p>"</script><ul><li>x<li>y &lt;z&gt;</ul>tail')
    assert [b.text for b in blocks] == ["a b c", "d e", "x", "y <z>", "tail"]
    assert blocks[2].path == ("ul", "li") and blocks[4].path == ()


def test_lstm_gradients():
    rng = np.random.default_rng(2)
    model = html_extract.Labeller()
    pages = [([np.array([1, 5]), np.array([2]), np.array([1])], rng.random((3, 36), np.float32), np.array([1, 0, 1], np.float32)),
             ([np.array([5])], rng.random((1, 36), np.float32), np.array([0], np.float32))]
    batch = html_extract._padded(pages)
    for way in model.ways:  # double precision for the differences
        way.wx, way.wh, way.b = (p.astype(np.float64) for p in (way.wx, way.wh, way.b))
    _, grads = model.step(*batch)
    names = batch[0]
    for k, p in enumerate(model.parameters()):
        at = tuple(rng.integers(0, n) for n in (grads[k].shape))
        real = (int(names[at[0]]), *at[1:]) if len(p) == len(model.ways[0].wx) else at
        old = p[real]
        losses = []
        for step in (1e-3, -1e-3):
            p[real] = old + step
            losses.append(model.step(*batch)[0])
        p[real] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[k][at]) < 2e-3


def test_chat(spark):
    calls = spark.createDataFrame(
        [(1, "a", 0, "reply", '{"turn":0,"text":"hi"}', []), (1, "b", 1, "reply", '{"text":5,"turn":-1,"z":0}', ["nope", "a"]),
         (1, "c", 2, "reply", "not json", ["b"]), (1, "d", 3, "other", "{}", ["c"]), (2, "x", 0, "reply", "[1]", ["y"]),
         (2, "y", 1, "reply", None, ["x"]), (2, "z", 2, "reply", '{"text":""}', ["y"]), (1, "a", 5, "reply", "{}", ["b"]),
         (3, None, 0, "reply", "{}", None), (None, "n", None, None, None, None)],
        "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>").withColumn("r", F.lit(1))
    results = spark.createDataFrame([(1, "a", 1, "yes"), (1, "a", 2, "again"), (1, "lost", 3, None), (1, None, 1, "q")],
                                    "conv_id bigint, call_id string, turn bigint, content string")
    rows = chat.link_calls(calls, results, CHAT_SCHEMAS).collect()
    got = {r.call_id: r for r in rows if r.call_id}
    assert [got[c].depth for c in "abcdxyzn"] == [0, 1, 2, 3, None, None, None, 0]
    assert got["a"].status == "linked" and (got["a"].n_calls, got["a"].n_results, got["a"].result_turn) == (2, 2, 1)
    assert got["a"].message == '{"arguments":{"text":"hi","turn":0},"call_id":"a","name":"reply","result":"yes"}'
    assert got["b"].errors == "text: not string; turn: less than 0; z: unexpected" and got["b"].status == "no_result"
    assert got["c"].errors == "not JSON" and got["c"].message is None and got["d"].errors == "unknown tool"
    assert got["x"].status == "cycle" and got["x"].errors == "not an object" and got["lost"].status == "no_call"
    assert got["z"].errors == "text: shorter than 1; turn: missing"
    assert sum(r.status == "no_id" for r in rows) == 2
    assert chat.link_calls(calls.where("false"), results.where("false"), CHAT_SCHEMAS).count() == 0


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    null = [r for r in got if r.source is None]
    assert len(null) == 3 and all(r.weight == 5.0 for r in null)  # a, b, c, then null
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(none).count() == 0
    back = mixing.apply_mix(docs)
    assert back.columns == docs.columns and back.where("spans <> 'clash'").count() == 0
    assert mixing.apply_mix(none).count() == 0


def test_rank_in_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("g")).alias("g"))
    got = rank_in_group(df, ["g"], [F.col("id").desc()]).toPandas()
    for _, g in got.groupby("g", dropna=False):
        g = g.sort_values("id", ascending=False)
        assert g["_rank"].tolist() == list(range(len(g)))


def test_pipeline_stages_on_odd_rows(spark, docs, none, tmp_path):
    import corpus_pipeline
    for name, start in (("odd", docs), ("none", none)):
        frame = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{name}{i}")
            stage(spark, frame, "").write.parquet(out)
            frame = spark.read.parquet(out)
            if i < 4:
                assert frame.columns == docs.columns
        assert (frame.count() > 0) == (name == "odd")


def test_pipeline_near_dedup_keeps_one_of_every_group(spark):
    import corpus_pipeline
    prose = [" ".join(f"w{k}x{i * i % 97}" for i in range(300)) for k in range(6)]
    rows = [(None, prose[0]), (None, prose[1]), (None, prose[1]), (5, prose[2]), (5, prose[3]), (7, prose[4]), (None, prose[4]),
            (9, prose[4]), (9, prose[5]), (9, prose[5]), (11, None), (None, "")]
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()]
    want = [(None, prose[0]), (None, prose[1]), (5, prose[2]), (5, prose[3]), (7, prose[4]), (9, prose[5]), (11, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_pipeline_near_dedup_on_odd_rows(spark, docs):
    import corpus_pipeline
    got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    assert (None, "no id here at all") in got and len(got) == len(set(got))
    assert {d for d, _ in got} >= {1, 3, 4, 5, None, 8}


def test_mix_takes_every_row_by_its_own_copies(spark):
    rows = [(None if i % 3 == 0 else i % 5, f"{'w ' * (i % 11 + 1)}t{i // 2}", "en", "ab"[i % 2], i) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = mixing.apply_mix(df).collect()
    for source, n in taken.items():
        assert sum(len(r.text.split()) for r in got if r.source == source) == n > 0
    assert {tuple(r) for r in got} <= set(rows)
    times = [sum(r.n_chars == i for r in got) for i in range(120)]
    assert max(times) <= 2 and sum(times) == sum(r.copies for r in mixing.mix(df).collect())


def test_leaf_blocks_after_raw_elements():
    def texts(page):
        return [b.text for b in leaf_blocks(page)]
    assert texts('<p>a</p><svg class="i"/><p>b</p><p>c</p>') == ["a", "b", "c"]
    assert texts("<p>a</p><svg/><p>b</p><SVG viewBox='0 0 > 1' />c<svg>no</svg>") == ["a", "b", "c"]
    assert texts('<p>a</p><svg-icon name="x"></svg-icon><p>b</p>') == ["a", "b"]
    assert texts("<p>a</p><object-view>b</object-view><script-x/><p>c</p><style-guide>d</style-guide>") == ["a", "b", "c", "d"]
    assert texts('<p>a</p><svg class="i"><path d="M0"/><text>no</text></svg><p>b</p>') == ["a", "b"]
    assert texts("<p>a</p><script src=x />no</script\n><object>no</object><style\n>no</style><p>b</p>") == ["a", "b"]


def test_added_tokens_have_their_ids(spark):
    import zlib

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    words = packing.WordIds(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "x  <|endoftext|>  y\n", " <|endoftext|", "a<|endoftext|>b c",
             "<|endoftext|>\n\n it's", "plain text", ""]
    for text in texts:
        assert np.frombuffer(words.tokenize(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string")
    for r in packing.pack_documents(df, tokenizer_path()).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [packing.END_ID]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_declared_language_is_read_anywhere(spark):
    rows = [(1, "<!-- " + "x" * 5000 + " --><!DOCTYPE html>\n<html class=a lang='fr-CA'><p>a"), (2, " " * 5000 + '<HTML LANG="de"><p>a'),
            (3, '<!-- <html lang="es"> --><html><p>a'), (4, "<html lang=en>"), (5, None), (6, "y" * 5000)]
    df = spark.createDataFrame([(i, "http://a.org/", h) for i, h in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.declared for r in langid.page_evidence(df).collect()}
    assert got == {1: "fr-CA", 2: "de", 3: "", 4: "en", 5: "", 6: ""}


def test_chat_links_within_a_conversation_and_keeps_every_row(spark):
    calls = spark.createDataFrame(
        [(c, k, t, "reply", f'{{"text":"{c} {t}","turn":{t}}}', ["call_0"]) for c in (1, 2, None)
         for k, t in (("call_0", 0), ("call_1", 2))] + [(1, "call_1", 2, "reply", '{"text":"1 2","turn":2}', ["call_0"])] * 2,
        "conv_id bigint, call_id string, turn bigint, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "call_0", 1, "one"), (2, "call_1", 3, "two"), (2, "call_1", 4, "again"), (None, "call_0", 1, "none"),
                                     (3, "call_0", 1, "lost")], "conv_id bigint, call_id string, turn bigint, content string")
    got = [(r.conv_id, r.call_id, r.turn, r.after_id, r.depth, r.result_turn, r.n_calls, r.n_results, r.status)
           for r in chat.link_calls(calls, results, CHAT_SCHEMAS).collect()]
    want = [(1, "call_0", 0, None, 0, 1, 1, 1, "linked"), (1, "call_1", 2, "call_0", 1, None, 3, None, "no_result"),
            (2, "call_0", 0, None, 0, None, 1, None, "no_result"), (2, "call_1", 2, "call_0", 1, 3, 1, 2, "linked"),
            (None, "call_0", 0, None, 0, 1, 1, 1, "linked"), (None, "call_1", 2, "call_0", 1, None, 1, None, "no_result"),
            (3, "call_0", None, None, None, 1, None, 1, "no_call"), (2, "call_1", None, None, None, 4, None, None, "duplicate"),
            *[(1, "call_1", 2, None, None, None, None, None, "duplicate")] * 2]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_op6_returns_every_row(spark):
    from sparkprep.llm.queries import linked_turns
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 1, "assistant", "or no"), (1, 2, "tool", "42"),
            (1, 3, None, "who"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = [(r.name, r.status, r.message) for r in linked_turns(df).collect()]
    arguments = '"arguments":{"text":"hi","turn":0},"call_id":"1:0","name":"reply"'
    want = [("reply", "linked", f'{{{arguments},"result":"or no"}}'), ("reply", "duplicate", f"{{{arguments}}}"),
            (None, "duplicate", '{"call_id":"1:0","result":"yes"}'), ("tool", "other_role", '{"name":"tool","result":"42"}'),
            (None, "other_role", '{"result":"who"}'), ("reply", "no_id", '{"arguments":{"text":"x","turn":0},"name":"reply"}')]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
