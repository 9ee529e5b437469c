"""Registered queries of the training-data operators against brute force on sf0.001."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from tests.conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name):
    return duckdb.execute(f"SELECT * FROM '{SF_SMALL}/{name}.parquet'").fetchdf()


@pytest.fixture(scope="module")
def docs():
    return table("documents").sort_values("doc_id", ignore_index=True)


def result(spark, name, key="doc_id"):
    return E.queries()[name](spark, SF_SMALL).toPandas().sort_values(key, ignore_index=True)


def shingles(text, n=5):
    w = WORD.findall(text)
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_op1_fingerprints(spark, docs):
    got = result(spark, "op1_document_fingerprints")
    order = docs.iloc[::-1].reset_index(drop=True)
    errors = []
    for i, row in order.iterrows():
        after = order.text[(i + 1) % len(order)]
        cut = len(row.text) // 2
        edited = row.text[:len(row.text) - cut] + after[:cut]
        g = got[got.doc_id == row.doc_id].iloc[0]
        assert g.n_chars == len(row.text)
        assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors.append(g.near_edited - jaccard(shingles(row.text), shingles(edited)))
        errors.append(g.near_next - jaccard(shingles(row.text), shingles(after)))
    assert np.abs(errors).max() < 0.25 and np.std(errors) < 0.03 and abs(np.mean(errors)) < 0.01
    by_text = got.merge(docs[["doc_id", "text"]], on="doc_id").groupby("text").fingerprint.nunique()
    assert (by_text == 1).all()


def test_op2_top_k(spark):
    v = table("embeddings")
    x = np.floor(256 * np.stack(v.embedding).astype(float)).astype(np.int64)
    ids = v.vec_id.to_numpy()
    got = result(spark, "op2_exact_top_k", ["query_id", "rank"])
    assert set(got.query_id) == {i for i in ids if i % 50 == 0}
    for q, g in got.groupby("query_id"):
        score, other = x @ x[ids == q][0], ids != q
        top = np.lexsort((ids[other], -score[other]))[:5]
        assert g.vec_id.tolist() == ids[other][top].tolist()
        assert g.score.tolist() == score[other][top].tolist()
        assert g["rank"].tolist() == [1, 2, 3, 4, 5]


def test_op3_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
    pages = table("pages").set_index("page_id")
    for g in result(spark, "op3_url_filters", "page_id").itertuples():
        rest = pages.url[g.page_id].partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        assert (g.host, g.path) == (host.lower(), path)
        fits = [r for r in rules if (g.host == r[1] or g.host.endswith("." + r[1])) and path.startswith(r[2])]
        if fits:
            best = max(fits, key=lambda r: len(r[1] + r[2]))
            assert (g.rule, g.verdict) == (best[1] + best[2], best[0])
        else:
            assert g.rule is None and g.verdict in ("allow", "block")


def simhash(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def components(fps, ids, bits=2):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= bits
    label = ids.copy()
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label
        label = new


def test_op4_near_dedup(spark, docs):
    got = result(spark, "op4_simhash_near_dedup")
    fps = np.array([simhash(t) for t in docs.text], np.uint64)
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps.tolist()]
    assert got.component_id.tolist() == components(fps, docs.doc_id.to_numpy()).tolist()


def test_op5_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = result(spark, "op5_best_fit_packing", ["doc_id", "piece"])
    ids = {d: e.ids + [2] for d, e in zip(docs.doc_id, tokenizer.encode_batch(list(docs.text), add_special_tokens=False))}
    for d, g in got.groupby("doc_id"):
        assert g.length.sum() == len(ids[d]) and g.piece.tolist() == list(range(len(g)))
        assert (g.length.iloc[1:] == 1024).all() and g.length.max() <= 1024
        for a, n, crc in zip(g.start, g.length, g.ids_crc32):
            assert crc == zlib.crc32(np.array(ids[d][a:a + n], "<u4").tobytes())
    rows = got.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and len(used) <= -(-rows.length.sum() // 1024) * 1.02 + 1


def repeated_bytes(texts, match):
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - match + 1):
            seen.setdefault(t[p:p + match], []).append((i, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p:p + match] = True
    return gone


def test_op7_repeats(spark, docs):
    got = result(spark, "op7_suffix_array_dedup")
    texts = [t.encode() for t in docs.text]
    for g, t, gone in zip(got.itertuples(), texts, repeated_bytes(texts, 400)):
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert (g.n_bytes, g.n_removed, g.n_spans) == (len(t), int(gone.sum()), runs)
        assert g.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_op8_language(spark):
    got = result(spark, "op8_language_id", "page_id").merge(table("pages"), on="page_id")
    truth = got.url.str.extract(r"://[^/?#]*/(..)/")[0]
    assert (got.lang == truth).mean() > 0.97 and (got.text_lang == truth).mean() > 0.95


def article(page):
    inner = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", page)[1]
    parts = re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)
    plain = [" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts]
    return "\n".join(p for p in plain if p)


def test_op9_main_text(spark):
    got = result(spark, "op9_html_extraction", "page_id").merge(table("pages"), on="page_id")
    same = [g.text == article(g.html) for g in got.itertuples()]
    assert np.mean(same) >= 0.99
    assert (got.n_chars == got.text.str.len()).all()


def test_op10_mixing(spark, docs):
    got = result(spark, "op10_source_mixing")
    sizes = docs.text.map(lambda t: len(WORD.findall(t)))
    assert got["size"].tolist() == sizes.tolist()
    by = sizes.groupby(docs.source).sum().sort_index()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by.index))}
    target, full = {}, set()
    while True:
        rest = 1.5 * by.sum() - sum(2 * by[s] for s in full)
        total = sum(w for s, w in weight.items() if s not in full)
        target = {s: 2.0 * by[s] if s in full else rest * weight[s] / total for s in weight}
        more = {s for s in weight if target[s] > 2 * by[s]}
        if not more:
            break
        full |= more
    assert np.allclose(got.target, docs.source.map(target))
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    for s, g in got.groupby(docs.source):
        assert abs(g.taken.sum() - target[s]) <= g["size"].max()
    again = result(spark, "op10_source_mixing")
    assert again.taken.tolist() == got.taken.tolist()


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline
    frames, frame = [], spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, SF_SMALL).write.parquet(str(tmp_path / str(i)))
        frame = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert frame.columns == list(docs.columns), name
        frames.append(frame.toPandas())
    known, single, cut, mixed, pieces = frames
    assert len(known) == len(docs)  # every text of this table has letters of a known language
    label = components(np.array([simhash(t) for t in known.text], np.uint64), known.doc_id.to_numpy())
    assert sorted(single.doc_id) == sorted(set(label))
    single = single.sort_values("doc_id", ignore_index=True)
    gone = repeated_bytes([t.encode() for t in single.text], corpus_pipeline.REPEAT_BYTES)
    for t, g in zip(single.text, gone):
        words = [m.span() for m in re.finditer(WORD.pattern.encode(), t.encode())]
        edge = np.flatnonzero(np.diff(np.r_[0, g.astype(int), 0]))
        for lo, hi in zip(edge[::2], edge[1::2]):
            if sum(lo <= a and b <= hi for a, b in words) <= 50:
                g[lo:hi] = False
    for t, g, row in zip(single.text, gone, cut.sort_values("doc_id").itertuples()):
        kept = np.frombuffer(t.encode(), np.uint8)[~g].tobytes()
        assert row.text == kept.decode(errors="ignore") and row.n_chars == len(row.text)
    assert mixed.groupby("doc_id").size().max() <= 2
    texts = dict(zip(cut.doc_id, cut.text))
    assert all(texts[r.doc_id] == r.text for r in mixed.itertuples())
    assert sorted(set(pieces.doc_id)) == sorted(set(mixed.doc_id))
