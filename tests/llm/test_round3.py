"""Prefix trie, hard negatives and embedding near-duplicates against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import hard_negatives, prefix_trie, projections
from sparkprep.llm.simhash import Forest
from tests.conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(name):
    return duckdb.execute(f"SELECT * FROM '{SF_SMALL}/{name}.parquet'").fetchall()


# -- prefix trie -------------------------------------------------------------------

def trie(seq):
    """Every node of the trie of ``seq`` ({conv_id: ((role, text), ...)}), by walking it."""
    node, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, q in seq.items():
        for d in range(len(q) + 1):
            node[q[:d]].append(c)
    for k in node:
        if k:
            kids[k[:-1]] += 1
    for k, m in node.items():
        value = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += value
            leaves[k[:d]] += not kids[k]
    out = []
    for k, m in node.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seq[c]) == len(k))))
        out.append((min(m), len(k), min(node[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def in_order(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), r or "", x or ""))
    return {c: [z[1:] for z in sorted(v, key=lambda z: z[0])] for c, v in by.items()}


def rebuilt(rows):
    by, out = in_order(rows), {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(by.get(c - c % 20, [])[:h]) + tuple(turns[h:])
    return out


def nodes(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_op11_prefix_trie(spark):
    assert nodes(E.queries()["op11_prefix_trie"](spark, SF_SMALL)) == trie(rebuilt(table("conversations")))


def talks():
    """A third of the turns in one conversation, many copies, empty and absent parts, shared heads."""
    rng = np.random.default_rng(5)
    rows = [(40, t, "user" if t % 2 else None, f"long {t}") for t in range(300)]
    rows += [(41, t, "user" if t % 2 else None, f"long {t}") for t in range(250)] + [(41, 250, "user", "other end")]
    for c in range(100, 160):
        rows += [(c, t, "u", f"same {t}") for t in range(6)]
    for c in range(200, 260):
        rows += [(c, None if t == 0 else t, "u", [None, "", "a b", "c"][int(rng.integers(4))]) for t in range(int(rng.integers(1, 7)))]
    rows += [(7, 1, "u", "only"), (27, 0, "s", "x"), (27, 1, "s", "x"), (None, 3, "u", "no id"), (-5, 0, "u", "below zero")]
    return rows


@pytest.fixture(scope="module")
def odd_talks(spark):
    df = spark.createDataFrame(talks(), "conv_id bigint, turn bigint, role string, text string")
    return df.withColumn("depth", F.lit("clash")).withColumn("_part", F.lit("clash")).withColumn("pos", F.lit("clash"))


def grafted(df):
    turns, parts = prefix_trie.ordered_turns(df)
    conv = F.col("conv_id")
    return prefix_trie.grafted_sequences(turns, parts, F.crc32(conv.cast("string").cast("binary")) % 4, conv - conv % 20)


def test_trie_of_odd_conversations(spark, odd_talks):
    seq = rebuilt([r for r in talks() if r[0] is None or r[0] >= 0])
    got = prefix_trie.prefix_nodes(*grafted(odd_talks.where("conv_id IS NULL OR conv_id >= 0")))
    assert nodes(got) == trie(seq)
    # the sketch proves tails single, so they are not shuffled; nothing shared is called single
    assert got.where("single").count() > 60 and got.where("single AND n_convs > 1").count() == 0
    assert prefix_trie.prefix_nodes(*grafted(odd_talks.where("false"))).count() == 0


def test_trie_with_a_useless_sketch(odd_talks):
    """A sketch of too few cells proves nothing; the rows stay the same."""
    rows, convs = grafted(odd_talks.where("conv_id >= 0"))
    got = prefix_trie.prefix_nodes(rows, convs, sketch_rows=1, max_width=8)
    assert nodes(got) == trie(rebuilt([r for r in talks() if r[0] is not None and r[0] >= 0]))


def test_conversation_trie_has_texts(odd_talks):
    got = prefix_trie.conversation_trie(odd_talks.where("conv_id IN (40, 41, 7)"))
    seq = {c: tuple(v) for c, v in in_order([r for r in talks() if r[0] in (40, 41, 7)]).items()}
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in got.collect()) == sorted((a, b, d) for a, b, _, d, *_ in trie(seq))
    for r in got.collect():
        assert (r.role, r.text) == (seq[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_end_digests_stream_over_chunks(spark):
    ids = list(range(0, 9000, 3))
    df = spark.createDataFrame([(1, 2, 3, i) for i in ids] + [(1, 2, 4, 5)], "depth bigint, dx bigint, dy bigint, conv_id bigint")
    got = {r.dy: r.ends_sha256 for r in prefix_trie.end_digests(df, size=7).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 4: hashlib.sha256(b"5").hexdigest()}


# -- hard negatives ------------------------------------------------------------------

def mined(ids, labels, x, anchors=100):
    q = [[int(v) for v in np.floor(256 * row)] for row in x]
    out = []
    for a in [i for i, v in enumerate(ids) if v % anchors == 0]:
        score = [sum(s * t for s, t in zip(q[a], row)) for row in q]
        order = sorted((i for i in range(len(ids)) if ids[i] != ids[a]), key=lambda i: (-score[i], ids[i]))
        for p in [i for i in order if labels[i] == labels[a]][:5]:
            fits = [n for n in order if labels[n] != labels[a] and 30 * score[p] <= 100 * score[n] <= 90 * score[p]]
            out += [(ids[a], ids[p], k, ids[n], score[p], score[n]) for k, n in enumerate(fits[:10], 1)]
    return sorted(out)


def test_op12_hard_negatives(spark):
    rows = table("embeddings")
    labels = [(r[2] + 1) % 10 if r[0] % 7 == 0 else r[2] for r in rows]
    got = sorted(tuple(r) for r in E.queries()["op12_hard_negatives"](spark, SF_SMALL).collect())
    assert got == mined([r[0] for r in rows], labels, np.array([r[1] for r in rows], float))


def test_hard_negatives_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 7)) * rng.choice([0.01, 1, 30], (400, 1))
    x[:60] = x[0] + rng.normal(size=(60, 7)) * 0.05 * np.abs(x[0]).max()
    x[60:64] = 0.0
    x[70:75] = x[70]  # ties
    ids, labels = list(range(400)), [int(v) for v in np.where(np.arange(400) % 3 == 0, 1, rng.integers(0, 4, 400))]
    rows = [(i, v.tolist(), c) for i, v, c in zip(ids, x, labels)]
    odd = [(None, [1.0] * 7, 1), (500, None, 1), (600, [float("nan")] * 7, 1), (700, [None] * 7, 2), (800, [1.0] * 7, None),
           (900, [float("inf")] * 7, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int").withColumn("cell", F.lit("clash"))
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0).collect())
    assert got == mined(ids, labels, x, 10)
    assert hard_negatives.mine(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df.where("label IS NULL"), F.col("vec_id") % 10 == 0).count() == 0


def test_hard_negatives_of_large_vectors(spark):
    """Scores beyond float64, components beyond a bigint; a repeated positive's negatives come twice."""
    rows = [(0, [2.0**22, 3.0], 1), (1, [2.0**23 + 0.5, 1.0], 1), (1, [2.0**23 + 0.5, 1.0], 1), (2, [2.0**22, 5.0], 2),
            (3, [-1e300, 1.0], 2), (4, [2.0**22, 4.0], 3), (5, [-1e250, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") == 0).collect())
    small = [r for r in rows if abs(r[1][0]) < 1e200]
    want = mined([r[0] for r in small], [r[2] for r in small], np.array([r[1] for r in small]))
    assert got == want and len(got) == 4 and got[0][4] > 2**60
    with pytest.raises(Exception, match="BIGINT"):  # a returned score is beyond a bigint
        hard_negatives.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1), (2, [5e29], 2)], df.schema), F.col("vec_id") == 0).collect()


def test_block_windows_drop_no_row():
    rng = np.random.default_rng(0)
    refs = hard_negatives.choose_references(rng.normal(size=(50, 5)), 6)
    dropped = 0
    for trial in range(200):
        rows = np.floor(256 * rng.normal(size=(1, 5)) + rng.normal(size=(30, 5)) * rng.choice([5, 100, 400]))
        theta = hard_negatives.angles(rows, refs)
        cell = int(theta[0].argmin())
        order = np.argsort(theta[:, cell], kind="stable")
        rows, theta = rows[order], theta[order]
        block = hard_negatives.Block(1, cell, np.arange(30).tobytes(), rows.tobytes(), None, theta.tobytes(),
                                     hard_negatives._norms(rows).tobytes())
        anchor = np.floor(256 * rng.normal(size=(1, 5)))
        scores = rows @ anchor[0]
        low, high = np.sort(rng.choice(scores, 2)) if trial % 2 else (float(scores.max()), np.inf)
        a, b = block.window(hard_negatives.angles(anchor, refs)[0], float(hard_negatives._norms(anchor)[0]), low, high)
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        assert all(a <= i < b for i in inside)
        dropped += 30 - (b - a)
        low = 1.1 * float(block.most) * float(np.linalg.norm(anchor))
        assert block.window(hard_negatives.angles(anchor, refs)[0], float(hard_negatives._norms(anchor)[0]), low, np.inf) == (0, 0)
    assert dropped > 200


# -- embedding near-duplicates -----------------------------------------------------------

def linked(ids, labels, x, cosine=0.93):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= cosine) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    forest = Forest(len(x))
    forest.union(*np.nonzero(near))
    root = forest.roots(np.arange(len(x)))
    name = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(name, root, ids)
    return near, name[root]


def clusters(n, dims, seed=1):
    """Groups around centres, with pairs on both sides of the threshold, and one dense group of a third."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8, dims))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    spread = rng.choice([0.02, 0.15, 0.19, 0.27], (n, 1)) / np.sqrt(dims) * 1.4
    x = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, dims)) * spread
    x[:n // 3] = centre[0] + rng.normal(size=(n // 3, dims)) * 0.1 / np.sqrt(dims)
    return x, rng.integers(0, 3, n) * (np.arange(n) >= n // 3)


@pytest.mark.parametrize("rows, cell, most", [(1500, 2048, 4096), (1500, 64, 100)])
def test_near_duplicate_vectors(spark, rows, cell, most):
    """In one cell a label, and in many tables with cells cut into blocks."""
    x, labels = clusters(rows, 24)
    ids = np.arange(rows)
    df = spark.createDataFrame([(int(i), v.tolist(), int(c)) for i, v, c in zip(ids, x, labels)],
                               "vec_id bigint, embedding array<double>, label int")
    got = projections.near_duplicates(df, cell_rows=cell, most_rows=most).toPandas().sort_values("vec_id", ignore_index=True)
    near, names = linked(ids, labels, x)
    found, all_ = got.n_links.to_numpy(), near.sum(axis=1)
    assert (found <= all_).all() and found.sum() >= 0.985 * all_.sum() and all_.sum() > 10000
    assert (got.component_id == names).mean() > 0.97
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_calibration():
    plan = projections.make_plan(64, 10**6)
    rng = np.random.default_rng(2)
    a = projections.directions(rng.normal(size=(4000, 64)))
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * projections.directions(other)  # pairs at the threshold
    hits = (np.abs((a - b) @ plan.projections) <= plan.half).sum(axis=1)
    assert (hits >= plan.count).mean() > 0.985
    label = np.zeros(len(a), np.int64)
    met = np.zeros(len(a), bool)
    for t, (k, o) in enumerate(zip(plan.keys, plan.offsets)):
        met |= projections.cells(a, label, k, o, plan.width, t) == projections.cells(b, label, k, o, plan.width, t)
    assert met.mean() > 0.985
    assert (np.abs((a - a[::-1]) @ plan.projections) <= plan.half).sum(axis=1).mean() < plan.count - 5  # and others do not pass


def test_near_duplicate_odd_rows(spark):
    v = [3.0, -4.0, 0.5]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, [6.0, -8.0, 1.0], 1), (5, None, 1), (6, [0.0, -0.0, 0.0], 1), (7, [], 1),
            (8, [None, 1.0], 1), (9, [float("nan"), 1.0], 1), (10, v, None), (None, v, 1), (11, [float("inf")], 1), (12, [0.0, 1e300], 3),
            (13, [-0.0, 1e300], 3), (14, [1.0], 4), (15, [1.0, 0.0], 4), (None, [1.0], 9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("cid", F.lit("clash"))
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in projections.near_duplicates(df).collect()), key=str)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 0, 3, True), (4, 4, 1, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
            (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (12, 1, 12, True), (13, 1, 12, False),
            (14, 1, 14, True), (15, 1, 14, False)]
    assert got == sorted([(False, *w) for w in want] + [(True, 0, 4, 1, False), (True, 0, 0, None, False)], key=str)
    empty = projections.near_duplicates(df.where("false"))
    assert empty.count() == 0 and empty.columns == ["vec_id", "n_links", "component_id", "kept"]
