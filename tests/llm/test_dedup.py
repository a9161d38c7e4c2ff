"""Exact, near and embedding deduplication against brute force, and their borders."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import embedding_dedup, exact_dedup, near_dedup
from reelspark.llm.components import connected_components
from reelspark.llm.shingles import shingle_sets

DOCS = "doc_id long, text string, keep_id long, digest string, n int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def docs(spark, texts, ids=None):
    """With columns whose names clash with those inside."""
    return spark.createDataFrame([(i, t, 7, "x", 0) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def components(n, edges):
    low = list(range(n))
    for _ in range(n):
        before = list(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low
    return low


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, r.randint(101, 130)) for _ in range(60)] + [(200, 200), (None, 3)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[b] == 100 for a, b in edges if a == 100) and got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def expected_exact(ids, texts):
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[lower(t)].append(i)
    return {i: (max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)])) for i, t in zip(ids, texts, strict=True)}


@pytest.mark.parametrize("digest", [None, lambda: F.substring(F.sha2(exact_dedup.lower_ascii(F.col("text")).cast("binary"), 256), 1, 1), lambda: F.lit("same")])
def test_exact(spark, digest):
    texts = ["Ab", "aB", "ÄB", "äB", "", None, "x " * 40_000, "X " * 40_000, "only", "ab"]
    got = {x.doc_id: (x.keep_id, x.group_size) for x in exact_dedup.exact_groups(docs(spark, texts), digest=digest and digest()).collect()}
    assert got == expected_exact(range(len(texts)), texts)


def test_exact_borders(spark):
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0
    got = exact_dedup.exact_groups(docs(spark, ["a", "a", "b", "c", "c"], [1, 1, None, None, 4])).collect()
    assert sorted((x.doc_id or -1, x.keep_id or -1, x.group_size, x.kept) for x in got) == [(-1, -1, 1, True), (-1, 4, 2, False), (1, 1, 2, True), (1, 1, 2, True), (4, 4, 2, True)]
    kept = exact_dedup.drop_copies(docs(spark, ["a", "A", "b"]))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") and sorted(x.doc_id for x in kept.collect()) == [1, 2]


def test_copies_leave_by_id_and_text(spark):
    """No text is lost when an id is repeated, and copies without an id leave."""
    rows = [(1, "A"), (1, "unique"), (2, "a"), (None, "a"), (None, "b"), (None, None), (3, ""), (3, "")]
    kept = exact_dedup.drop_copies(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((x.doc_id or 0, x.text) for x in kept) == [(0, "b"), (1, "unique"), (2, "a"), (3, ""), (3, "")]


@pytest.mark.parametrize("digest,own_files", [(None, True), (lambda: F.lit("same"), False)])
def test_exact_calls_go_on(spark, tmp_path, digest, own_files):
    """Later calls know earlier rows; a digest that covers different texts joins nothing across calls either."""
    state, every = f"file://{tmp_path}/state", {}
    for k, texts in enumerate((["a"], ["b"], ["A", "b", None, "a"], ["", "c"])):
        now = docs(spark, texts, range(10 * k, 10 * k + len(texts)))
        if own_files:
            now.write.parquet(f"file://{tmp_path}/in{k}")
            now = spark.read.parquet(f"file://{tmp_path}/in{k}")
        every |= dict(zip(range(10 * k, 10 * k + len(texts)), texts, strict=True))
        got = exact_dedup.exact_groups(now, digest=digest and digest(), state_dir=state, read=exact_dedup.read_parquet if own_files else None).collect()
        want = expected_exact(every, every.values())
        assert {x.doc_id: (x.keep_id, x.group_size) for x in got} == {i: want[i] for i in range(10 * k, 10 * k + len(texts))}


@pytest.mark.parametrize("digest", [None, lambda: F.lit("same")])
def test_earlier_rows_are_told_again(spark, tmp_path, digest):
    """With restate a call also gives the earlier rows whose groups it changes: put over one another, calls are the whole."""
    state, told, every = f"file://{tmp_path}/state", {}, {}
    for k, texts in enumerate((["t", "u", "v"], ["T"], ["w", "U", "u"], ["t", None])):
        ids = range(10 * k, 10 * k + len(texts))
        every |= dict(zip(ids, texts, strict=True))
        got = exact_dedup.exact_groups(docs(spark, texts, ids), digest=digest and digest(), state_dir=state, restate=True).collect()
        assert {x.doc_id for x in got if not x.earlier} == set(ids)
        told |= {x.doc_id: (x.keep_id, x.group_size) for x in got}
        assert told == expected_exact(every, every.values())
    alone = exact_dedup.exact_groups(docs(spark, ["a", "A"]), restate=True).collect()
    assert [x.earlier for x in alone] == [False, False]


def test_states_are_written_as_one(spark, tmp_path, monkeypatch):
    """Many batches become one table, before and after which the states are the same; a table that is not whole doesn't count."""
    monkeypatch.setattr(exact_dedup, "COMPACT_AFTER", 2)
    state, every = tmp_path / "state", {}
    for k in range(7):
        texts = [f"t{k % 3}", f"only {k}"]
        every |= dict(zip(range(10 * k, 10 * k + 2), texts, strict=True))
        got = exact_dedup.exact_groups(docs(spark, texts, range(10 * k, 10 * k + 2)), state_dir=f"file://{state}", restate=True).collect()
        want = expected_exact(every, every.values())
        assert all((x.keep_id, x.group_size) == want[x.doc_id] for x in got)
        assert len(list((state / "changed").iterdir())) <= 3
        if k == 3:
            (state / "whole" / "upto=99").mkdir(parents=True)
    assert (state / "whole").exists()


def test_a_moved_text_is_an_error(spark, tmp_path):
    for name, texts in (("x", ["a"]), ("y", ["A"])):
        docs(spark, texts, [len(name + texts[0])]).coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    state, read = f"file://{tmp_path}/state", lambda spark, files: spark.read.parquet(f"file://{tmp_path}/y")
    exact_dedup.exact_groups(spark.read.parquet(f"file://{tmp_path}/x"), state_dir=state, read=exact_dedup.read_parquet).collect()
    with pytest.raises(RuntimeError):
        exact_dedup.exact_groups(spark.read.parquet(f"file://{tmp_path}/y").withColumn("doc_id", F.lit(1)), state_dir=state, read=read).collect()


def test_exact_state_goes_on(spark, tmp_path):
    """A second run over the same state takes in only new rows; nothing expires in between."""
    log = exact_dedup.digest_log(docs(spark, ["a", "b", "A"]))
    path = f"file://{tmp_path}/log"
    log.write.parquet(path)
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    first = {x.keep_id: x.group_size for x in exact_dedup.fold_stream(stream(), f"file://{tmp_path}/state").collect()}
    assert first == {2: 2, 1: 1}
    exact_dedup.digest_log(docs(spark, ["B", "c"], [10, 11])).write.mode("append").parquet(path)
    second = {x.keep_id: x.group_size for x in exact_dedup.fold_stream(stream(), f"file://{tmp_path}/state").collect()}
    assert second == {2: 2, 10: 2, 11: 1}


def word_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def near_texts():
    r = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "one two  three", "a b c d", "a b c d e"]
    for g in range(6):
        base = [r.choice(words) for _ in range(120)]
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, 7)):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    base = [r.choice(words) for _ in range(60)]
    for k in range(12):  # a chain: neighbours are alike, ends are not
        texts.append(" ".join(base[3 * k :] + [f"c{k}x{i}" for i in range(3 * k)]))
    texts += [texts[20], texts[20].upper(), " ".join(r.choice(words) for _ in range(30_000))]
    return texts


@pytest.mark.parametrize("k", [4, 5])
def test_near_equals_brute_force(spark, k):
    texts = near_texts()
    sets = word_sets(texts, k)
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(len(sets), edges)
    got = {x.doc_id: x for x in near_dedup.near_groups(docs(spark, texts), size=k).collect()}
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(sets))] == want
    assert [got[i].kept for i in range(len(sets))] == [i == w for i, w in enumerate(want)]


def test_near_borders(spark):
    assert near_dedup.near_groups(docs(spark, [])).count() == 0
    got = sorted((x.doc_id or -1, x.component_id or -1, x.kept) for x in near_dedup.near_groups(docs(spark, ["a b c d e f", "A b c d e f", "q"], [5, 3, None])).collect())
    assert got == [(-1, -1, True), (3, 3, True), (5, 3, False)]
    assert [x.doc_id for x in near_dedup.drop_near(docs(spark, ["a b", "A b"])).collect()] == [0]


def test_shingles_are_independent_of_batches():
    texts = [b"a b c d e f", b"", b"x" * 5000 + b" y z a b", b"A\tb\nc d e f"]
    one = [list(shingle_sets([t], 4))[0].tolist() for t in texts]
    assert [x.tolist() for x in shingle_sets(texts, 4)] == one and one[0] == one[3]


def test_parity_sketch_is_a_lower_bound(monkeypatch):
    r = np.random.default_rng(1)
    for n in (5, 200, 5000):
        a, b = (np.unique(r.integers(0, 3 * n, n).astype(np.uint64)) for _ in range(2))
        c = a[: n // 3]
        bits = near_dedup.apart(near_dedup.sketches([a, b, c]), np.array([0, 0, 2]), np.array([1, 2, 2])).tolist()
        assert bits[0] <= len(np.setxor1d(a, b)) and bits[1] <= len(a) - len(c) and bits[2] == 0
    wide = near_dedup.sketches([a])[0]
    monkeypatch.setattr(near_dedup, "SKETCH_BITS", (2048, 2048))
    assert len(wide) == 4096 and near_dedup._folded(wide, 256).tobytes() == near_dedup.sketches([a])[0]


def changed_copies(n, most):
    """n copies of one text of 200 words in which 1 to `most` words are new."""
    r = random.Random(n)
    base, out = [f"w{i}" for i in range(200)], []
    for i in range(n):
        t = list(base)
        for k in r.sample(range(200), r.randint(1, most)):
            t[k] = f"x{i}y{k}"
        out.append(" ".join(t))
    return out


def test_pairs_grow_with_the_members_of_a_group(spark, monkeypatch):
    """Copies that link with many others, but not with all: pairs that are verified grow in proportion, components are brute force's."""
    tried = []
    before = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *more: (tried.append(pairs.count()), before(pairs, *more))[1])
    for n in (150, 600):
        texts = changed_copies(n, 4)
        tried.append(0)
        got = {x.doc_id: x.component_id for x in near_dedup.near_groups(docs(spark, texts), size=5).collect()}
        sets = word_sets(texts, 5)
        edges = [(i, j) for i in range(n) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
        assert [got[i] for i in range(n)] == components(n, edges) and len(edges) > 10 * n
    at = tried.index(0, 1)
    assert sum(tried[at:]) <= 1.25 * 4 * sum(tried[:at]) and sum(tried[at:]) < 2 * near_dedup.FIRST * 600


def test_different_texts_under_one_id(spark):
    one = " ".join(f"a{i}" for i in range(40))
    got = near_dedup.drop_near(docs(spark, [one, "something else", one + " end", one, None, one], [1, 1, 2, None, None, 1]))
    assert sorted(x.text or "" for x in got.collect()) == ["", one, one, one, "something else"]


def vectors():
    r = np.random.default_rng(3)
    rows, at = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            base = r.normal(size=16)
            for _ in range(r.integers(1, 4)):
                rows.append((at, (base + r.normal(size=16) * 0.08).tolist(), label))
                at += 1
    hot = r.normal(size=16).tolist()
    rows += [(at + i, hot, 1) for i in range(30)]
    at += 30
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1e-200] * 16, [2e-200] * 16, [1.0, 2.0]]
    return rows + [(at + i, v, 0) for i, v in enumerate(odd)] + [(None, hot, 1)]


@pytest.mark.parametrize("pairs_from", [10**9, 1])
def test_embeddings_against_brute_force(spark, monkeypatch, pairs_from):
    monkeypatch.setattr(embedding_dedup, "PAIRS_FROM", pairs_from)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, block int")
    got = {x.vec_id: x for x in embedding_dedup.embedding_groups(df).collect()}
    ok = [i for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.93]
    n = defaultdict(int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    assert len(got) == len(rows)
    assert all(got[i].n_links <= n[i] for i in range(len(rows) - 1))
    assert sum(got[i].n_links for i in range(len(rows) - 1)) >= 0.9 * sum(n.values())
    hot = [i for i in ok if rows[i][1] == rows[-1][1]]
    assert all(got[i].n_links >= 29 for i in hot) and len({got[i].component_id for i in hot}) == 1
    assert embedding_dedup.embedding_groups(df.limit(0)).count() == 0


def test_few_vectors_are_compared(spark, sf):
    """Over whole tables, sharing pivots leaves less than a tenth of all pairs of a label to compare, and all but few links."""
    frame = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").where(F.col("label").isNotNull() & embedding_dedup.usable()).select("label", F.col("embedding").cast("array<double>").alias("vec"))
    rows = frame.distinct().toPandas()
    pivots = embedding_dedup.fit_pivots(frame.distinct(), embedding_dedup.pivots_for(len(rows)))[64]
    compared = pairs = links = found = 0
    noise = np.random.default_rng(0)
    for label in sorted(set(rows.label)):
        x = embedding_dedup._unit(np.stack(rows.vec[rows.label == label]))
        x = np.concatenate([x, embedding_dedup._unit(x + noise.normal(size=x.shape) * 0.04 * np.abs(x).max())])
        near = embedding_dedup.nearest_pivots(x, pivots, 8)
        ask, link = embedding_dedup.candidates(near, len(pivots), 3), x @ x.T >= 0.93
        up = np.triu_indices(len(x), 1)
        compared, pairs, links, found = compared + ask[up].sum(), pairs + len(up[0]), links + link[up].sum(), found + (ask & link)[up].sum()
    assert compared < 0.1 * pairs and links > 1000 and found >= 0.9 * links


def test_vectors_of_other_lengths_have_pivots(spark):
    """A few vectors of another length in the sample leave the others' pivots alone, and have pivots enough of their own."""
    r = np.random.default_rng(7)
    rows = [(r.normal(size=17 if i % 500 == 0 else 16).tolist(),) for i in range(3000)]
    pivots = embedding_dedup.fit_pivots(spark.createDataFrame(rows, "vec array<double>"), 128)
    assert {n: len(p) for n, p in pivots.items()} == {16: 128, 17: 128}
    for n in (16, 17, 40):
        x = embedding_dedup._unit(r.normal(size=(1500, n)))
        own = pivots.get(n, embedding_dedup.random_pivots(n, 128))
        ask = embedding_dedup.candidates(embedding_dedup.nearest_pivots(x, own, 8), 128, 3)
        assert ask.mean() < 0.1
        noisy = embedding_dedup._unit(x + r.normal(size=x.shape) * 0.02)
        near = [embedding_dedup.nearest_pivots(y, own, 8) for y in (x, noisy)]
        assert np.mean([len(np.intersect1d(a, b)) >= 3 for a, b in zip(*near, strict=True)]) >= 0.9


def test_pairs_of_pivots_give_the_same_candidates():
    """Each pair of vectors is found once, in the list of the first pivot it shares, or of the first two."""
    near = np.array([np.random.default_rng(i).choice(20, 6, replace=False) for i in range(60)])
    want = embedding_dedup.candidates(near, 20, 3)
    for level in (1, 2):
        lists, got = embedding_dedup.lists_of(near, 20, level), np.zeros((60, 60), dtype=int)
        for p in np.unique(lists).tolist():
            at = np.flatnonzero((lists == p).any(axis=1))
            own = divmod(p, 20) if level == 2 else (p, None)
            got[np.ix_(at, at)] += embedding_dedup.candidates(near[at], 20, 3, *own)
        assert (got == want).all()


def test_vectors_that_repeat_an_id(spark):
    """Equal rows are copies; different vectors under one id are linked each by itself, and the id stands for both."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, a, 0), (1, a, 0), (1, b, 0), (2, b, 0), (3, None, 0), (3, a, None)], "vec_id long, embedding array<double>, label int")
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in embedding_dedup.embedding_groups(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3)]


def test_embedding_lists_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(8)
    base = r.normal(size=8)
    df = spark.createDataFrame([(i, (base + r.normal(size=8) * 0.02).tolist(), 1) for i in range(90)], "vec_id long, embedding array<double>, label int")
    whole = embedding_dedup.embedding_groups(df, n_pivots=8, nearest=4).orderBy("vec_id").collect()
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    assert embedding_dedup.embedding_groups(df, n_pivots=8, nearest=4).orderBy("vec_id").collect() == whole
    assert all(x.component_id == 0 for x in whole) and sum(x.n_links for x in whole) >= 0.9 * 90 * 89


def thue_morse(n, a="a", b="b"):
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out


@pytest.mark.parametrize("n", [32, 64, 128, 512, 1024, 4096, 8192])
def test_words_of_a_pattern_are_told_apart(spark, n):
    """A pattern of bytes and its complement, whose differences cancel out in polynomial hashes, share nothing."""
    one, two = thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba"))
    got = near_dedup.near_groups(docs(spark, [one, two, one + " x y z", two + " x y z", one.upper()]), size=4).orderBy("doc_id").collect()
    assert [x.component_id for x in got] == [0, 1, 2, 3, 0]
    assert [len(set(s.tolist())) for s in shingle_sets([f"{one} {two}".encode()], 1)] == [2]


def test_shingles_by_hash_are_the_shingles():
    from reelspark.llm.shingles import shingles

    r = random.Random(12)
    texts = [" ".join(r.choice(["a", "bb", "é" * 40, "x" * 70, "Y", "\x00"]) for _ in range(r.randint(0, 30))).encode() for _ in range(200)]
    for size in (1, 4, 5):
        assert [len(s) for s in shingle_sets(texts, size)] == [len(shingles(t, size)) for t in texts]


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Were all shingles one hash, texts of nothing in common would still not be linked."""
    def same(texts, size):
        for t in texts:
            yield np.array([7], dtype=np.uint64) if t.split() else np.array([], dtype=np.uint64)

    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (3, "A b c d e f")], "node long, text string")
    out = near_dedup.verified(pairs, lambda nodes: texts, 4, 80, "t")
    assert [tuple(x) for x in out.collect()] == [(1, 3)]
    monkeypatch.setattr(near_dedup, "shingle_sets", same)
    run = near_dedup.verified(pairs, lambda nodes: texts, 4, 80, "t")
    assert {tuple(x) for x in run.collect()} <= {(1, 3)}
