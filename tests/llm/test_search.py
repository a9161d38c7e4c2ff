"""Lexical search, source audit and top-k search against brute force, and their borders."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from reelspark.llm import lexical_search, source_audit, topk_search
from reelspark.llm.terms import LETTERS_ONLY, WITH_DIGITS, terms

DOCS = "doc_id long, text string, lang string, source string, term string, n int, rank int, item_id int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("table,pattern", [(WITH_DIGITS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), (LETTERS_ONLY, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")])
def test_terms_are_the_pattern(table, pattern):
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("aZz09_-. \n\t\x00\x7fÄé 　ßK") for _ in range(r.randint(0, 40)))
        assert [x.decode() for x in terms(t.encode(), table)] == re.findall(pattern, lower(t))
    assert terms(None, table) == terms(b"", table) == []


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns whose names clash with those inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], DOCS)


def word(r):
    return r.choice("abcdefghij") + r.choice("xyz")[: r.randint(0, 1)]


# ---- ranked search

def ranked(rows, items, k):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) for _, t in rows]
    n_docs, n_all = sum(bool(w) for w in words), sum(map(len, words))
    df = Counter(x for w in words for x in set(w))
    out = []
    for item, text in items.items():
        asked = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text)))
        scores = []
        for (doc, _), w in zip(rows, words, strict=True):
            tf, m = Counter(w), 50 + (50 * len(w) * n_docs) // max(1, n_all)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in asked if tf[t])
            if s > 0 and doc is not None:
                scores.append((-s, doc))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def items(spark, rows):
    return spark.createDataFrame([(*r, "y", 5) for r in rows], "item_id long, text string, score string, doc_id int")


@pytest.mark.parametrize("block", [1 << 17, 4])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "LEAF", 3)
    monkeypatch.setattr(lexical_search, "TREE_ENTRIES", 400)
    r = random.Random(3)
    rows = [(i, " ".join(word(r) for _ in range(r.choice([1, 3, 10, 60])))) for i in range(300)]
    rows += [(1000 + i, "Ax b C") for i in range(40)] + [(2000, None), (2001, ""), (2002, "---"), (2003, "az " * 50_000), (None, "ax bx cx"), (5, "ax"), (5, "ax")]
    asked = {1: "ax B, cx", 2: "j", 3: "nothing known", 4: "", 5: "a b c d e f g h i j ax bx"}
    found = lexical_search.ranked_search(docs(spark, [(*x, "l", "s") for x in rows]), items(spark, [*asked.items(), (None, "ax"), (1, "b"), (6, None)]), k=7, block_terms=block)
    assert sorted(map(tuple, found.collect())) == ranked(rows, asked, 7)


def test_search_borders(spark):
    none = lexical_search.ranked_search(docs(spark, []), items(spark, [(1, "a")]))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.ranked_search(docs(spark, [(1, "a", None, None)]), items(spark, [])).count() == 0
    # a term that all documents hold may weigh 0, and then finds nothing
    assert lexical_search.ranked_search(docs(spark, [(i, "a", None, None) for i in range(2000)]), items(spark, [(1, "a")])).count() == 0


def test_search_leaves_documents_out(monkeypatch):
    """The tree gives the k best of all its documents from a part of them."""
    r, n = np.random.default_rng(5), 60
    rows = []
    for i in range(4000):
        ranks = np.flatnonzero(r.random(n) < 1 / (1 + np.arange(n)))
        rows.append((i, int(50 + r.integers(0, 100)), ranks, r.integers(1, 5, len(ranks))))
    tree = lexical_search.DocumentTree(rows, n)
    seen, whole = [0], tree._scores

    def counted(keys, counts, at, m, *rest):
        seen[0] += len(at) if keys is tree.doc_keys else 0
        return whole(keys, counts, at, m, *rest)

    monkeypatch.setattr(tree, "_scores", counted)
    ranks, weights = np.array([0, 3, 20, 40, 55]), np.array([100, 900, 2500, 3000, 3300])
    best = []
    tree.search(ranks, weights, best, 10)
    visited = seen[0]
    scores = whole(tree.doc_keys, tree.doc_counts, np.arange(len(rows)), tree.m, ranks, weights)
    assert sorted(best, reverse=True) == sorted(zip(scores.tolist(), (-tree.ids).tolist(), strict=True), reverse=True)[:10]
    assert visited < 0.2 * len(rows)


# ---- source audit

def audit(rows, least, top):
    """Brute force with whole numbers of any size."""
    n, df, groups = defaultdict(Counter), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        n[lang, source].update(words)
        df.update((lang, w) for w in set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {w for (x, w), c in df.items() if x == lang and c >= least}
        sources = [s for x, s in groups if x == lang]

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        of, q = {s: p(n[lang, s]) for s in sources}, p(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in sources if o != s]
            more = [(of[s][t] - q[t], t) for t in kept if n[lang, s][t] > 0 and of[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", more)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i + 1) for i, (v, o) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("cells,held", [(1 << 20, 1 << 18), (40, 10)])
def test_audit_equals_brute_force(spark, monkeypatch, cells, held):
    monkeypatch.setattr(source_audit, "CELLS", cells)
    monkeypatch.setattr(source_audit, "HELD", held)
    r = random.Random(8)
    rows = [(i, " ".join(word(r) for _ in range(r.randint(0, 30))), r.choice(["en", "en", "de", "é"]), f"s{r.choice([0, 0, 0, 1, 2, 3])}") for i in range(250)]
    rows += [(1, "Ax ÄÖ ÄÖ 12b", None, None), (1, "ax äö", None, ""), (None, None, "en", "only"), (7, "", "empty", "a"), (7, None, "empty", "b"), (8, "ax " * 50_000, "en", "s1"), (9, "k", "single", "s")]
    got = source_audit.source_audit(docs(spark, rows), least=4, top=5)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audit(rows, 4, 5)


def test_audit_of_nothing(spark):
    assert source_audit.source_audit(docs(spark, [])).count() == 0
    assert source_audit.source_audit(docs(spark, [(1, "a", "en", "s")])).count() == 0


def test_shares_are_exact():
    n = np.array([0, 1, 999, 4 * 10**12, 7 * 10**14], dtype=np.int64)
    for total, v in ((0, 1), (10**6, 333), (7 * 10**14, 5 * 10**6)):
        assert source_audit.shares(n, np.full(5, total + int(n.max())), v).tolist() == [1 + 10**9 * (int(x) + 5) // (total + int(n.max()) + 5 * v) for x in n]


def test_pairs_of_a_path_are_added_once(monkeypatch):
    """Rows that share a path cost one addition for each of its nodes and ancestors."""
    added, add = [0], np.add.at

    class Adds:
        @staticmethod
        def at(out, where, values):
            added[0] += len(values) if isinstance(where, tuple) else 0
            add(out, where, values)

    times = 500
    source, count = np.tile([0, 1, 2], times), np.tile([3, 1, 4], times)
    monkeypatch.setattr(np, "add", Adds)
    got = source_audit.tree_differences(source, count, np.arange(0, 3 * times + 1, 3), np.array([3, 1, 4]) * times, times)
    monkeypatch.undo()
    p = source_audit.shares(np.array([3, 1, 4]), np.array([3, 1, 4]) * times, times)
    assert added[0] == 3 and (got == times * np.abs(p[:, None] - p[None, :])).all()


# ---- top-k search

def products(rows, k, every):
    out = []
    for q, x in rows:
        if q is not None and q % every == 0 and x is not None:
            a = [math.floor(64 * v) for v in x]
            scores = [(-sum(s * t for s, t in zip(a, (math.floor(64 * v) for v in y), strict=True)), i) for i, y in rows if y is not None and i is not None and i != q and len(y) == len(x)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, node int, asker int, block int, vec int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], 1, 2, 3, 4) for i, x in rows], VECTORS)


@pytest.mark.parametrize("routes,block,queries", [(None, 8192, 1024), (6, 20, 3)])
def test_top_products_equal_brute_force(spark, monkeypatch, routes, block, queries):
    for name, value in (("BLOCK", block), ("QUERIES", queries), ("PAGE", 8)):
        monkeypatch.setattr(topk_search, name, value)
    r = np.random.default_rng(4)
    centers = r.normal(size=(6, 12))
    rows = [(i, (centers[i % 6] + 0.3 * r.normal(size=12)).tolist()) for i in range(400)]
    rows += [(500 + i, rows[10][1]) for i in range(60)]  # one vector many times
    rows += [(700 + i, r.normal(size=5).tolist()) for i in range(30)] + [(800, []), (801, []), (820, [0.0] * 12), (840, [3e4] * 12), (841, [-3e4] * 12)]
    out = [(900, None), (920, [None] * 12), (940, [math.nan] * 12), (960, [math.inf] * 12), (None, rows[0][1]), (980, [1e300] * 12)]
    twice = [rows[20], rows[21]]
    got = topk_search.top_products(vectors(spark, rows + out + twice), k=5, every=20, n_routes=routes)
    assert sorted(map(tuple, got.collect())) == products(rows, 5, 20)


def test_large_numbers_are_exact(spark):
    """Sums that doubles can't hold are added as whole numbers."""
    r = np.random.default_rng(2)
    rows = [(i, (r.integers(-(2**40), 2**40, 6) / 2.0**18).tolist()) for i in range(60)]
    got = topk_search.top_products(vectors(spark, rows), k=7, every=20)
    want = products(rows, 7, 20)
    assert max(abs(s) for *_, s in want) > 2**53 and sorted(map(tuple, got.collect())) == want


def test_top_products_borders(spark):
    none = topk_search.top_products(vectors(spark, []))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert topk_search.top_products(vectors(spark, [(1, [1.0])])).count() == 0
    assert topk_search.top_products(vectors(spark, [(0, [1.0])])).count() == 0
    # different vectors under one id are rows each
    got = topk_search.top_products(vectors(spark, [(0, [1.0]), (3, [2.0]), (3, [4.0]), (3, [4.0])]))
    assert [tuple(x) for x in got.orderBy("rank").collect()] == [(0, 1, 3, 64 * 256), (0, 2, 3, 64 * 128)]


def test_bounds_save_products(monkeypatch):
    """Near queries are answered from few of a block's vectors."""
    monkeypatch.setattr(topk_search, "PAGE", 64)
    r = np.random.default_rng(6)
    x = (64 * (r.normal(size=(40, 16))[r.integers(0, 40, 4000)] + 0.05 * r.normal(size=(4000, 16)))).astype(np.int64)
    most = float(topk_search.norms(x).max())
    ids = np.arange(len(x))
    rows = []
    for p in topk_search.pages(x, most):
        at = p.pop("at")
        apart = p.pop("apart")
        leaf = at is not None
        rows.append(p | {"center": p["center"].tobytes(), "rows": x[at].tobytes() if leaf else None, "leasts": ids[at].tobytes() if leaf else None, "nodes": ids[at].tobytes() if leaf else None, "apart": apart.tobytes() if leaf else None})
    tree = topk_search.Tree(pd.DataFrame(rows), most)
    for q in range(0, 200, 10):
        got = sorted(tree.search(x[q], 10), reverse=True)
        scores = x @ x[q]
        assert [(s, -i) for s, i, _ in got] == sorted(zip(scores.tolist(), ids.tolist(), strict=True), key=lambda t: (-t[0], t[1]))[:10]
    assert tree.computed < 0.5 * 20 * len(x)


def test_new_queries_equal_their_sql(spark, sf):
    import duckdb

    from reelspark.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op11_lexical_search", "op12_source_audit", "op13_topk_search"):
        got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLE[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols and sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_plans_make_no_cross_join(spark, sf):
    from reelspark.llm import queries

    plan = queries.op12_source_audit(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
