"""License scans, chats, language-model scores, the quality classifier and the pipeline."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import chat, license_scan, lm_scoring, quality

DOCS = "doc_id long, text string, words int, row string, label int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "r", 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hits = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    r = random.Random(6)
    words = "under the mit license apache version 2 cc by nc foo É".split()
    texts = [None, "", "under the MIT-License", "CC BY NC cc by nc by nc", "x " * 20_000 + "under the mit license", "under the mit license " * 300]
    texts += [" ".join(r.choice(words) for _ in range(40)) for _ in range(200)]
    got = {x.doc_id: x for x in license_scan.license_scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base_places(t)
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
        assert not x.n_base or x.score == 1


def test_license_spans_survive_changed_words(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    texts = [mit, mit.replace("charge", "cost"), mit.replace("free of", "free and clear of"), " ".join(mit.split()[5:]), "permission is granted to nobody", "foo bar " * 3 + mit]
    got = {x.doc_id: x for x in license_scan.license_scan(docs(spark, texts)).collect()}
    assert [got[i].labels for i in range(6)] == ["mit", "mit", "mit", "", "", "mit"]
    assert got[0].score == 1.0 and 0.7 <= got[1].score < 1 and got[5].spans[0].first == 6 and got[5].n_base == 0


def test_each_word_of_a_template_counts_once(spark):
    """Half of a text said twice, two words apart, is still half of it."""
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software".split()
    x = license_scan.license_scan(docs(spark, [" ".join(mit[:4] + ["and", "so"] + mit[4:8] + ["and"] + mit[4:8])])).first()
    assert x.score == 8 / 16 and x.labels == ""


def test_foreign_words_count_in_a_span(spark):
    """A template with other words between its own agrees by its words over the whole stretch."""
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software".split()
    mixed = [w for i, m in enumerate(mit) for w in ([m, "x"] if i in (3, 5, 7, 9, 11) else [m])]
    apart = [w for i, m in enumerate(mit) for w in ([m, "x", "y"] if i in (3, 6, 9, 12) else [m])]
    got = license_scan.license_scan(docs(spark, [" ".join(mit), " ".join(mixed), " ".join(apart)])).orderBy("doc_id").collect()
    assert got[0].score == 1.0 and got[1].score <= 16 / 21 and got[2].score <= 16 / 24 and got[2].labels == ""


def test_whole_licence_texts(spark):
    long = [(p, label) for p, label in license_scan.OTHERS.items() if len(p.split()) > 40]
    r = random.Random(3)
    changed = [" ".join(w if r.random() > 0.05 else "other" for w in p.split()) for p, _ in long]
    got = license_scan.license_scan(docs(spark, [p for p, _ in long] + changed + ["foo " * 50 + p.upper() for p, _ in long])).orderBy("doc_id").collect()
    assert len(long) >= 5 and all(label in x.labels.split(",") for x, (_, label) in zip(got, long * 3, strict=True))
    assert all(x.score == 1.0 for x in got[: len(long)])


def test_license_borders(spark):
    assert license_scan.license_scan(docs(spark, [])).count() == 0
    assert license_scan.license_scan(docs(spark, ["a", "a", "cc by nc"], [1, 1, None])).count() == 3
    with pytest.raises(ValueError):
        license_scan.license_scan(docs(spark, ["a"]), base={"two words": "x"})


def test_license_plan_is_native(spark):
    plan = license_scan.license_scan(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_native_plans_have_no_python(spark):
    """The operators that are to run on built-in functions alone do, in every job that they start."""
    from reelspark.llm import chat, exact_dedup

    seen = []

    class Jobs:
        def onSuccess(self, name, execution, took):
            seen.append(execution.executedPlan().toString())

        def onFailure(self, name, execution, error):
            seen.append(execution.executedPlan().toString())

        class Java:
            implements = ["org.apache.spark.sql.util.QueryExecutionListener"]

    from pyspark.java_gateway import ensure_callback_server_started

    ensure_callback_server_started(spark.sparkContext._gateway)
    listener = Jobs()
    spark._jsparkSession.listenerManager().register(listener)
    try:
        exact_dedup.exact_groups(docs(spark, ["a", "A", "b"])).collect()
        chat.rotated_chats(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "ann", "x")], "conv_id long, turn long, role string, text string")).collect()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark._jsparkSession.listenerManager().unregister(listener)
    assert len(seen) > 3 and not any(re.search("Python|Pandas|Arrow", p) for p in seen)


def test_very_long_turns(spark):
    """A turn of some megabytes is rendered whole, its mask by characters."""
    long = "é<| " * 500_000
    got = spark.createDataFrame([(1, 0, "ann", long), (1, 1, "bob", "short")], "conv_id long, turn long, role string, text string")
    from reelspark.llm import chat

    for x in chat.rotated_chats(got).collect():
        assert (x.text, x.mask) == rendered([(0, "ann", long), (1, "bob", "short")], x.speaker)


def rendered(rows, speaker):
    text, mask = "", []
    for _, role, body in rows:
        head = "<|assistant|>\n" if role == speaker else f"<|user name={role}|>\n"
        body = body.replace("<|", "< |") + "<|end|>"
        if role == speaker:
            mask.append(f"{len(text) + len(head)}-{len(text) + len(head) + len(body)}")
        text += head + body + "\n"
    return text, ",".join(mask)


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|> é"), (1, 2, "ann", ""), (1, 1, "assistant", "<|end|> é"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "user", "late?"), (3, 0, "user", "b"), (3, 0, "bob", "a")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    got = {(x.conv_id, x.speaker, x.chunk): (x.text, x.mask) for x in chat.rotated_chats(df).collect()}
    one = [(0, "user", "hi"), (1, "assistant", "<|end|> é"), (2, "ann", "")]
    assert all(got[1, s, 0] == rendered(one, s) for s in ("user", "assistant", "ann"))
    assert got[2, "unknown", 0] == rendered([(0, "unknown", "")], "unknown")
    assert got[3, "bob", 0] == rendered([(0, "bob", "a"), (0, "user", "b")], "bob") and got[3, "user", -1] == rendered([(None, "user", "late?")], "user")
    assert chat.rotated_chats(df.limit(0)).count() == 0
    text, mask = got[1, "assistant", 0]
    a, b = map(int, mask.split("-"))
    assert text[a:b] == "< |end|> é<|end|>"


def test_long_chats_are_cut(spark, monkeypatch):
    df = spark.range(2000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("s"), F.col("id") % 3).alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.rotated_chats(df).orderBy("speaker", "chunk").collect()
    assert len(got) == 3 * 8 and sum(x.n_turns for x in got) == 3 * 2000 and sum(x.n_own for x in got) == 2000
    monkeypatch.setattr(chat, "CHUNK_ROWS", 10)
    assert max(x.n_turns for x in chat.rotated_chats(df.withColumn("turn", F.lit(0))).collect()) < 100


def test_full_chunks_are_cut_in_order(spark, monkeypatch):
    """Slots read one after the other give the turns in order; only full chunks have several."""
    r = random.Random(3)
    rows = list({(c, r.choice(turns), r.choice(("ann", "bob")), str(r.randrange(10**6))) for c, turns, n in ((1, range(4), 3000), (2, [None], 500), (3, range(3), 20)) for _ in range(n)})
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "CHUNK_ROWS", 64)
    got = chat.rotated_chats(df.union(df.limit(100))).collect()
    for c in (1, 2, 3):
        turns = sorted(((t, role, text) for k, t, role, text in rows if k == c), key=lambda x: (x[0] or 0, *x[1:]))
        for speaker in ("ann", "bob"):
            mine = sorted((x for x in got if (x.conv_id, x.speaker) == (c, speaker)), key=lambda x: x.slot)
            assert [x.slot for x in mine] == list(range(-(-len(turns) // 64)))
            assert [(x.text, x.mask) for x in mine] == [rendered(turns[i : i + 64], speaker) for i in range(0, len(turns), 64)]


def plain_bits(toks, target):
    """Per text and model the mean bits of its tokens, by plain counts of all texts but its own."""
    words, start, out = {w for t in toks for w in t}, "<s>", []

    def counted(texts):
        one, two, ctx = Counter(), Counter(), Counter()
        for t in texts:
            one.update(t)
            two.update(zip([start, *t], t, strict=False))
            ctx.update([start, *t[:-1]] if t else [])
        return one, two, ctx

    for m in (0, 1):
        of = [i for i in range(len(toks)) if m or i in target]
        whole, bits = counted([toks[i] for i in of]), []
        for i, t in enumerate(toks):
            own = counted([t] if i in of else [])
            n = sum(whole[0].values()) - sum(own[0].values())
            p = []
            for a, b in zip([start, *t], t, strict=False):
                single, ctx = (whole[0][b] - own[0][b] + 1) / (n + len(words)), whole[2][a] - own[2][a]
                p.append(0.5 * (whole[1][a, b] - own[1][a, b]) / ctx + 0.5 * single if ctx else single)
            bits.append(-np.log2(p).mean() if p else 0.0)
        out.append(bits)
    return out


def test_lm_scores_against_plain_counts(spark):
    r = random.Random(9)
    texts = [None, "", "  ", "a"] + [" ".join(r.choice("a b c d e f g".split()) for _ in range(30)) for _ in range(20)] + ["A a\tB\nb " * 3000, "last only here zz"]
    target = {3, 5, 6, 7}
    df = docs(spark, texts)
    got = {x.doc_id: x for x in lm_scoring.score_documents(df, target=F.col("doc_id").isin(*target)).collect()}
    toks = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    bits = plain_bits(toks, target)
    for i, t in enumerate(toks):
        assert got[i].n_tokens == len(t)
        assert got[i].target_bits == pytest.approx(bits[0][i]) and got[i].score == pytest.approx(bits[0][i] - bits[1][i])
    by_table = lm_scoring.score_documents(df, df.where(F.col("doc_id").isin(*target)).select("doc_id"))
    assert {x.doc_id: round(x.score, 9) for x in by_table.collect()} == {k: round(x.score, 9) for k, x in got.items()}
    assert lm_scoring.score_documents(docs(spark, [])).count() == 0


def test_lm_models_are_distributions():
    """After every word, one that is never followed included, the probabilities of all words sum up to 1."""
    texts = [["a", "b", "a"], ["b", "b", "c"], ["d"]]
    words = sorted({w for t in texts for w in t})
    one, two, ctx = Counter(w for t in texts for w in t), Counter(), Counter()
    for t in texts:
        two.update(zip(["<s>", *t], t, strict=False))
        ctx.update(["<s>", *t[:-1]])
    for before in ("<s>", *words):
        cols = [np.array(x) for x in ([one[w] for w in words], [two[before, w] for w in words], [ctx[before]] * len(words))]
        p = 2 ** -lm_scoring.token_losses(*cols, np.full(len(words), sum(one.values())), len(words), 0.3)
        assert p.sum() == pytest.approx(1.0)


def test_lm_scores_tell_all_words_apart(spark, monkeypatch):
    """More words and pairs than any fixed table: each has its own count, and chunks and blocks change nothing."""
    texts = [" ".join(f"w{j}" for j in range(i * 700, (i + 1) * 700)) for i in range(300)] + ["w0 w1 w2", None, "w0 w0 w209999 w1"]
    df = docs(spark, texts)
    score = lambda: {x.doc_id: x for x in lm_scoring.score_documents(df, target=F.col("doc_id") < 3).collect()}
    got, toks = score(), [(t or "").split() for t in texts]
    bits = plain_bits(toks, {0, 1, 2})
    for m, name in enumerate(("target_bits", "background_bits")):
        for i in range(len(toks)):
            assert got[i][name] == pytest.approx(bits[m][i])
    for name, n in {"CHUNK_TOKENS": 5000, "BLOCK_TOKENS": 100_000, "LEAST_BLOCKS": 3}.items():
        monkeypatch.setattr(lm_scoring, name, n)
    assert {i: round(x.score, 9) for i, x in score().items()} == {i: round(x.score, 9) for i, x in got.items()}


def test_quality(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet")
    model = quality.learn(read("documents"), read("labels"))
    got = quality.quality_scores(read("documents"), model).join(read("labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 40 and (got.predicted == got.quality).mean() > 0.95
    again = quality.learn(read("documents").withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "doc_id": F.col("doc_id")}), read("labels"))
    assert np.array_equal(model.value, again.value)
    odd = docs(spark, [None, "", "a b", "x" * 200_000, "a b"], [1, None, 3, 4, 3])
    rows = quality.quality_scores(odd, model).collect()
    assert len(rows) == 5 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    assert quality.keep_good(odd, read("labels")).columns == odd.columns


def test_quality_never_learns_from_held_out(spark):
    """Turning the labels of the held-out fifth over changes nothing."""
    texts = ["good words here. " * (i % 7 + 1) if i % 2 else "BAD!! $$$ ### " * (i % 5 + 1) for i in range(200)]
    df = docs(spark, texts)
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(df, labels), quality.learn(df, turned)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.feature, b.feature)
    none = quality.learn(df, labels.limit(0))
    assert quality.quality_scores(df, none).select("score").distinct().count() == 1


def test_quality_learns_from_each_id_once(spark, monkeypatch):
    """However often an id is repeated, one row of it is collected, whatever the order of the rows."""
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: (seen.append(x), fit(x, y))[1])
    texts = ["good words here. " * (i % 7 + 1) if i % 2 else "BAD!! $$$ ### " * (i % 5 + 1) for i in range(100)]
    df = docs(spark, texts)
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).where(~quality.held_out())
    hot = labels.agg(F.min("doc_id")).first()[0]
    more = df.union(docs(spark, [f"text {i}" for i in range(300)] + [None] * 50, [hot] * 350))
    a, b = quality.learn(more, labels), quality.learn(more.orderBy(F.desc("text")), labels)
    assert [len(x) for x in seen] == [labels.count()] * 2
    assert np.array_equal(seen[0], seen[1]) and np.array_equal(a.value, b.value)


def test_flat_trees_are_the_trees():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, trees=20)

    def walk(row, node):
        while model.left[node] != node:
            node = model.left[node] + (row[model.feature[node]] > model.threshold[node])
        return model.value[node]

    want = [1 / (1 + np.exp(-(model.base + sum(walk(row, n) for n in model.roots)))) for row in x]
    assert np.allclose(model.scores(x), want) and ((model.scores(x) > 0.5) == y).mean() > 0.95


def naive_best_split(x, y, base, least):
    """The best (gain, feature, threshold) of one split on the logistic loss, over all values of all features."""
    p = 1 / (1 + np.exp(-base))
    g, h, best = y - p, p * (1 - p), (0, None, None)
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) >= least:
                gain = sum(g[m].sum() ** 2 / (h * m.sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h * len(y) + 1)
                best = max(best, (gain, f, t), key=lambda b: b[0])
    return best


def test_fit_finds_the_best_split():
    """With fewer values than bins, one tree of depth 1 is the best split of all, and its leaves the Newton steps."""
    for seed in range(5):
        r = np.random.default_rng(seed)
        x = r.integers(0, 20, (300, 4)).astype(float)
        y = (x[:, seed % 4] + r.normal(size=300) * 3 > 9).astype(float)
        model = quality.fit(x, y, trees=1, depth=1, rate=1.0)
        gain, f, t = naive_best_split(x, y, model.base, 12)
        root = model.roots[0]
        went = x[:, model.feature[root]] <= model.threshold[root]
        assert model.feature[root] == f and np.array_equal(went, x[:, f] <= t)
        p = 1 / (1 + np.exp(-model.base))
        for side, node in ((went, model.left[root]), (~went, model.left[root] + 1)):
            assert model.value[node] == pytest.approx((y[side] - p).sum() / (p * (1 - p) * side.sum() + 1))


def test_statistics_by_hand():
    got = dict(zip(quality.FEATURES, quality.statistics("Ab ab ab, 12\n\n!! x"), strict=True))
    want = {"log_bytes": np.log1p(18), "log_words": np.log1p(6), "word_length": 2, "upper": 1 / 18, "digits": 2 / 18, "signs": 2 / 18, "repeated_signs": 1 / 18, "spaces": 4 / 18, "newlines": 2 / 18, "wide": 0, "distinct_words": 1, "top_word": 1 / 6, "ended_words": 1 / 6, "lone_signs": 1 / 6, "distinct_lines": 1, "longest_word": np.log1p(3), "lines_cut": 1}
    assert {k: got[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()}
    assert quality.statistics(None) == quality.statistics("") and len(quality.statistics("")) == len(quality.FEATURES)


def near_components(texts, k=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    low = list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while True:
        before = list(low)
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
        if low == before:
            return low


def test_pipeline_by_stages(spark, sf):
    """Each stage against brute force over its own input, and the whole against the stages one by one."""
    import corpus_pipeline as p
    import public_tokenizers
    from tokenizers import Tokenizer

    before = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = before.columns, spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(before, labels)
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, before, sf), name)
        rows = sorted(before.collect(), key=lambda x: x.doc_id)
        if name == "quality_classifier":
            want = {x.doc_id for x in rows if model.scores(np.array([quality.statistics(x.text)]))[0] >= 0.3}
        elif name == "exact_dedup":
            want = set({lower(x.text): x.doc_id for x in rows}.values())
        else:
            want = {rows[i].doc_id for i in set(near_components([x.text for x in rows]))}
        assert after.columns == columns and {x.doc_id for x in after.collect()} == want and after.count() == len(want)
        before = after
    rows, lib = p.run(spark, sf).collect(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    kept = {x.doc_id: len(lib.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in before.collect()}
    assert Counter({i: n for i, n in kept.items()}) == sum((Counter({x.doc_id: x.length}) for x in rows), Counter())
    room = Counter()
    for x in rows:
        room[x.sequence_id] += x.length
    assert max(room.values()) <= 4096 and len(room) <= -(-sum(kept.values()) // 4096) * 1.02 + 1
    good = {x.doc_id: x.quality for x in labels.collect()}
    assert sum(good.get(i) == 0 for i in kept) <= 2


def test_pipeline_borders(spark, sf, tmp_path):
    """Nulls in every column, repeated ids and rows, columns whose names clash with those inside, and an empty table."""
    import corpus_pipeline as p

    words = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, words), (1, words + " And more."), (2, words), (None, words), (None, None), (3, ""), (3, ""), (4, None), (5, "Some other words, quite different. " * 20), (5, "Some other words, quite different. " * 20)]
    frame = spark.createDataFrame([(i, t, None, "s", None, 1, "c", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, component_id string, row int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in p.STAGES[1:3]:
        frame = p.stored(stage(spark, frame, str(tmp_path)), "borders")
    got = sorted((x.doc_id or 0, (x.text or "")[:5], len(x.text or "")) for x in frame.collect())
    assert got == [(1, "word0", len(words) + 10), (4, "", 0), (5, "Some ", 700), (5, "Some ", 700)]
    assert frame.columns[-3:] == ["kept", "component_id", "row"]
    p.run(spark, str(tmp_path)).collect()
    (tmp_path / "none").mkdir()
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert p.run(spark, str(tmp_path / "none")).count() == 0


def test_queries_are_complete():
    from reelspark.llm import queries

    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)
