from collections import Counter

import numpy as np

from pressgauge.llm import lm


def test_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "one"), (-4, "zz qq xx " * 50), (-4, "zz qq xx " * 50)], "doc_id long, text string")
    docs = df.union(odd)
    vocab, net = lm.train(docs)
    got = lm.score(docs, vocab, net).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got[:40] + got[-5:]:
        t = vocab(texts[r.doc_id])
        want = 0.0
        for i in range(len(t)):  # token by token
            ctx = [t[j] if 0 <= j < len(t) else lm.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
            want += net.log_probs(t[i : i + 1], np.array([ctx]))[0]
        assert r.n_tokens == len(t) and abs(r.log_likelihood - want) < 1e-3 * max(1, abs(want))
    assert [r.mean_log_likelihood for r in got if r.doc_id in (-1, -2)] == [None, None]
    tokens, ctx = lm.contexts([vocab(texts[i]) for i in list(texts)[:100]])
    p = lm.Network.start(np.zeros(lm.SIZE))
    assert net.log_probs(tokens, ctx).mean() > p.log_probs(tokens, ctx).mean() + 1
    z = sum(np.exp(net.log_probs(np.array([k]), ctx[:1])[0]) for k in range(lm.SIZE))
    assert abs(z - 1) < 1e-4


def test_order_matters_and_counts_cover_everything(spark):
    df = spark.createDataFrame([(i, "the cat sat on the mat while the dog ran to the park") for i in range(300)], "doc_id long, text string")
    counts = {r.word: r.n for r in lm.word_counts(df).collect()}
    assert counts["the"] == 1200 and sum(counts.values()) == 3900
    vocab, net = lm.train(df)
    good, bad = (net.log_probs(*lm.contexts([vocab(t)])).sum() for t in ("the cat sat on the mat", "mat the on sat cat the"))
    assert good > bad
    e = df.limit(0)
    assert lm.score(e, *lm.train(e)).count() == 0


def test_training_parameters_are_those_chosen_before_the_time_limit():
    assert (lm.STEP, lm.RATE, lm.PER_CLASS) == (4096, 0.02, 64)


def test_words_of_a_hashed_entry_are_told_apart(spark):
    common = [f"c{i}" for i in range(lm.VOCAB)] * 12
    rare = [f"r{i}" for i in range(300)]
    texts = [" ".join(common), " ".join(rare), " ".join(rare[:150] * 9), "r0", "r0", "r299", None, "c1 r5 c2"]
    df = spark.createDataFrame([(i if i != 4 else 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    vocab, net = lm.train(df)
    words = [w for t in texts for w in (t or "").split() if w[0] == "r"]
    n, entry = Counter(words), Counter(lm.zlib.crc32(w.encode()) % lm.HASHED for w in words)
    key = lambda r: (r.doc_id, r.n_tokens)
    plain, whole = (sorted(x.collect(), key=key) for x in (lm.score(df, vocab, net), lm.score_all(df, vocab, net)))
    assert [key(r) for r in plain] == [key(r) for r in whole] and len(whole) == len(texts)
    for a, b in zip(plain, whole, strict=True):
        want = a.log_likelihood + sum(np.log(n[w] / entry[lm.zlib.crc32(w.encode()) % lm.HASHED]) for w in (texts[a.doc_id] or "").split() if w[0] == "r")
        assert abs(b.log_likelihood - want) < 1e-6 * max(1, abs(want)) and (b.mean_log_likelihood is None) == (a.n_tokens == 0)
    assert lm.score_all(df.limit(0), vocab, net).count() == 0


def test_probabilities_and_gradients_against_plain_formulas(monkeypatch):
    for name, value in {"PER_CLASS": 4, "CLASSES": 3, "SIZE": 12, "PAD": 12, "DIM": 3, "HIDDEN": 5}.items():
        monkeypatch.setattr(lm, name, value)
    rng = np.random.default_rng(0)
    net = lm.Network.start(np.arange(12))
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    tokens, ctx = rng.integers(0, 12, 40), rng.integers(0, 13, (40, 4))

    def plain(p):
        out = []
        for t, c in zip(tokens, ctx, strict=True):
            h = np.tanh(np.concatenate([p["emb"][i] for i in c]) @ p["w1"] + p["b1"])
            k, w = divmod(int(t), 4)
            first, second = h @ p["wc"] + p["bc"], h @ p["ww"][k] + p["bw"][k]
            out.append(first[k] - np.log(np.exp(first).sum()) + second[w] - np.log(np.exp(second).sum()))
        return np.array(out)

    assert np.allclose(net.log_probs(tokens, ctx), plain(net.p), atol=1e-5)
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(tokens, ctx, {k: np.full_like(v, 1e24) for k, v in net.p.items()}, rate=1e12)  # the update is the gradient
    for k, v in before.items():
        for i in rng.choice(v.size, min(v.size, 12), replace=False):
            sides = []
            for e in (1e-5, -1e-5):
                moved = {**before, k: v.copy()}
                moved[k].flat[i] += e
                sides.append(-plain(moved).mean())
            assert abs((sides[0] - sides[1]) / 2e-5 - (v.flat[i] - net.p[k].flat[i])) < 1e-4, k


def test_one_word_rule_and_odd_columns(spark):
    texts = ["हिन्दी भाषा हिन्दी", "naïve café ΣΑΣ", "a_b 1 2", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    counts = {r.word: r.n for r in lm.word_counts(df).collect()}
    vocab, _ = lm.train(df)
    assert set(counts) == set(vocab.ids) and all(vocab(t).max(initial=0) < lm.VOCAB for t in texts)
    long = np.arange(50_000)
    assert [len(r) for r in lm.runs_of(long)] == [lm.RUN] * lm.RUNS and lm.runs_of(long)[-1][0] == 47_500
    counts = spark.createDataFrame([(f"w{i:03}", 1 + i % 7) for i in range(100)], "word string, n long")
    want = sorted(((f"w{i:03}", 1 + i % 7) for i in range(100)), key=lambda r: (-r[1], r[0]))
    assert [tuple(r) for r in lm.most_frequent(counts, 30)] == want[:30] and len(lm.most_frequent(counts, 500)) == 100


def test_blocks_give_the_entries_of_whole_texts(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, ""), (-7, None), (-8, "!")], "doc_id long, text string")).repartition(3)
    monkeypatch.setattr(lm, "HELD", 300)
    monkeypatch.setattr(lm, "SENT", 1000)
    corpus = lm.encode(df)
    texts = {r.doc_id: r.text for r in df.collect()}
    words = [w for t in texts.values() for w in lm.words_of(t)]
    n = Counter(words)
    assert {r.word: r.n for r in corpus.vocab.counts.collect()} == n and corpus.counts.sum() == len(words)
    inside = Counter(lm.zlib.crc32(w.encode()) % lm.HASHED for w in words if w not in corpus.vocab.ids)
    rows = corpus.rows.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.array_equal(np.frombuffer(r.tokens, np.uint16), corpus.vocab(texts[r.doc_id]))
        want = sum(np.log(n[w] / inside[lm.zlib.crc32(w.encode()) % lm.HASHED]) for w in lm.words_of(texts[r.doc_id]) if w not in corpus.vocab.ids)
        assert abs(r.within - want) < 1e-6 * max(1, abs(want))


def test_words_by_either_rule_and_without_a_pattern_for_latin():
    marks = "".join(map(chr, range(256)))
    texts = [marks, *(f"a{c}B_9{c}" for c in marks), "Ünder_2 naïve²\xa0\x85½ µ ß ÿ", "", None, "İstanbul ΣΑΣ ſ Ÿ", "中文 a\u2028b", "\ud800x y"]
    assert [lm.words_of(t) for t in texts] == [lm._WORD.findall((t or "").lower()) for t in texts]
    kept, lm._WORD = lm._WORD, None  # what Latin-1 texts no longer pass through
    try:
        assert lm.words_of("Été, one_2 l'été") == ["été", "one_2", "l", "été"]
    finally:
        lm._WORD = kept
