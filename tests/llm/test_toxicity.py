import numpy as np
from pyspark.sql import functions as F

from pressgauge.llm import toxicity as T


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = T.train(docs, labels)
    s = T.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").withColumn("out", T.held_out(F.col("doc_id"))).filter("out").collect()
    y, p = np.array([r.toxic for r in s]), np.array([r.score for r in s])
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    hit = p >= T.THRESHOLD
    print("auc", auc, "recall", hit[y == 1].mean(), "precision", y[hit].mean())
    assert auc > 0.96 and hit[y == 1].mean() > 0.9 and y[hit].mean() > 0.95


def test_misspellings_and_odd_rows(spark):
    bad = ["you are a stupid moron " + w for w in ("x", "y", "z")] * 20
    good = ["have a pleasant quiet morning " + w for w in ("x", "y", "z")] * 20
    m = T.fit(bad + good, np.array([1] * 60 + [0] * 60))
    df = spark.createDataFrame([(1, "stuupid morron", 0.5), (2, "pleasantly quietly", 0.5), (3, None, 0.1), (4, "", 0.1)], "doc_id long, text string, lang double")
    got = {r.doc_id: r.score for r in T.score(df, m).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] and 0 <= got[3] <= 1
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert T.score(df, T.train(df, labels)).filter("score >= 0.7").count() == 0
    assert T.score(df.limit(0), m).count() == 0


def test_long_runs_count_to_their_end(spark, monkeypatch):
    run = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(1000))
    w = f"<{run}>"
    grams = [w] + [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    assert list(T.subwords(run)) == [T.zlib.crc32(g.encode()) % T.BUCKETS for g in grams]
    bad, good = [run + "stupidmoron" * 20 + str(i) for i in range(60)], [run + "quietmorning" * 20 + str(i) for i in range(60)]
    y = np.array([1] * 60 + [0] * 60)
    m = T.fit(bad + good, y)
    df = spark.createDataFrame([(1, run[::-1] + "stupidmoron" * 20), (2, run[::-1] + "quietmorning" * 20)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in T.score(df, m).collect()}
    assert got[1] > 0.5 > got[2]
    monkeypatch.setattr(T, "HELD", 0)
    again = T.fit(bad + good, y)
    assert all(np.array_equal(a, b) for a, b in ((m.scores, again.scores), (m.bias, again.bias)))


def test_scores_against_plain_sums_and_odd_columns(spark):
    rng = np.random.default_rng(2)
    m = T.Model(rng.normal(0, 1, T.BUCKETS).astype(np.float32), -0.5)
    texts = ["Some plain words", "some plain words " * 3000, "x" * 400 + " y", "", None, "dup", "dup", "ÄÖ straße"]
    df = spark.createDataFrame([(i if i != 6 else 5, t, 7.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")

    def plain(t):
        means = []
        for w in T._WORD.findall((t or "").lower()):
            marked = f"<{w}>"
            grams = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
            means.append(np.mean([m.scores[T.zlib.crc32(g.encode()) % T.BUCKETS] for g in grams]))
        return 1 / (1 + np.exp(-(m.bias + (np.mean(means) if means else 0))))

    got = T.score(df, m).collect()
    assert T.score(df, m).columns == ["doc_id", "text", "score"] and len(got) == len(texts)
    assert all(abs(r.score - plain(r.text)) < 1e-5 for r in got)
    kept = T.score(df, m, out="__t")
    assert kept.columns == ["doc_id", "text", "score", "__t"] and {r.score for r in kept.collect()} == {7.0}


def test_every_ngram_has_a_vector_and_both_classes_count():
    bad, good = ["stupid moron " + c for c in "abcd"] * 20, ["pleasant morning " + c for c in "abcd"] * 20
    m = T.fit(bad + good, np.array([1] * 80 + [0] * 80))
    word = lambda w: m.scores[T.subwords(w)]
    assert (word("stupid") != 0).all() and word("stupid").mean() > 0 > word("pleasant").mean()


def test_words_hashed_together_equal_words_one_by_one(monkeypatch):
    """Scoring hashes a piece's new words in arrays, equal to the last bit; a word at a time took most of its time."""
    scores = np.random.default_rng(4).normal(0, 1, T.BUCKETS).astype(np.float32)
    odd = ["", "a", "ab", "é", "straße", "新聞", "😀x", "𐀀b", "e\u0301a", "x" * 64, "新" * 64, "aé新😀" * 16, "x" * 65, "12_3"]
    texts = [odd, [f"w{i}é"[: 2 + i % 4] + "ß" * (i % 9) for i in range(500)], [f"word{i}" for i in range(500)]]
    want = {w: float(scores[T.subwords(w)].mean()) for t in texts for w in t}
    monkeypatch.setattr(T, "ARRAY", 200)
    alone, one = [], T.subwords
    monkeypatch.setattr(T, "subwords", lambda w: alone.append(w) or one(w))
    known = T._Words(scores)
    known.learn(texts)
    assert {w: known[w] for w in want} == want and alone == ["x" * 65]
    monkeypatch.setattr(T, "CACHE", 100)
    known = T._Words(scores)
    for t in texts:
        known.learn([t])
        assert len(known) <= 100 and all(known[w] == want[w] for w in t)
