import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from pressgauge.llm import minhash as M
from pressgauge.llm import shingles as S


def brute(docs, idf, threshold=0.8):
    """Classes by comparing all pairs: {doc_id: smallest id}."""
    vec = {i: M.vector(t or "", idf) for i, t in docs}
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (i, a), (j, b) in itertools.combinations(docs, 2):
        if len(vec[i][0]) and M.jaccard(vec[i], vec[j]) >= threshold:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i: root(i) for i, _ in docs}


def corpus(seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghé") for _ in range(5)) for _ in range(400)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs = []
    for _ in range(25):
        base = prose(rng.choice([8, 60, 200]))
        for _ in range(rng.randint(1, 5)):
            t = base[:]
            for _ in range(rng.randint(0, max(1, len(t) // 60))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append(" ".join(t))
    shared = prose(60)
    docs += [" ".join(shared + prose(60)) for _ in range(30)]
    docs += [docs[0]] * 20 + ["", None, "...", "one two", "One, two!", "x"]
    return list(enumerate(docs))


def test_classes_equal_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, node int, bands string")
    idf = M.idf_table(*M.frequencies(df))
    got = M.classes(df).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(docs, idf)
    sizes = {}
    for r in got:
        sizes[r.class_id] = sizes.get(r.class_id, 0) + 1
    assert all(r.class_size == sizes[r.class_id] for r in got)
    left = M.deduplicate(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(sizes)
    assert M.classes(df.limit(0)).count() == 0
    twice = df.unionByName(df).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert M.deduplicate(twice).count() == len(sizes) + 1


def test_stars_and_families_equal_all_pairs(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]

    def near(base, cuts):
        t = base[:]
        for j in rng.sample(range(3, len(t) - 3, 8), cuts):
            t[j] = rng.choice(vocab)
        return " ".join(t)

    hub, shared = ([rng.choice(vocab) for _ in range(n)] for n in (200, 170))
    docs = [near(hub, 3) for _ in range(1000)]
    docs.insert(500, " ".join(hub))
    for _ in range(150):  # alike by the passage, under the threshold but for a near copy
        t = shared + [rng.choice(vocab) for _ in range(30)]
        docs += [" ".join(t), near(t, 3)]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, M.idf_table(*M.frequencies(df)))
    assert len(set(want.values())) == 151 and {want[i] for i in range(1001)} == {0}
    assert {r.doc_id: r.class_id for r in M.classes(df).collect()} == want


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(0)
    s = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    wa, wb = rng.random(300).astype(np.float32) + 0.2, rng.random(300).astype(np.float32) + 0.2
    a, b = M.signatures(1, np.zeros(300, int), s, wa, 3000), M.signatures(1, np.zeros(300, int), s, wb, 3000)
    want = M.jaccard((s, wa), (s, wb))
    assert abs((a == b).mean() - want) < 0.03


def test_words_of_all_scripts(spark):
    split = lambda t: len(S.words([t])[1])
    same = lambda a, b: np.array_equal(S.words([a])[1], S.words([b])[1])
    assert [split(t) for t in ("a b", "a\u00a0b", "“a”—b", "हिन्दी भाषा", "新聞x y", "ก ข", "", "…", "e\u0301a")] == [2, 2, 2, 2, 4, 2, 0, 0, 1]
    assert same("It’s “so” here", "it's \"so\"\u00a0here") and not same("ab", "ba") and not same("新聞", "聞新")
    rng = random.Random(1)
    long = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(3000))
    prose = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(4000))
    texts = [long, long[:1500] + "新" + long[1501:], long[::-1], prose, prose.replace(" ", "\u00a0"), prose[::-1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.class_id for r in sorted(M.classes(df).collect())] == [0, 0, 2, 3, 3, 5]


def test_rows_that_share_an_id(spark):
    a, b = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven")
    df = spark.createDataFrame([(1, b), (5, a), (5, b), (5, a), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, M.deduplicate(df).collect()), key=str) == [(1, b), (5, a), (None, None)]


def test_a_crowded_bucket_of_unlike_texts_keeps_every_link(spark):
    """A bucket beyond FEW members, most of them unlike, with pairs that only all-pairs comparison finds."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    shared = [rng.choice(vocab) for _ in range(150)]
    docs = []
    for _ in range(120):
        own = [rng.choice(vocab) for _ in range(80)]
        docs += [" ".join(shared + own), " ".join(shared + own[:-1] + [rng.choice(vocab)])]
    docs = list(enumerate(docs))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, M.idf_table(*M.frequencies(df)))
    got = {r.doc_id: r.class_id for r in M.classes(df).collect()}
    assert len(set(want.values())) == 120 and got == want
