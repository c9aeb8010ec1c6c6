import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressgauge.llm import suffix as S


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(t):
    t = [*t, 0]
    assert S.gsaca(t) == sorted(range(len(t)), key=lambda i: t[i:])


def windows(bodies, at, w=200):
    held = [(i, k, b[k : k + w], (k - a) % S.SYMBOL) for i, (b, a) in enumerate(zip(bodies, at, strict=True)) for k in range(len(b) - w + 1)]
    n = Counter((x, r) for _, _, x, r in held)
    return [(i, k) for i, k, x, r in held if n[x, r] > 1]


def contexts_of(rng, letters):
    """Cuts of one text with the same place marked in each, some with bytes changed."""
    base, bodies, at = bytes(rng.choice(letters) for _ in range(600)), [], []
    for _ in range(8):
        n = rng.randint(200, 340)
        start = rng.randint(0, 300 - n // 2)
        b = bytearray(base[start : start + n])
        for _ in range(rng.choice([0, 0, 1, 2])):
            b[rng.randrange(n)] = ord("Q")
        bodies.append(bytes(b))
        at.append(300 - start)
    return bodies, np.array(at)


def test_windows_by_suffix_order(monkeypatch):
    rng = random.Random(4)
    cases = [contexts_of(rng, letters) for letters in (b"ab", b"abcdefgh ", b"x") for _ in range(20)]
    for bodies, at in cases:
        own, off = S.equal_windows(bodies, at)
        assert list(zip(own.tolist(), off.tolist(), strict=True)) == windows(bodies, at)
    assert not len(S.equal_windows([b"x" * 199], np.array([3]))[0])
    # The suffix order finds them: in the order of the text it misses most.
    monkeypatch.setattr(S, "gsaca", lambda t: [len(t) - 1, *range(len(t) - 1)])
    assert sum(len(S.equal_windows(*c)[0]) for c in cases) < sum(len(windows(*c)) for c in cases) / 2


def brute(docs, w=200):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[s : s + w] for _, b in raw for s in range(len(b) - w + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for s in range(len(b) - w + 1):
            if seen[b[s : s + w]] > 1:
                gone[s : s + w] = b"\1" * w
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, h int, k1 int")
    assert sorted(map(tuple, S.remove_repeats(df).collect())) == brute(docs)


def test_real_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text) for r in rows])


def test_crowded_anchor(spark, monkeypatch):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line, tails = noise(230), [noise(60) for _ in range(40)]
    docs = [noise(rng.randint(0, 120)) + line + rng.choice(tails) + noise(rng.randint(0, 120)) for _ in range(300)]
    monkeypatch.setattr(S, "CROWD", 20)
    check(spark, list(enumerate(docs + docs[:5])))


def test_planted_and_odd_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(50)
    docs = [prose(rng.randint(1, 120)) for _ in range(30)]
    for i in range(30):
        a = rng.randrange(0, 60)
        docs.append(prose(20) + passage[a : a + rng.randint(150, 280)] + prose(20))
    docs += ["x" * 500, "x" * 199, "x" * 200, "ab" * 300, None, "", docs[3] + docs[3], docs[4], docs[4], "é" * 150 + "z"]
    docs += [docs[5][:k] + "Q" + docs[5][k + 1 :] for k in (5, 150, 210, 333)]
    check(spark, list(enumerate(docs)) + [(7, docs[7])])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0
    short = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("n_bytes", F.lit(1))
    assert tuple(S.remove_repeats(short).first())[:4] == (1, 1, 0, 0)
