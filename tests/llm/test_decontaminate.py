import random

import numpy as np

from pressgauge.llm import decontaminate as D


def sellers(item, text):
    """Smallest edit distance of item to any region of text."""
    a, b = D.codes(item), D.codes(text)
    row = np.zeros(len(b) + 1, int)
    for i, c in enumerate(a):
        new = [i + 1]
        for j, x in enumerate(b):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[-1] + 1))
        row = np.array(new)
    return int(row.min())


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s)), rng.randrange(3)
        if kind == 0:
            s[i] = rng.choice("xyzq")
        elif kind == 1:
            s.insert(i, rng.choice("xyzq"))
        else:
            del s[i]
    return "".join(s)


def cases(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "er", "on", "é", "st"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(3, 30))) for i in range(12)] + [(100, "short"), (101, "Abc def"), (102, "")]
    docs = []
    for d in range(n):
        t = prose(rng.randint(0, 40))
        if d % 2:
            i, s = rng.choice(items[:12])
            t += " " + edited(rng, s, rng.randint(0, 4)) + " " + prose(5)
        docs.append((d, t))
    return items, [*docs, (n, None), (n + 1, ""), (n + 2, "xx SHORT yy abc\ndef"), (n + 3, items[0][1] * 3)]


def test_regions_equal_full_edit_distance(spark):
    items, docs = cases()
    got = D.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    have = {}
    for r in got:
        have[r.doc_id, r.item_id] = min(r.edits, have.get((r.doc_id, r.item_id), 99))
        text = dict(docs)[r.doc_id]
        assert sellers(dict(items)[r.item_id], text[r.start : r.end]) <= r.edits
    for d, t in docs:
        for i, s in items:
            if s and t:
                e = D.budget(len(s)) if len(s) >= D.Q else 0
                best = sellers(s, t)
                assert have.get((d, i)) == (best if best <= e else None), (d, i, best, e)
    assert sum(1 for r in got if r.doc_id == len(docs) - 1 and r.item_id == 0) == 3


def test_clean_keeps_columns_and_rows(spark):
    items, docs = cases()
    df = spark.createDataFrame([(d, t, d) for d, t in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {r.doc_id for r in D.contaminations(df, bench).collect()}
    left = D.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {d for d, _ in docs} - bad
    assert D.contaminations(df.limit(0), bench).count() == 0 and D.contaminations(df, bench.limit(0)).count() == 0


def test_large_benchmark_is_cut_into_blocks(spark, monkeypatch):
    items, docs = cases()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.contaminations(df, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_ITEMS", 5)
    assert sorted(map(tuple, D.contaminations(df, bench).collect())) == whole


def greedy(item, text):
    """Regions by full-width alignment: the best, then the best of each side of it, best of all sides first."""
    a, c, e = D.codes(text), D.codes(item), D.budget(len(item))
    free, out = [(0, len(a))], []
    while True:
        found = []
        for x, y in free:
            if y - x >= len(c) - e and (r := D.align(c, a[x:y], -len(c), y - x, e)):
                found.append((r[0], r[1] + x, r[2] + x, (x, y)))
        if not found:
            return sorted((s, t, e_) for e_, s, t in out)
        e_, s, t, seg = min(found)
        out.append((e_, s, t))
        free.remove(seg)
        free += [(seg[0], s), (t, seg[1])]


def test_periodic_texts_lose_no_region(spark, monkeypatch):
    rng = random.Random(4)
    count = lambda item, text: len(D.Items([(1, item)]).matches(text))
    assert [count("a" * 12, "a" * n) for n in (11, 12, 23, 24, 60)] == [0, 1, 1, 2, 5] and count("abc" * 5, "abc" * 15) == 3
    for trial in range(60):
        period = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 7)))
        item = (period * 40)[: rng.randint(12, 70)]
        text = edited(rng, (period * 200)[: rng.randint(20, 400)], rng.randint(0, 8)) + ("x" * 5 + item) * rng.randint(0, 2)
        want = greedy(item, text)
        assert [m[1:] for m in D.Items([(7, item)]).matches(text)] == want, (item, text)
        if trial < 10:
            monkeypatch.setattr(D, "HELD", 50)
            assert [m[1:] for m in D.Items([(7, item)]).matches(text)] == want
            monkeypatch.setattr(D, "HELD", 2_000_000)


def test_null_ids_case_and_long_texts(spark):
    item = "ＡＢＣ Ꭰ word that is long enough to be found"
    long = "filler words " * 20_000 + item.lower() + " tail"
    docs = spark.createDataFrame([(1, item.lower(), 5), (None, item, 6), (2, long, 7), (2, long, 7), (3, "clean", 8)], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(None, item, "x"), (None, item, "x"), (4, None, "y")], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, D.contaminations(docs, bench).collect()), key=str)
    at = len("filler words ") * 20_000
    assert got == sorted([(1, None, 0, len(item), 0)] * 2 + [(None, None, 0, len(item), 0)] * 2 + [(2, None, at, at + len(item), 0)] * 4, key=str)
    left = D.clean(docs, bench)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [3]
