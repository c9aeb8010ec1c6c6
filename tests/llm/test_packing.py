import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pressgauge.llm import bpe, packing
from pressgauge.llm.common import lean

RANKS = P.path("byte_bpe_50k.tiktoken")
TOK = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
ENCODE = bpe.encoder(RANKS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é.,!?'s\n\t 1٣ \x1c\0😀")), max_size=30))
def test_ids_equal_the_tokenizer(text):
    assert ENCODE([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_pieces(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a  b \n c "), (-4, "w " * 5000), (-4, "w " * 5000)], "doc_id long, text string")
    docs = df.union(odd)
    rows = packing.pack(docs, lambda: bpe.encoder(RANKS)).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(np.array([*TOK.encode(r.text or "", add_special_tokens=False).ids, 0], np.uint32))
    seen, fill = {}, {}
    for r in rows:
        ids = want[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: sum(map(len, v)) for k, v in want.items()}
    pad = total = 0
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        total += at
        pad += 0 if at & (at - 1) == 0 else 1024 - at
    assert pad / total < 0.01
    assert packing.pack(docs.limit(0), lambda: bpe.encoder(RANKS)).count() == 0


def test_level_rule_is_the_smallest_sum_of_squares():
    rng, size = np.random.default_rng(1), 16
    lv, cuts = packing.Levels(size), 0

    def after(h, s):
        n = lv.count.copy()
        if h:
            n[h] -= 1
        for level in (h + s,) if h + s < size else (h + s - size,):
            n[level] += level > 0
        return int((n[1:size] ** 2).sum())

    for s in rng.integers(1, size, 2000):
        s = int(s)
        while s:
            levels = [0, *np.flatnonzero(lv.count).tolist()]
            best = {(h, h + s > size): after(h, s) + packing.CUT * (h + s > size) for h in levels}
            h, cut = lv.place(s)
            least = min(best.values())
            assert best[h, cut] == least and not (cut and least in [v for k, v in best.items() if not k[1]])
            lv.move(h, size - h if cut else s)
            s = s - (size - h) if cut else 0
            cuts += cut
    assert 0 < cuts < 600


def test_the_rule_places_nearly_everything():
    """Eight tasks over sf0.1: documents are mostly placed whole, and the last stage joins few ids by cutting."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()]
    docs = [np.append(x, np.uint32(0)) for at in range(0, len(texts), 64) for x in ENCODE(texts[at : at + 64])]
    first, last = [packing.Packer(i << 36) for i in range(8)], packing.Packer(9 << 36)
    rows = [r for i, d in enumerate(docs) for r in first[i % 8].add(i, d)]
    alone = sum(len(p[2]) for packer in first for w in packer.windows() for p in w)
    for packer in first:
        for w in packer.windows():
            rows += last.put(list(w), sum(len(p[2]) for p in w))
    joined = last.close()
    total = sum(map(len, docs))
    assert sum(r[2] for r in rows + joined) == total
    whole = {}
    for r in rows:
        whole[r[0]] = whole.get(r[0], 0) + 1
    cut = sum(n > 1 for d, n in whole.items() if len(docs[d]) < 1024) / sum(len(d) < 1024 for d in docs)
    print("open at the ends of tasks", alone / total, "joined by cutting", sum(r[2] for r in joined) / total, "short documents cut", cut)
    assert sum(r[2] for r in joined) / total < 0.03 and cut < 0.25


def test_odd_columns_and_one_row(spark):
    df = spark.createDataFrame([(1, "a b", 2, b"x")], "doc_id long, text string, part int, ids binary")
    assert [(r.doc_id, r.start, r.length, r.offset) for r in packing.pack(df, lambda: bpe.encoder(RANKS)).collect()] == [(1, 0, 2, 0), (1, 2, 1, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(1, 5))
def test_every_id_lies_in_one_window(sizes, stages):
    docs = [np.arange(n, dtype=np.uint32) for n in sizes]
    packers, rows = [packing.Packer(i << 36, 16) for i in range(stages)], []
    for i, d in enumerate(docs):
        rows += packers[i % stages].add(i, d)
    last = packing.Packer(9 << 36, 16)
    for p in packers:
        for w in p.windows():
            rows += last.put(list(w), sum(len(x[2]) for x in w))
    rows += last.close()
    where = sorted((r[0], r[1], r[2]) for r in rows)
    assert [x for d, a, n in where for x in ((d, a + k) for k in range(n))] == [(d, k) for d, n in enumerate(sizes) for k in range(n)]
    assert all(r[3] == zlib.crc32(docs[r[0]][r[1] : r[1] + r[2]].tobytes()) for r in rows)


def test_workers_hold_few_rows_at_a_time(spark):
    """20,000 rows of 8 kB in one task: 160 MB, which a worker never has in memory together."""
    docs = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 4000).alias("text"))

    def encoder():
        def resident():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * 4096

        import pandas  # noqa: F401  (Arrow imports it at its first array)

        before = resident()

        def encode(texts):
            assert resident() - before < 40_000_000
            return [np.full(len(t) // 2, 7, np.uint32) for t in texts]

        return encode

    rows = packing.pack(docs, encoder)
    assert rows.agg(F.sum("length")).first()[0] == 20_000 * 4001 and rows.select("doc_id").distinct().count() == 20_000


def test_lean_runs_over_slices_of_the_same_rows():
    batches = [pa.record_batch({"x": pa.array(range(n))}) for n in (0, 3, 500, 1234)]
    got = list(lean(lambda bs: ([b.num_rows, b.column(0).to_pylist()] for b in bs))(iter(batches)))
    assert [n for n, _ in got] == [3, 500, 500, 500, 234] and [x for _, v in got for x in v] == [x for b in batches for x in b.column(0).to_pylist()]
