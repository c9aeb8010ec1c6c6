import hashlib
import re

from pyspark.sql import functions as F

from pressgauge.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (12 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


ODD = [
    None, "", "a@b.c_d@e.f x@y@z.com a@b..c @ .@-.- é@x.y 😀a@b.co", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 1.2.3 999999999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4 1 1 0000000000000", "+1 (555) 123-4567. +44 20 7946 0958 +12 +1+2 345 678 901 +1 .-.-.-.-",
    "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001 ssn 123-45-6789 or 123-45-6789",
    "7" * 30000, "a" * 30000, "a@" * 9000, "1." * 20000 + "@", "+1" + " 1" * 20000, " ".join("u%d@x.org" % i for i in range(900)),
]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1 - i, t) for i, t in enumerate(ODD)] + [(-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    s = pii.spans(df.withColumn("start", F.lit(1)).withColumn("spans", F.lit("x")))
    texts = dict(rows)
    got = s.select("doc_id", pii.joined("spans", pii.BASE).alias("b"), pii.joined("spans").alias("a")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.b == ",".join(base(texts[r.doc_id] or "")), r.doc_id
    extra, t = next(r.a for r in got if r.doc_id == -7), ODD[6]
    at = t.index("123-45")
    assert f"iban:5:32" in extra and f"ssn:{at}:{at + 11}" in extra and extra.count("iban") == 1


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or +44 20 7946 0958.", "en", 5), (2, None, "en", 0), (3, "clean", "en", 5)], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "mail [EMAIL] or [PHONE]." and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean" and pii.redact(df).columns == df.columns
    assert pii.spans(df.limit(0)).count() == 0


def test_native_plan(spark):
    plan = pii.spans(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_query_counts(spark):
    from pressgauge.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op3_pii(spark, d).collect():
        b = base(texts[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in b) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest()


def test_secrets_need_digits_letters_and_context(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'Esa token = "{key}" with', f"only {key} here", "password: " + "x" * 30, "api_key=" + "A1b2" * 6 + ".", "Bearer " + "Q9" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(df).select("doc_id", pii.joined("spans").alias("a"), pii.scores("spans").alias("s")).collect()}
    assert [got[i].a for i in range(5)] == ["secret:13:53", "", "", "secret:8:32", "secret:7:407"] and got[0].s == "0.60"
    assert pii.redact(df).filter("doc_id = 0").first().text == 'Esa token = "[SECRET]" with'
