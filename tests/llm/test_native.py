"""Personal data, fingerprints and mixing: small cases and brute force."""

import hashlib
import random
import re
import time

import pytest

from basinflow.llm import mixing, pii, winnowing

ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "word " * 3000), (None, "no id")]


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{more}")


def base_spans(text):
    """The contract's base kinds, by Python's re."""

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found))


TEXTS = [
    "mail x@y.zz%w@q.com or é +1 (555) 123-4567, 300.1.1.1 and 1.2.3.4.5.6.7.8",
    "4111 1111-1111 1111; 4111111111111112 10.0.0.010 +12 3",
    "a@b a@b.c.d.e@f.g @@ a.@b.c 0000.1.2.3 256.1.1.1",
    None,
    "",
    "日本 user.name+tag@example-1.co.uk, ip 1.1.1.1",
]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = pii.digest(pii.find(frame(spark, list(enumerate(TEXTS))))).collect()
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base_spans(TEXTS[r.doc_id]).encode()).hexdigest()


def test_added_kinds_and_redaction(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32, password=b7db7aa4a5fcc78305x b7db7aa4a5fcc78305 x@y.zz"
    d = frame(spark, [(1, text, "k", 5)], ", source string, n_chars long")
    assert "iban:5:32" in pii.digest(pii.find(d)).first().spans
    out = pii.redact(d).first()
    assert "[IBAN]" in out.text and "[EMAIL]" in out.text and out.n_chars == len(out.text)


def test_an_iban_ends_where_it_passes(spark):
    d = frame(spark, [(1, "bank DE89 3704 0044 0532 0130 00 EUR 500 and DE88 3704 0044 0532 0130 00")])
    assert pii.digest(pii.find(d)).first().spans == "iban:5:32"


def test_spans_and_redaction_of_random_texts(spark):
    draw = random.Random(6)
    parts = ["a@b.cd", "x.y@", "@c.de ", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "12 ", "7", "-", " ", "+1 (555) 123-4567", "+", "é", "🎉", ".", "\n", "word "]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([5, 30, 400, 3000]))) for _ in range(120)]
    for r in pii.digest(pii.find(frame(spark, list(enumerate(texts))))).collect():
        assert r.base_sha256 == hashlib.sha256(base_spans(texts[r.doc_id]).encode()).hexdigest()
    names = [f"[{k.upper()}]" for k in pii.KINDS]
    found = {r.doc_id: r.pii for r in pii.find(frame(spark, list(enumerate(texts)))).collect()}
    for r in pii.redact(frame(spark, list(enumerate(texts)))).collect():
        out, at, text = [], 0, texts[r.doc_id]
        for s in found[r.doc_id]:
            if s.start >= at:
                out += [text[at : s.start], names[s.kind]]
            at = max(at, s.end)
        assert r.text == "".join(out) + text[at:]


def test_many_matches_take_linear_time(spark):
    texts = ["12 a " * 200_000, "a@b.cd " * 100_000, "1.2.3.4 " * 100_000, "4111 1111 1111 1111 a " * 50_000]
    began = time.time()
    d = frame(spark, list(enumerate(texts))).repartition(4)
    rows = {r.doc_id: r for r in pii.digest(pii.find(d)).collect()}
    assert [rows[1].n_email, rows[2].n_ip, rows[3].n_card] == [100_000, 100_000, 50_000]
    assert sorted(r.text.count("[") for r in pii.redact(d).collect()) == [0, 50_000, 100_000, 100_000]
    assert time.time() - began < 120


def test_long_runs_take_linear_time(spark):
    rows = [(1, "a" * 200_000), (2, "1" * 200_000), (3, "a@b" + ".c" * 50_000)]
    assert pii.digest(pii.find(frame(spark, rows))).agg({"n_email": "sum"}).first()[0] == 1


@pytest.mark.parametrize("run", [lambda d: pii.digest(pii.find(d)), winnowing.compare, lambda d: mixing.mix(d.selectExpr("*", "'s' as source"))])
def test_odd_rows_and_empty_tables(spark, run):
    d = frame(spark, ODD).selectExpr("*", "1 as bucket", "2 as late", "3 as fp", "4 as shard", "5 as size", "6 as skey")
    assert run(d).count() == len(ODD)
    assert run(d.limit(0)).count() == 0


def brute_fingerprint(hashes, k, window):
    """Places of the rightmost least gram of every window."""
    chosen = []
    for i in range(max(len(hashes) - window + 1, 1)):
        part = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if at not in chosen:
            chosen.append(at)
    return chosen


def test_winnowing_takes_the_rightmost_least_of_every_window(spark):
    from pyspark.sql import functions as F

    text = " ".join("a b c a b c d e a b c a b c f g h a a a a a a a a a a".split())
    d = spark.createDataFrame([(text,)], "text string")
    one = d.select(winnowing.fingerprint(F.col("text"), 3, 1).alias("f"), winnowing.fingerprint(F.col("text"), 3, 4).alias("g")).first()
    hashes = [x >> winnowing.PLACE for x in one.f]
    place = lambda x: winnowing._MASK - (x & winnowing._MASK)
    assert [place(x) for x in one.f] == list(range(len(hashes)))
    assert sorted(map(place, one.g)) == sorted(brute_fingerprint(hashes, 3, 4))


def test_next_document_and_edit(spark):
    rows = [(i * 7 % 1000, f"text {i} " * (i % 9 + 1)) for i in range(1000)]
    got = {r.doc_id: r for r in winnowing.compare(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(text) // 2
        assert got[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()


def test_mix_meets_its_targets(spark):
    rows = [(i, "w " * (i % 40 + 1), None if i % 7 == 0 else f"s{i % 3}") for i in range(3000)]
    found = mixing.mix(frame(spark, rows, ", source string")).toPandas()
    assert (found.taken <= 2 * found["size"]).all()
    by = found.groupby(found.source.fillna("~")).agg({"target": "max", "taken": "sum", "source_size": "max"})
    assert by.target.sum() == pytest.approx(1.5 * found["size"].sum())
    assert ((by.taken - by.target).abs() < 0.03 * by.target + 200).all()
    again = mixing.mix(frame(spark, rows[::-1], ", source string")).toPandas()
    assert dict(zip(found.doc_id, found.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_likenesses_are_those_of_the_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = winnowing.compare(docs).orderBy("doc_id", ascending=False).collect()
    hashes = lambda fp: {x.split(":")[1] for x in fp.split(",") if x}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, following = texts[r.doc_id], texts[after.doc_id]
        half = len(text) // 2
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(hashes(r.fingerprint), hashes(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(like(hashes(r.fingerprint), hashes(after.fingerprint)))
