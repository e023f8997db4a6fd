import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from basinflow.llm import mixing, pii, quality
from basinflow.llm.catalog import tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3]
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_sources_emit_the_words_of_their_targets(spark):
    draw = random.Random(5)
    sources = ["s00", "s01", "s02"] * 2 + [f"s{i:02}" for i in range(3, 20)] + ["s02"] * 8 + [None]
    rows = [(None if i % 50 == 0 else i, "w " * (1 + int(draw.lognormvariate(4.5, 0.8))) + str(i), draw.choice(sources)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert out.columns == docs.columns
    emitted = {r.source: r.n for r in out.selectExpr("source", "size(split(text, ' ')) as n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    print({s: (round(t), emitted.get(s, 0)) for s, t in targets.items()})
    for source, target in targets.items():
        assert emitted.get(source, 0) == pytest.approx(target, rel=0.04, abs=500), source
    assert out.groupBy("text").count().agg({"count": "max"}).first()[0] == 2


def test_emitted_words_of_the_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    targets = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    out = corpus_pipeline.mixing_stage(spark, docs, SF).selectExpr("source", r"size(regexp_extract_all(text, '[^ \\t-\\r]+', 0)) as n")
    emitted = {r.source: r.n for r in out.groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    longest = {r.source: r.n for r in out.groupBy("source").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()}
    for source, target in targets.items():
        # Of 50 documents a source, one may be longer than a hundredth of the words.
        assert abs(emitted.get(source, 0) - target) <= 0.03 * target + longest.get(source, 0), source
    total = sum(targets.values())
    assert sum(emitted.values()) == pytest.approx(total, rel=0.03)


def test_near_duplicates_of_null_ids_stay(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, 1), (2, text + " x", 1), (2, text + " x", 1), (None, text, 1), (None, text, 1), (4, None, 1), (5, "", 1)], "doc_id long, text string, n int")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 1, 4, 5]


def discriminant(x, y):
    """Scores of all rows of x by a quadratic discriminant of the labelled ones: plain inverses and determinants."""
    known = {i: y[i] for i in y}
    rows = [np.array([x[i] for i in known if known[i] == c]) for c in (0, 1)]
    every = np.concatenate(rows)
    centre, scale = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-6))
    rows = [(r - centre) / scale for r in rows]
    scatter = [np.cov(r.T, bias=True) for r in rows]
    common = sum(len(r) * s for r, s in zip(rows, scatter, strict=True)) / len(every)
    logs = []
    for c in (0, 1):
        s = 0.95 * scatter[c] + 0.05 * common
        s = 0.999 * s + 0.001 * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
        z = np.clip((np.array(list(x.values())) - centre) / scale, -12, 12) - rows[c].mean(axis=0)
        logs.append(np.log((len(rows[c]) + 1) / (len(every) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    return dict(zip(x, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60))), strict=True))


def redacted(text):
    """The text with all kinds replaced, by Python's re."""
    if text is None:
        return None
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def mod97(m):
        turned = m[4:] + m[:4]
        return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1

    spans = []
    checks = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for k, (_, pattern, ok) in enumerate(checks):
        spans += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    last = 0
    for m in re.finditer(pii.PATTERNS["iban"], text):
        ends = [i for i in range(len(m[0]), 14, -1) if i == len(m[0]) or m[0][i] == " "]
        good = [i for i in ends if len(m[0][:i].replace(" ", "")) >= 15 and mod97(m[0][:i].replace(" ", ""))]
        spans += [(m.start(), 4, m.start() + good[0])] * bool(good)
    for m in re.finditer(pii.PATTERNS["secret"], text):
        near = (text[last : m.start()][-pii.NEAR :] + m[0]).lower()
        if re.search("[0-9]", m[0]) and re.search(pii.CONTEXT["secret"], near):
            spans.append((m.start(), 5, m.end()))
        last = m.end()
    out, at = [], 0
    for start, k, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def near_duplicates(texts):
    """Ids to drop: all but the least of each group that five-word shingles link at 0.8."""
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().encode().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set())
    home = {i: i for i in sets}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                home[b] = a
    return {i for i in ids if root(i) != i}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # More near copies than the small table has.
    more = docs.filter("doc_id % 5 = 0").selectExpr("doc_id + 100000 as doc_id", "concat(text, ' and more') as text", "lang", "source", "n_chars")
    docs = docs.unionByName(more)
    rows = {r.doc_id: r for r in docs.collect()}
    names = [f for _, f in corpus_pipeline.STAGES]

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in rows}
    known = {i: q for i, q in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1 and q in (0, 1)}
    scores = discriminant({i: quality.statistics(r.text or "") for i, r in rows.items()}, known)
    got = {r.doc_id: r.score for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert got == pytest.approx(scores, abs=1e-6)
    kept = names[0](spark, docs, SF).cache()
    want = {i for i, s in scores.items() if s >= 0.5}
    assert {r.doc_id for r in kept.collect()} == want

    unique = names[1](spark, kept, SF).cache()
    want -= near_duplicates({i: rows[i].text for i in want})
    assert sorted(r.doc_id for r in unique.collect()) == sorted(want)

    clean = names[2](spark, unique, SF).cache()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts == {i: redacted(rows[i].text) for i in want}

    mixed = names[3](spark, clean, SF).cache()
    taken = Counter(r.doc_id for r in mixed.collect())
    mix = {r.doc_id: r for r in mixing.mix(clean).collect()}
    assert set(taken) <= set(texts) and max(taken.values()) <= 2
    assert all(abs(taken[i] * r.size - r.taken) < max(r.size, 1) for i, r in mix.items())

    ranks, pattern = tokenizer()
    library = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coded = names[4](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in coded) == taken
    for r in coded:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
