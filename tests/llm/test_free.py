"""The operators in other styles: brute force, round trips and held-out accuracy."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

from basinflow.llm import bpe, catalog, html_text, jaccard_join, ngram_lm, packing, quality, topk
from basinflow.llm.catalog import tokenizer

ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "word " * 3000), (5, "x" * 100_000), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def vocabulary():
    ranks, pattern = tokenizer()
    return ranks, pattern, tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


RUNS = {
    "lm": lambda d, v: ngram_lm.score(d),
    "lm2": lambda d, v: ngram_lm.score(d, order=2),
    "join": lambda d, v: jaccard_join.join(d),
    "quality": lambda d, v: quality.score(d, d.selectExpr("doc_id", "1 as quality")),
    "bpe": lambda d, v: bpe.encode(d, v[0], v[1]),
}


@pytest.mark.parametrize("name", list(RUNS))
def test_odd_rows_and_empty_tables(spark, vocabulary, name):
    d = frame(spark, ODD).selectExpr("*", "1 as block", "2 as n", "3 as h", "4 as digest", "5 as x")
    assert RUNS[name](d, vocabulary).count() == len(ODD)
    assert RUNS[name](d.limit(0), vocabulary).count() == 0


def test_encoding_is_that_of_the_library(vocabulary):
    ranks, pattern, want = vocabulary
    encoder, draw = bpe.Encoder(bpe.Vocabulary(ranks), pattern), random.Random(1)
    parts = ["a", "b", "  ", "\n", " ", "é", "日本", "1", "'s", "!!", "\t", "　", "th", "ing", "🎉", "\x1c", "tion"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))
        ids = encoder.encode(text)
        assert ids == want.encode_ordinary(text) and encoder.decode(ids) == text.encode()
        a = draw.randint(0, len(text))
        b, new = draw.randint(a, len(text)), "".join(draw.choice(parts) for _ in range(draw.randint(0, 5)))
        doc = bpe.Document(encoder, text)
        doc.replace(a, b, new)
        assert doc.ids() == want.encode_ordinary(text[:a] + new + text[b:])
        doc.append("s x")
        assert doc.ids() == want.encode_ordinary(text[:a] + new + text[b:] + "s x")
        piece, data = bpe.Piece(encoder.vocabulary, text.encode()), text.encode()
        piece.replace(min(a, len(data)), min(b, len(data)), new.encode())
        assert piece.last == bpe.Piece(encoder.vocabulary, data[: min(a, len(data))] + new.encode() + data[min(b, len(data)) :]).last


def components(texts, k, percent):
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    home = list(range(len(sets)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                home[b] = a
    return [root(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize(("k", "percent", "cell"), [(2, 85, 4096), (1, 50, 4)])
def test_join_is_that_of_all_pairs(spark, k, percent, cell):
    draw = random.Random(k)
    texts = []
    for _ in range(30):
        words = [draw.choice("abcdefghij") + draw.choice("xyz") for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(1, 6)):
            copy = list(words)
            for _ in range(draw.randint(0, 4)):
                if copy:
                    copy[draw.randrange(len(copy))] = draw.choice("klmn")
            texts.append(" ".join(copy))
    low, sizes = components(texts, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(frame(spark, list(enumerate(texts))), k, percent, cell_docs=cell, block_chars=4000).collect()}
    assert got == {i: (n, c) for i, (c, n) in enumerate(zip(low, sizes, strict=True))}


def test_prefixes_of_linked_sets_meet():
    draw = random.Random(12)
    for _ in range(20_000):
        percent = draw.choice([50, 80, 85, 99, 100])
        members = draw.sample(range(1000), draw.randint(2, 40))
        cut = draw.randint(1, len(members))
        extra = draw.randint(0, 4)
        x, y = set(members[:cut]), set(members[draw.randint(0, 2) :][: cut + extra])
        if len(x) > len(y):
            x, y = y, x
        if not y or 100 * len(x & y) < percent * len(x | y):
            continue
        order = lambda m: (m * 7919 % 1009, m)
        smaller, larger = jaccard_join.prefixes(len(x), percent)[0], jaccard_join.prefixes(len(y), percent)[1]
        assert set(sorted(x, key=order)[:smaller]) & set(sorted(y, key=order)[:larger])


def test_a_null_id_does_not_speak_for_its_twin(spark):
    words = [f"w{i}" for i in range(100)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    d = frame(spark, [(None, text), (5, text), (9, near), (None, text)]).coalesce(1)
    got = jaccard_join.join(d, 4, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 5), (0, 5), (5, 5), (9, 5)]


def test_divide_skip_counts_occurrences():
    from array import array

    draw = random.Random(3)
    for n in (8, 400):
        lists = [array("i", sorted(draw.sample(range(n), draw.randint(1, n)))) for _ in range(20)]
        count = Counter(x for values in lists for x in values)
        for least in (1, 5, 12, 20):
            assert sorted(jaccard_join.t_occurrences(lists, least)) == sorted(x for x, c in count.items() if c >= least)


def test_scores_against_plain_counting(spark):
    texts = ["a b a b c", "a b d", "c c c", "", "a b a b c"]
    got = {r.doc_id: r for r in ngram_lm.score(frame(spark, list(enumerate(texts))), order=3).collect()}
    docs = [t.split() for t in texts]
    grams = [Counter(tuple(d[i : i + m]) for d in docs for i in range(len(d) - m + 1)) for m in (1, 2, 3)]
    every = sum(map(len, docs))
    for i, d in enumerate(docs):
        own = [Counter(tuple(d[j : j + m]) for j in range(len(d) - m + 1)) for m in (1, 2, 3)]
        left = lambda g, own=own: grams[len(g) - 1][g] - own[len(g) - 1][g]
        total = 0.0
        for j in range(len(d)):
            factor = 1.0
            for m in range(min(3, j + 1), 0, -1):
                g = tuple(d[j - m + 1 : j + 1])
                if left(g) > 0:
                    total += np.log(factor * left(g) / (left(g[:-1]) if m > 1 else every - len(d)))
                    break
                factor *= 0.4
            else:
                total += np.log(factor / (every - len(d) + 1))
        assert got[i].log_score == pytest.approx(total) and got[i].n_words == len(d)


def test_registered_scores_equal_sql(spark):
    import duckdb

    sf, name = "/root/testdata/sf0.001", "op1_lm_score"
    got = catalog.queries()[name](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = duck.sql(catalog.oracle_sql()[name]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.n_words.tolist() == want.n_words.tolist()
    assert np.allclose(got.log_score, want.log_score, rtol=0, atol=2e-5)
    assert np.allclose(got.mean_log_score, want.mean_log_score, rtol=0, atol=2e-7)


def test_small_blocks_score_alike(spark):
    texts = [" ".join("ab c d e".split()[(i * j * 7 + j) % 4] for j in range(i % 40)) for i in range(200)]
    d = frame(spark, list(enumerate(texts)))
    one, many = ({r.doc_id: r.log_score for r in ngram_lm.score(d, order=3, block_chars=n).collect()} for n in (1 << 20, 500))
    assert one == pytest.approx(many)


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(300)]
    rows += [(900, None), (901, [float("nan")] * 5), (902, [None] * 5), (903, []), (904, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in topk.search(d, d["vec_id"] % 20 == 0, k=7, block_rows=64, block_queries=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: np.floor(64 * np.array((v + [0.0] * 5)[:5])) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in good if i % 20 == 0):
        want = sorted(((i, int(good[q] @ v)) for i, v in good.items() if i != q), key=lambda x: (-x[1], x[0]))[:7]
        assert got[q] == want
    assert topk.search(d.limit(0), d["vec_id"] % 20 == 0).count() == 0


def test_repeated_vectors_and_clashing_columns(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [1.0, 3.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 1.0])]
    d = spark.createDataFrame([(*r, 1, 2, 3, "x", "y") for r in rows], "vec_id long, embedding array<double>, block int, part int, floor int, v string, score string")
    for size in (2, 100):
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(d, d["vec_id"] == 0, k=2, block_rows=size).orderBy("rank").collect()]
        assert got == [(0, 1, 1, 3 * 64 * 64), (0, 2, 1, 3 * 64 * 64)]


def test_packing_is_lossless(spark, vocabulary):
    ranks, pattern, want = vocabulary
    rows = [(i, "word and more " * (i * 37 % 90)) for i in range(80)] + [(100, None), (101, "x y " * 4000)]
    packed = packing.pack(frame(spark, rows), ranks, pattern, length=256).toPandas()
    parts = defaultdict(dict)
    for r, line in zip(packed.itertuples(), packing.matrix(packed.ids.tolist(), 256), strict=True):
        places = np.frombuffer(r.position_ids, "<u4")
        for d, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[d][start] = line[a:b]
            assert places[a:b].tolist() == list(range(b - a))
        assert (line[r.n_tokens :] == 50256).all()
    for d, text in rows:
        ids = want.encode_ordinary(text or "")
        assert [int(x) for s in sorted(parts[d]) for x in parts[d][s]] == ids
    assert packing.pack(frame(spark, rows).limit(0), ranks, pattern).count() == 0


def test_best_fit_takes_the_fullest_bin():
    draw = random.Random(4)
    for _ in range(30):
        sizes = [draw.randint(1, 40) for _ in range(60)]
        room, bins = [], []
        for i in sorted(range(60), key=lambda i: (-sizes[i], i)):
            fits = [r for r in room if r >= sizes[i]]
            if fits:
                b = room.index(min(fits))
                room[b] -= sizes[i]
            else:
                room.append(40 - sizes[i])
        bins = packing.best_fit(sizes, 40)
        assert sorted(i for b in bins for i in b) == list(range(60))
        assert sorted(40 - sum(sizes[i] for i in b) for b in bins) == sorted(room)


def test_main_text():
    page = '<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><div id="content"><h1>T</h1><div><p>One   <a href=x>li</a>nk&nbsp;a<br>b</p><p>Two</div><section><h2>S</h2><p>three &lt;b&gt;</section></div><div id="comments"><p>' + "bad " * 100 + "</div><aside>x</aside><form>f</form></body>"
    assert html_text.main_text(page) == "T One link a b Two S three <b>"
    assert html_text.main_text(None) == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<div>" * 5000 + "deep") == "deep"
    assert html_text.main_text("a < b & c") == "a < b & c"


def test_density_decides_where_nothing_is_marked():
    sentence = "The town lies on a river and was founded by monks in the ninth century. "
    notice = "<div>We use cookies to make this site better. By going on you accept them. <a href=x>Fine</a></div>"
    comments = "<div><p>Nice text!</p><p>I was there too, lovely place.</p><p>Me too</p></div>"
    story = [f"<h1>Headline</h1><p>{sentence * 3}</p><p>{sentence * 2}</p><p>{sentence * 4}</p>", f"<p>{sentence * 5}</p><p>{sentence * 2}</p>", f"{sentence * 6}<br><br>{sentence * 3}"]
    for inner in story:
        got = html_text.main_text(f"<html><body>{notice}<div>{inner}</div>{comments}</body></html>")
        want = " ".join(" ".join(x.split()) for x in re.split(r"<[^>]*>", inner) if x.strip())
        assert got == want
    # The same with links all over: the greatest sum is that of a list of links, but for their density.
    links = "<div>" + "".join(f"<p><a href=x>{sentence}</a></p>" for _ in range(30)) + "</div>"
    assert html_text.main_text(f"<body>{links}<div><p>{sentence * 5}</p><p>{sentence * 2}</p></div></body>") == (sentence * 7).strip()


def test_headlines_and_paragraphs_of_the_article_stay():
    page = '<article><header><h1>Title here</h1></header><p>Body</p><p class="legal">Legal history of the town.</p></article>'
    assert html_text.main_text(page) == "Title here Body Legal history of the town."


def test_densities_are_those_of_the_formula():
    draw, tags = random.Random(8), ["div", "p", "a", "b", "section", "ul"]

    def grown(depth):
        """Nested lists: a tag, then texts and trees."""
        return [draw.choice(tags), *[grown(depth - 1) if depth and draw.random() < 0.6 else "w" * draw.randint(1, 90) for _ in range(draw.randint(0, 4))]]

    def html(tree):
        return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(html, tree[1:]))}</{tree[0]}>"

    def counts(tree, linked=False):
        linked = linked or tree[0] == "a"
        total = [0, 0, 0, 0]
        for x in tree[1:]:
            if isinstance(x, str):
                more = [len(x), 0, len(x) * linked, 0]
            else:
                more = counts(x, linked)
                more[1] += 1
                more[3] += x[0] == "a"
            total = [a + b for a, b in zip(total, more, strict=True)]
        if tree[0] == "a":
            total[2] = total[0]
        return total

    def nodes(tree):
        yield tree
        for x in tree[1:]:
            if not isinstance(x, str):
                yield from nodes(x)

    for _ in range(200):
        # Paragraphs and links don't nest in pages, so trees that nest them are read as others.
        body = ["body", *[x for x in (grown(3) for _ in range(4)) if x[0] not in "pab"]]
        if any(x is not y and {x[0], y[0]} & {"p", "a", "b"} for x in nodes(body) if x[0] in "pab" for y in nodes(x)):
            continue
        root = html_text.parse(html(body))
        got = [n for n in html_text.measure(root) if n.tag != "#root"]
        want = [counts(x) for x in nodes(body)]
        assert sorted([n.chars, n.tags, n.links, n.link_tags] for n in got) == sorted(want)
        c, t, lc, lt = counts(body)
        for n in got:
            if n.chars:
                base = max(np.e, np.log(n.chars * n.links / max(n.chars - n.links, 1) + lc / max(c, 1) * n.chars + np.e))
                inner = n.chars / max(n.links, 1) * max(n.tags, 1) / max(n.link_tags, 1)
                assert n.density == pytest.approx(n.chars / max(n.tags, 1) * np.log(max(inner, 1)) / np.log(base))


def test_broken_pages_take_linear_time():
    began = time.time()
    for page in ("<div>" * 8000 + "</x>" * 100_000, "<b>" * 8000 + "<hr>" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<i>" + "<p><b>" * 20_000 + "</i>" * 40_000, '<a "' * 50_000, "<" * 200_000, "<table><tr><td>" * 30_000):
        html_text.main_text(page)
    assert time.time() - began < 60
    assert html_text.main_text("<div>x" * 50_000).count("x") == 50_000


def test_extract_odd_pages(spark):
    d = spark.createDataFrame([(1, "u", None, 1), (2, None, ""), (2, None, "")][:1] + [(2, None, "", 2), (2, None, "", 2)], "page_id long, url string, html string, text int")
    assert [r.text for r in html_text.extract(d).collect()] == ["", "", ""]
    assert html_text.extract(d.limit(0)).count() == 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.95
    assert scored.score.between(0, 1).all()


def test_groups_of_a_cell_are_those_of_all_pairs():
    draw = random.Random(3)
    for _ in range(60):
        bases = [draw.sample(range(60), 20) for _ in range(4)]
        sets = [set(draw.choice(bases)) | {draw.randrange(200) for _ in range(draw.randint(0, 3))} for _ in range(25)] + [set()]
        ids, percent = draw.sample(range(1000), len(sets)), draw.choice([60, 80, 85])
        want = list(ids)
        for _ in sets:  # minima spread along links
            for i, a in enumerate(sets):
                want[i] = min([want[i]] + [want[j] for j, b in enumerate(sets) if a & b and 100 * len(a & b) >= percent * len(a | b)])
        assert jaccard_join.linked_groups(ids, [np.array(sorted(x), np.uint64) for x in sets], percent) == want
    assert jaccard_join.linked_groups([], [], 80) == []


def test_frequent_keys_outlive_rare_ones():
    cache = bpe.Recent(20)
    cache.put("often", None)
    for i in range(1000):
        cache.put(i, i)
        assert cache.get("often", 0) is None
        assert len(cache.young) + len(cache.old) <= 20
    assert cache.get(0) is None and cache.get(999) == 999
