"""Stupid-backoff scores of every document from n-gram counts of all documents."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import ANSWERED, ASKED, answer, answers_of, ask, block_count, bucket_count, packed_texts, starts_of, texts_of
from .common import make_room, small_batches
from .jaccard_join import mixed, word_hashes

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: The key under which the number of all words is counted.
_ALL = np.uint64(0x5851F42D4C957F2D)
#: How many words of a block are scored at once.
_WORDS_AT_ONCE = 1 << 18


def _keys(texts: Iterable[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the keys of the n-grams that end at each word, 0 where the document is too
    short before it; and where documents begin and end."""
    hashes = [word_hashes(t) for t in texts]
    ends = np.cumsum([0, *map(len, hashes)])
    h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    place = np.arange(len(h)) - np.repeat(ends[:-1], np.diff(ends))
    grams, joint = [], np.zeros(len(h), np.uint64)
    for m in range(1, order + 1):
        # The key of m words is that of the m-1 before the last, and the last.
        before = np.concatenate([np.zeros(1, np.uint64), joint[:-1]])[: len(h)] if m > 1 else joint
        joint = mixed(before * _STEP + h + np.uint64(m))
        joint[place < m - 1] = 0
        grams.append(joint)
    return grams, ends


def _table(grams: list[np.ndarray], buckets: int, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """The distinct keys in order, their counts, where each bucket, a range of keys, begins and ends,
    and if asked for where each gram and at last the number of words lie. Absent grams lie at 0, the
    key 0, which is there even if no gram is absent and isn't in any bucket."""
    words = len(grams[0])
    flat = np.concatenate([np.zeros(1, np.uint64), *grams, np.array([_ALL])])
    grams.clear()
    found = np.unique(flat, return_inverse=places, return_counts=True)
    keys, counts = found[0], found[-1]
    counts[np.searchsorted(keys, _ALL)] = words
    at = np.maximum(starts_of(keys, buckets), 1)
    return keys, counts, at, found[1][1:].astype(np.int32) if places else None


def score(docs: DataFrame, order: int = 3, alpha: float = 0.4, leave_out: bool = True, block_chars: int | None = None) -> DataFrame:
    """The sum of the logarithms of the stupid-backoff scores of a document's words.

    docs: doc_id, text; more columns are ignored. Words are runs of other than ASCII white space,
    A-Z in lower case. A word's score is count(n-gram) / count(the words before it) for the longest
    n-gram, of at most `order` words of the document, that was counted; each word it falls short
    costs the factor `alpha`. With leave_out a document's own n-grams are taken off the counts
    first, so a score tells how it reads to the rest of the corpus. A word that is not counted at
    all scores alpha / (all words + 1) with its factors.

    Documents lie in blocks of about block_chars characters (see block_count). Blocks send their distinct n-grams
    with counts to buckets by hash; a bucket's count table answers every block, which joins the
    answers to its exploded n-grams and sums by document. Texts are sent compressed; a bucket's keys
    as compressed differences, since they are sorted. A frequent n-gram costs one entry a
    block. Counts come from all documents and are exact but for collisions of 64-bit hashes.

    Returns doc_id, n_words, log_score and mean_log_score. Null texts and texts without words have
    0 words and scores of 0; repeated rows are documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = block_count(docs, block_chars)
    buckets = bucket_count(docs, blocks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = packed_texts(docs, blocks)

    def count(table: pa.Table) -> pa.Table:
        make_room("words")
        keys, counts, at, _ = _table(_keys(texts_of(table), order)[0], buckets)
        return ask(table.column("block")[0].as_py(), keys, counts, at)

    asked = rows.groupBy("block").applyInArrow(count, ASKED)
    answered = asked.groupBy("bucket").applyInArrow(answer, ANSWERED)

    def finish(_, texts: pa.Table, answers: pa.Table) -> pa.Table:
        make_room("words")
        grams, ends = _keys(texts_of(texts), order)
        _, inside, at, where = _table(grams, buckets, places=True)
        sums = answers_of(((b, s.as_py()) for b, s in zip(answers.column("bucket").to_pylist(), answers.column("sums"), strict=True)), at)
        every, inside[0] = sums[where[-1]], 1
        place = where[:-1].reshape(order, -1)
        n = np.diff(ends)
        logs, first = np.zeros(len(n)), 0
        while first < len(n):
            last = max(int(np.searchsorted(ends, ends[first] + _WORDS_AT_ONCE, side="right")) - 1, first + 1)
            logs[first:last] = _documents(place[:, ends[first] : ends[last]], n[first:last], sums, inside, every, alpha, leave_out)
            first = last
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_score": pa.array(logs), "mean_log_score": pa.array(logs / np.maximum(n, 1))})

    return rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")


def _documents(place: np.ndarray, n: np.ndarray, sums: np.ndarray, inside: np.ndarray, every: float, alpha: float, leave_out: bool) -> np.ndarray:
    """place: for each order, where sums holds the count of the n-gram that ends at each word, and
    inside that within the block; n: the words of each document."""
    doc = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    rest = np.repeat(every - n if leave_out else np.full(len(n), every), n)
    score = shorter = None
    for m, p in enumerate(place):
        c = sums[p]
        if leave_out:
            own = np.ones(len(p))
            # What the block holds once, its document holds once.
            often = np.flatnonzero(inside[p] > 1)
            _, which, times = np.unique(doc[often] * len(sums) + p[often], return_inverse=True, return_counts=True)
            own[often] = times[which]
            c = c - own
        if m == 0:
            score = np.where(c > 0, c / np.maximum(rest, 1), alpha / (rest + 1))
        else:
            higher = c / np.maximum(np.concatenate([np.zeros(1), shorter[:-1]])[: len(c)], 1)
            score = np.where(nth >= m, np.where(c > 0, higher, alpha * score), score)
        shorter = c
    return np.bincount(doc, np.log(score), len(n))


#: Trigrams in DuckDB.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM docs),
places AS (SELECT doc_id, n, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
total AS (SELECT count(*) AS every FROM places),
ones AS (SELECT w, count(*) AS c FROM places GROUP BY w),
own_ones AS (SELECT doc_id, w, count(*) AS c FROM places GROUP BY doc_id, w),
twos AS (SELECT v, w, count(*) AS c FROM places WHERE v IS NOT NULL GROUP BY v, w),
own_twos AS (SELECT doc_id, v, w, count(*) AS c FROM places WHERE v IS NOT NULL GROUP BY doc_id, v, w),
threes AS (SELECT u, v, w, count(*) AS c FROM places WHERE u IS NOT NULL GROUP BY u, v, w),
own_threes AS (SELECT doc_id, u, v, w, count(*) AS c FROM places WHERE u IS NOT NULL GROUP BY doc_id, u, v, w),
counted AS (
  SELECT p.doc_id, p.u, p.v, every - p.n AS rest, a.c - b.c AS c1, c.c - d.c AS c0, e.c - f.c AS c2, i.c - j.c AS c00, g.c - h.c AS c3
  FROM places p CROSS JOIN total JOIN ones a ON a.w = p.w JOIN own_ones b ON b.doc_id = p.doc_id AND b.w = p.w
  LEFT JOIN ones c ON c.w = p.v LEFT JOIN own_ones d ON d.doc_id = p.doc_id AND d.w = p.v
  LEFT JOIN twos e ON e.v = p.v AND e.w = p.w LEFT JOIN own_twos f ON f.doc_id = p.doc_id AND f.v = p.v AND f.w = p.w
  LEFT JOIN twos i ON i.v = p.u AND i.w = p.v LEFT JOIN own_twos j ON j.doc_id = p.doc_id AND j.v = p.u AND j.w = p.v
  LEFT JOIN threes g ON g.u = p.u AND g.v = p.v AND g.w = p.w LEFT JOIN own_threes h ON h.doc_id = p.doc_id AND h.u = p.u AND h.v = p.v AND h.w = p.w),
scored AS (
  SELECT doc_id, ln(CASE WHEN c3 > 0 THEN c3 / c00::DOUBLE
    ELSE (CASE WHEN u IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN c2 > 0 THEN c2 / c0::DOUBLE
    ELSE (CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN c1 > 0 THEN c1 / rest::DOUBLE ELSE 0.4::DOUBLE / (rest + 1) END) END) END) AS s
  FROM counted),
sums AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(s, 0), 5) AS log_score, round(coalesce(s, 0) / greatest(len(ws), 1), 7) AS mean_log_score
FROM docs LEFT JOIN sums USING (doc_id)
"""
