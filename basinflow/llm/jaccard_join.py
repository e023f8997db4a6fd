"""N-gram Jaccard join: rare first shingles find who may link, DivideSkip decides the T-occurrences exactly."""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ANSWERED, ASKED, answer, answers_of, ask, block_count, bucket_count, packed_texts, starts_of, texts_of
from .common import blank_if_null, drop_table, keeps, make_room, small_batches, stage_table
from .components import connected_components

#: Bits of the map of documents whose texts are needed again: half a megabyte, whatever the input.
FILTER_BITS = 1 << 22
#: How often a star moves to its centre's lowest tie.
HOPS = 3
#: Bits of a shingle's hash by which it is counted.
COUNT_BITS = 48

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one-to-one."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown to a quarter of a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_WORDS = WordHashes()
keeps("words", _WORDS.clear)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text with A-Z in lower case; bytes.split() cuts at the ASCII white space."""
    words = text.encode().lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(text: str, k: int) -> np.ndarray:
    """The distinct k-word shingles, as sorted hashes; fewer words make one shingle, none none."""
    h = word_hashes(text)
    if not len(h):
        return h
    if len(h) < k:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=k)], np.uint64)
    n = len(h) - k + 1
    joint = np.zeros(n, np.uint64)
    for i in range(k):
        joint = mixed(joint * _M2 + h[i : i + n])
    return np.unique(joint)


def prefixes(n: int, percent: int) -> tuple[int, int]:
    """How many of a set's first members, in an order common to all sets, meet those of every set it
    links with: where it is the smaller of the two, and where it is the larger.

    Sets of n and m members link if they share at least percent (n + m) / (100 + percent). If two
    sets share c members, the first n - c + 1 of one and the first m - c + 1 of the other have one
    in common.
    """
    return n + (-2 * percent * n // (100 + percent)) + 1, n + (-percent * n // 100) + 1


def _speakers(table: pa.Table, k: int) -> Iterator[tuple[int | None, np.ndarray, bytes, bool]]:
    """A block's rows: id, shingles, their digest, and whether the row speaks for its set. Of a block's
    equal sets the first with an id does."""
    seen = set()
    for doc_id, text in zip(table.column("doc_id").to_pylist(), texts_of(table), strict=True):
        found = shingles(text, k)
        digest = xxhash.xxh128_digest(found.tobytes())
        fresh = doc_id is not None and len(found) > 0 and digest not in seen
        if fresh:
            seen.add(digest)
        yield doc_id, found, digest, fresh


def merged_counts(lists: list[array]) -> tuple[list[int], list[int]]:
    """The members of sorted lists and in how many each occurs: few by a heap, many by a merge sort
    of the runs."""
    if sum(map(len, lists)) <= 256:
        pairs = [(x, sum(1 for _ in run)) for x, run in groupby(heapq.merge(*lists))]
        return [x for x, _ in pairs], [n for _, n in pairs]
    runs = np.concatenate([np.frombuffer(x, np.int32) for x in lists])
    runs.sort(kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    return runs[starts].tolist(), np.diff(np.append(starts, len(runs))).tolist()


def t_occurrences(lists: list[array], least: int, mu: float = 0.0085) -> list[int]:
    """Members of at least `least` of the sorted lists, by DivideSkip.

    The longest lists are set aside and the others merged. What occurs in too few of those to
    reach `least` with all the long ones is skipped, the rest is looked up in the long lists by
    binary search.
    """
    if not lists or least > len(lists):
        return []
    lists = sorted(lists, key=len)
    aside = min(least - 1, int(least / (mu * np.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = []
    for x, count in zip(*merged_counts(short), strict=True):
        if count < least - aside:
            continue
        for i, values in enumerate(long):
            if count >= least or count + len(long) - i < least:
                break
            at = bisect_left(values, x)
            count += at < len(values) and values[at] == x
        if count >= least:
            found.append(x)
    return found


def numbered(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """The members of each set that lie in another one too, as sorted numbers from 0, and how many
    numbers there are. What only one set holds is in no overlap."""
    if not sets:
        return [], 0
    names, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    renumbered = (np.cumsum(common) - 1).astype(np.int32)
    cuts = np.cumsum([len(x) for x in sets])[:-1]
    return [renumbered[x[common[x]]] for x in np.split(number, cuts)], int(common.sum())


def linked_groups(ids: list[int], sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set the least id of those that links reach within these sets.

    Sets are taken by size. The inverted lists hold groups found so far rather than sets: a
    group's members are looked at only where their joint lists reach the overlap that a link
    needs, and until one links. Groups bear the place of their first set; lists are sorted.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sizes = [len(sets[i]) for i in order]
    sets, keys_used = numbered([sets[i] for i in order])
    parent = list(range(len(sets)))
    members: dict[int, list[int]] = {}
    index: list[array | None] = [None] * keys_used
    age = array("i", bytes(4 * keys_used))  # of lists brought up to date after so many unions of groups
    unions = 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, mine in enumerate(sets):
        n, keys = sizes[i], mine.tolist()
        # A smaller set needs percent of the union, so at least percent of n.
        least = -(-percent * n // 100)
        lists = []
        for key in keys:
            held = index[key]
            if held is not None:
                if unions and age[key] != unions:
                    held = index[key] = array("i", sorted({root(j) for j in held}))
                    age[key] = unions
                lists.append(held)
        joined = []
        for other in t_occurrences(lists, least):
            for j in reversed(members[other]):
                m = sizes[j]
                if m * 100 < percent * n:
                    break  # members lie by size, so the rest is smaller still
                both = len(np.intersect1d(mine, sets[j], assume_unique=True))
                if 100 * both >= percent * (n + m - both):
                    joined.append(other)
                    break
        group = min(joined, default=i)
        for other in joined:
            if other != group:
                parent[other] = group
                members[group] = list(heapq.merge(members[group], members.pop(other)))
                unions += 1
        parent[i] = group
        members.setdefault(group, []).append(i)
        for key in keys:
            held = index[key]
            if held is None:
                index[key] = array("i", (group,))
                age[key] = unions
            else:
                at = bisect_left(held, group)
                if at == len(held) or held[at] != group:
                    held.insert(at, group)
    least_id = {g: min(ids[order[j]] for j in m) for g, m in members.items()}
    out = [0] * len(ids)
    for place, i in enumerate(order):
        out[i] = least_id[root(place)]
    return out


def join(docs: DataFrame, k: int = 5, percent: int = 80, cell_docs: int = 1024, cell_shingles: int = 1_000_000, block_chars: int | None = None) -> DataFrame:
    """Groups documents that links reach: sets of k-word shingles whose intersection is at least
    `percent` hundredths of their union.

    docs: doc_id, text; more columns are ignored. Returns doc_id, n_shingles and component_id, the
    smallest doc_id that links reach, for every row. Exact but for collisions of 64-bit hashes of
    shingles. Texts without words, null ones too, have no shingle, link with nothing and are their
    own component; texts of fewer than k words are one shingle. Rows with equal sets link whatever
    their ids; rows that share a doc_id are one document for links. Rows with a null doc_id
    link with each other only through equal sets. An empty table gives no rows.

    1. Blocks of documents ask in how many sets each of their shingles lies (see blocks), by 48 bits of
       its hash. Equal sets make one class, by a digest; its smallest id stands for it.
    2. One of a block's equal sets sends its first shingles in the order of those counts, rare ones
       first (see prefixes): links share at least one, and passages that many documents share are
       sent only by sets that hold little else. Those of one set only aren't sent. Who sends one is
       tied to the smallest id there, and an id with those tied to it is a star. The order decides
       what is searched, not what links.
    3. A star's sets are searched together (t_occurrences). A star over cell_docs sets or
       cell_shingles members is cut into chunks, each searched with the star's centre. What that
       ties to the centre needs no look at each other; the others of the star, cut into chunks
       again, meet all its chunks in cells of their own. So a group whose members link with its
       centre is sent once, and only what doesn't meets the rest. Cells give each set's least
       linked id, not its links, and these meet in the end.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = block_count(docs, block_chars)
    buckets = bucket_count(docs, blocks)
    packed = packed_texts(docs.withColumn("doc_id", F.col("doc_id").cast("long")), blocks)
    cut = np.uint64(64 - COUNT_BITS)

    def count(table: pa.Table) -> pa.Table:
        make_room("words")
        every = np.concatenate([*(found >> cut for _, found, _, fresh in _speakers(table, k) if fresh), np.zeros(0, np.uint64)])
        keys, counts = np.unique(every, return_counts=True)
        return ask(table.column("block")[0].as_py(), keys, counts, starts_of(keys, buckets, COUNT_BITS))

    answered = packed.groupBy("block").applyInArrow(count, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED)

    def speak(_, table: pa.Table, answers: pa.Table) -> pa.Table:
        make_room("words")
        rows = list(_speakers(table, k))
        keys = np.unique(np.concatenate([*(found >> cut for _, found, _, fresh in rows if fresh), np.zeros(0, np.uint64)]))
        sums = answers_of(((b, s.as_py()) for b, s in zip(answers.column("bucket").to_pylist(), answers.column("sums"), strict=True)), starts_of(keys, buckets, COUNT_BITS))
        marks, smaller = [], []
        for _, found, _, fresh in rows:
            if not fresh:
                marks.append(np.zeros(0, np.int64))
                smaller.append(0)
                continue
            times = sums[np.searchsorted(keys, found >> cut)]
            first, last = prefixes(len(found), percent)
            order = np.argsort(times, kind="stable")[:last]
            alone = int(np.searchsorted(times[order], 1, side="right"))
            marks.append(found[order[alone:]].view(np.int64))
            smaller.append(max(first - alone, 0))
        offsets = np.concatenate([[0], np.cumsum([len(m) for m in marks])]).astype(np.int32)
        values = np.concatenate([*marks, np.zeros(0, np.int64)])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n": pa.array([len(found) for _, found, _, _ in rows], pa.int64()),
                "digest": pa.array([digest for _, _, digest, _ in rows], pa.binary()),
                "smaller": pa.array(smaller, pa.int32()),
                "marks": pa.ListArray.from_arrays(offsets, values),
            }
        )

    spoken = packed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(speak, "doc_id long, n long, digest binary, smaller int, marks array<long>")
    spoken = stage_table(spoken, "join-marks")
    sets = stage_table(spoken.select("doc_id", "n", "digest"), "join-sets")
    classes = stage_table(sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("head"), F.max("n").alias("n")), "join-classes")

    marks = spoken.select(F.col("doc_id").alias("id"), "smaller", F.posexplode("marks").alias("nth", "mark"))
    lows = marks.groupBy("mark").agg(F.min(F.when(F.col("nth") < F.col("smaller"), F.col("id"))).alias("low"), F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most and low is not null").select("mark", "low")
    ties = marks.join(lows, "mark").select("id", "low").filter("id != low").distinct()
    # Ties of sets are ties of their classes' heads.
    named = sets.filter("n > 0 and doc_id is not null").join(classes.select("digest", "head"), "digest").select("doc_id", "head").distinct()
    ties = ties.join(named.select(F.col("doc_id").alias("id"), F.col("head").alias("a")), "id").join(named.select(F.col("doc_id").alias("low"), F.col("head").alias("b")), "low")
    ties = ties.filter("a != b").select(F.col("a").alias("id"), F.col("b").alias("low")).distinct()
    ties = stage_table(ties, "join-ties")
    drop_table(spoken)
    # Two that share a mark are both tied to its low id, or one is it: stars hold all links.
    # Moving a star to its centre's own lowest tie keeps them together and lets stars that overlap
    # become one, so that most sets are sent to one cell. Only centres take the steps.
    hop = ties.groupBy("id").agg(F.min("low").alias("to"))
    centres = ties.select("low").distinct().withColumn("at", F.col("low"))
    for _ in range(HOPS):
        centres = centres.join(hop, F.col("at") == F.col("id"), "left").select("low", F.least("at", "to").alias("at"))
    centres = stage_table(centres, "join-centres")
    moved = stage_table(ties.join(centres, "low").select("id", F.col("at").alias("low")), "join-moved")
    stars = moved.union(centres.select(F.col("low").alias("id"), F.col("at").alias("low"))).distinct()
    sized = stage_table(stars.join(classes.groupBy(F.col("head").alias("id")).agg(F.max("n").alias("n")), "id"), "join-sized")
    for done in (ties, centres, moved):
        drop_table(done)
    in_chunks = F.greatest(F.ceil(F.count(F.lit(1)) / cell_docs), F.ceil(F.sum("n") / cell_shingles)).cast("int")
    totals = sized.groupBy("low").agg(in_chunks.alias("chunks"))
    placed = sized.join(totals, "low").select(F.col("id").alias("node"), "low", "n", "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("a"))
    placed = stage_table(placed, "join-placed")
    # The centre goes to every chunk of its star.
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    spokes = placed.select("node", "low", "a").union(totals.filter("chunks > 1").select(F.col("low").alias("node"), "low", every.alias("a"))).distinct()
    cells = spokes.withColumn("b", F.lit(-1))

    # The texts of heads in stars are read again, so that sets needn't be kept for all. A bit map
    # of fixed size passes over most other texts; the join that follows is exact. Texts go to the
    # cells compressed, in a fraction of their sets' bytes, since hashes can't be compressed.
    bits = sized.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("h")).groupBy(F.floor(F.col("h") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("h") % 64).cast("int"))).alias("bits")).toPandas()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    passed = spark.sparkContext.broadcast(table)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            h = batch.column(2).to_numpy()
            keep = np.flatnonzero(passed.value[h >> 6] >> (h & 63) & 1)
            packed = [pack.compress(batch.column(1)[i].as_py().encode().lower()) for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(packed, pa.binary())], ["id", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_if_null("text").alias("text"))
    hashed = rows.filter("doc_id is not null").withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    loaded = hashed.mapInArrow(load, "id long, packed binary")

    def search(table: pa.Table) -> pa.Table:
        make_room("words")
        ids = table.column("id").to_pylist()
        unpack = zstandard.ZstdDecompressor()
        found = [shingles(unpack.decompress(x.as_py()).decode(), k) for x in table.column("packed")]
        low = linked_groups(ids, found, percent)
        return pa.table({"u": pa.array(ids, pa.int64()), "v": pa.array(low, pa.int64())})

    def searched(cells: DataFrame) -> DataFrame:
        dealt = loaded.join(cells, F.col("id") == F.col("node")).select("low", "a", "b", "id", "packed")
        return dealt.groupBy("low", "a", "b").applyInArrow(search, "u long, v long").filter("u != v").distinct()

    links = stage_table(searched(cells), "join-links")
    groups = stage_table(connected_components(links), "join-groups")
    cut = placed.filter("chunks > 1")
    if not cut.isEmpty():
        # Members of cut stars that aren't tied to their centre so far.
        found = groups.select("node", "component")
        mine = cut.join(found, "node", "left").select("node", "low", "n", "chunks", F.coalesce("component", "node").alias("component"))
        centre = found.select(F.col("node").alias("low"), F.col("component").alias("main"))
        others = mine.join(centre, "low", "left").filter("component != coalesce(main, low)").select("node", "low", "n", "chunks")
        others = stage_table(others, "join-others")
        parts = others.groupBy("low").agg(in_chunks.alias("parts"))
        others = others.join(parts, "low").withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
        meet = others.select("node", "low", every.alias("a"), "b")
        all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        meet = meet.union(cut.join(parts, "low").select("node", "low", "a", all_parts.alias("b"))).distinct()
        more = stage_table(searched(meet), "join-links")
        before, groups = groups, stage_table(connected_components(links.union(more)), "join-groups")
        for done in (others, more, before):
            drop_table(done)
    for done in (sized, placed, links):
        drop_table(done)

    heads = classes.join(groups.select(F.col("node").alias("head"), "component"), "head", "left").select("digest", F.coalesce("component", "head").alias("component"))
    return sets.join(heads, ["digest"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
