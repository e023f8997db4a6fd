"""Document fingerprints by winnowing: the least k-gram hash of every window, with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, blank_if_null

#: Bits of a packed value that hold the place; 39 bits above them hold the hash.
PLACE = 24
_MASK = (1 << PLACE) - 1


def fingerprint(text: Column, k: int = 5, window: int = 4) -> Column:
    """array<long>: hash * 2^24 + (2^24 - 1 - place) of the chosen k-grams, in order of place.

    Words are the runs of characters that aren't white space. Each k words in a row hash to 39
    bits; a text of fewer words is one gram, one without words has none. Of every `window` grams in
    a row the least hash is chosen and of equal ones the rightmost, which the packing makes the
    least number (places count modulo 2^24 there). So any k + window - 1 words in a row that two
    texts share give them a hash in common.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h: Column) -> Column:
        whole = F.transform(F.array(h), lambda x: F.xxhash64(x))
        many = F.transform(F.slice(h, 1, F.greatest(F.size(h) - k + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))
        return F.when(F.size(h) == 0, F.slice(whole, 1, 0)).when(F.size(h) < k, whole).otherwise(many)

    def packed(g: Column) -> Column:
        return F.transform(g, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - 39), PLACE) + (F.lit(_MASK) - i.cast("long").bitwiseAND(F.lit(_MASK))))

    def chosen(p: Column) -> Column:
        starts = F.slice(p, 1, F.greatest(F.size(p) - window + 1, F.lit(1)))
        return F.array_distinct(F.transform(starts, lambda _, i: F.array_min(F.slice(p, i + 1, F.lit(window)))))

    # `transform` over one element names a value once, where nested calls would copy its expression.
    once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(once(once(hashes, lambda h: packed(grams(h))), chosen))


def as_text(fp: Column) -> Column:
    """place:hash of each choice, joined by commas."""
    return F.array_join(F.transform(fp, lambda x: F.concat((F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK))).cast("string"), F.lit(":"), F.lower(F.hex(F.shiftright(x, PLACE))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 where neither has any."""
    x, y = (F.transform(v, lambda z: F.shiftright(z, PLACE)) for v in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def with_next(docs: DataFrame, add: dict[str, Column], rows_a_bucket: int = 256, most_buckets: int = 16384) -> DataFrame:
    """doc_id, text, the added columns, and next_* of them for the next document, doc_id descending.

    After the last document comes the first. Documents lie in buckets of neighbouring ids, cut at
    quantiles that are ids of the table, so a bucket's last document is followed by the greatest
    id of the bucket below; only documents with such ids are sent to two buckets. A null doc_id
    comes last; equal ids follow each other by text. The columns in `add` are computed after the
    rows are dealt out.
    """
    rows = docs.select("doc_id", blank_if_null("text").alias("text"))
    n = min(max(-(-docs.count() // rows_a_bucket), 1), most_buckets)
    marks = F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n + 1)]), F.lit(max(10000, 8 * n)))
    fine = docs.agg(F.array_compact(F.concat(F.coalesce(marks, F.array().cast("array<long>")), F.array(F.max("doc_id")))).alias("fine")).select(F.array_sort(F.array_distinct("fine")).alias("fine"))
    wide = max(int(n**0.5), 1)
    coarse = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size("fine") - 1, F.lit(0)) / wide)), lambda i: F.get("fine", (i * wide).cast("int")))
    cuts = fine.select(F.struct("fine", coarse.alias("coarse")).alias("cuts")).scalar()
    rows = rows.withColumn("cuts", cuts)

    # The number of bounds below the id: first among every 32nd, then among the 32 after it.
    many = F.size(F.filter(F.col("cuts.coarse"), lambda b: b < F.col("doc_id")))
    some = F.when(many > 0, F.size(F.filter(F.slice(F.col("cuts.fine"), (many - 1) * wide + 1, F.lit(wide)), lambda b: b < F.col("doc_id"))) + (many - 1) * wide).otherwise(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(some))
    copies = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("late")))
    buckets = F.greatest(F.size("cuts.fine"), F.lit(1))
    above = F.struct(F.pmod(F.col("bucket") + 1, buckets).alias("bucket"), F.lit(1).alias("late"))
    at_bound = F.get(F.col("cuts.fine"), F.col("bucket")) == F.col("doc_id")
    only_null = F.col("doc_id").isNull() & (F.size("cuts.fine") == 0)
    rows = rows.withColumn("to", F.explode(F.when(at_bound | only_null, F.concat(copies, F.array(above))).otherwise(copies)))
    rows = rows.select("doc_id", "text", F.col("to.bucket").alias("bucket"), F.col("to.late").alias("late")).repartition("bucket")
    rows = rows.withColumns(add)
    order = W.partitionBy("bucket").orderBy("late", F.col("doc_id").desc_nulls_last(), "text")
    following = {f"next_{c}": F.lead(c).over(order) for c in ("text", *add)}
    return rows.withColumns(following).filter("late = 0").drop("late", "bucket")


def compare(docs: DataFrame, k: int = 5, window: int = 4) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    docs: doc_id, text; more columns are ignored. The edited text has its last half (rounded down,
    code points) replaced by as many from the start of the next document, or all it has.

    Null texts count as empty: no fingerprint, likeness 1 to another empty one and 0 to others.
    An only document is followed by itself. Repeated rows follow each other. An empty table gives
    no rows.
    """
    rows = with_next(docs, {"fp": fingerprint(F.col("text"), k, window)})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited"), k, window))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
