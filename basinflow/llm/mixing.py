"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, blank_if_null, stage_table

#: The first primes above 10^9; each is coprime with any smaller block count.
PRIMES = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103)
#: Shards whose documents are rounded to whole copies together, and the parts of a copy that are counted.
ROUND_SHARDS, PARTS = 4, 1 << 32


def identity() -> Column:
    """What a document is placed by: its id, or without one a digest of its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(blank_if_null("text")))


def _draw(salt: str, *parts: Column) -> Column:
    """A uniform number below 2^60 that depends on the salt and the parts only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *parts)), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = 32,
    shard_docs: int = 512,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document a mix by source weights takes.

    docs: doc_id, text, source; more columns are ignored. Sources in code-point order, null
    last, get the weights in turn. Targets share `share` times all words by weight; a target
    stops at `most` times its source's words and the excess goes to the others by weight.

    Each source's documents lie in seeded order in shards of about shard_docs documents of all
    sources; a shard's words of a source are cut into blocks of `block` words. In each shard the
    Sainte-Laguë quotients target/(2j-1) award whole blocks to the sources; of a source's blocks
    each is taken quota div blocks times and a seeded choice of quota mod blocks once more.

    Quotas start at the divisor `block` and are then raised by the highest or lowered by the
    lowest quotients. A source moves by at most the difference, so these quotients suffice.

    Returns doc_id, size, source_size, target, taken and source for every row. Null or empty
    texts and texts without words have size 0 and take 0; an empty table gives no rows; rows that
    repeat a doc_id count each by itself; rows without an id are placed by their text.
    """
    return _mixed(docs, weights, share, most, block, shard_docs, seed).drop("shard", "key")


def copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    block: int = 32,
    shard_docs: int = 512,
    seed: str = "mix",
) -> DataFrame:
    """How often a mix emits each document as a whole, so that a source emits the words `mix` takes of it.

    Copies are taken / size, rounded down or up. In each source and ROUND_SHARDS shards the
    remainders are added up from a seeded start, documents by size, and a document with which the
    sum passes a whole number has one copy more. So over all starts a document has taken / size
    copies in the mean, and the words emitted there differ from those taken by less than the
    largest document has.

    Returns doc_id, key (see identity), size, target, taken, source and copies for every row, as
    `mix` does; documents of size 0 have 0 copies.
    """
    mixed = _mixed(docs, weights, share, most, block, shard_docs, seed)
    mixed = mixed.withColumn("part", F.floor(F.col("shard") / ROUND_SHARDS)).withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)))
    rest = F.col("taken") - F.col("whole") * F.col("size")
    mixed = mixed.withColumn("rest", F.when(F.col("size") > 0, F.floor(rest * F.lit(PARTS) / F.col("size"))).otherwise(F.lit(0)).cast("long"))
    drawn = _draw(f"{seed}:round", F.col("key"))
    order = W.partitionBy("source", "part").orderBy("size", drawn, "doc_id", "taken")
    start = F.pmod(_draw(f"{seed}:start", F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")), F.col("part").cast("string")), F.lit(PARTS))
    passed = F.sum("rest").over(order.rowsBetween(W.unboundedPreceding, 0)) + start
    mixed = mixed.withColumn("passed", passed)
    more = F.floor(F.col("passed") / PARTS) - F.floor((F.col("passed") - F.col("rest")) / PARTS)
    return mixed.select("doc_id", "key", "size", "target", "taken", "source", (F.col("whole") + more).cast("int").alias("copies"))


def _mixed(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, block: int, shard_docs: int, seed: str) -> DataFrame:
    """What `mix` returns, with the shard."""
    if most < 1 or share > most:
        raise ValueError("share can't exceed most")
    words = F.regexp_count(blank_if_null("text"), F.lit(WORD)).cast("long")
    n_shards = F.ceil(docs.agg(F.count(F.lit(1)).alias("n")).scalar() / F.lit(shard_docs))
    # '0...' sorts before '1', so null sources come last and can still be joined.
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("skey"),
        words.alias("size"),
        identity().alias("key"),
    )
    rows = rows.withColumn("shard", F.pmod(_draw(f"{seed}:shard", F.col("key")), F.greatest(n_shards, F.lit(1))))
    # Ids and sizes only: the texts are read and split once.
    rows = stage_table(rows, "mix-sizes")

    groups = rows.groupBy("skey", "shard").agg(F.sum("size").alias("words"), F.count("doc_id").alias("n"))
    sources = groups.groupBy("skey").agg(F.sum("words").alias("source_size"))
    targets = _targets(sources, weights, share, most)
    quotas = _quotas(groups.join(targets, "skey"), most, block)

    order = W.partitionBy("skey", "shard").orderBy(_draw(f"{seed}:order", F.col("key")), "doc_id", "size")
    placed = rows.withColumn("stop", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return _taken(placed.join(quotas, ["skey", "shard"]), block, seed)


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """skey, source_size, target: water-filling. One row per source goes through the windows."""
    nth = F.row_number().over(W.orderBy("skey"))
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(nth - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = W.orderBy("ratio", "skey")
    # With all sources of a lower ratio at their cap, the rest would get `level` a unit of weight.
    level = (F.lit(share) * F.sum("source_size").over(W.partitionBy()) - (F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))) / F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing))
    ranked = ranked.withColumn("level", level)
    # The first source, in order of ratio, that doesn't reach its cap sets the level for all.
    ranked = ranked.withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(W.partitionBy())["level"])
    target = F.when(F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")))
    return ranked.select("skey", "source_size", target.alias("target"))


def _quotas(groups: DataFrame, most: int, block: int) -> DataFrame:
    """skey, shard, source_size, target, words, blocks, quota."""
    aim = F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(F.lit(0.0))
    base = groups.select("*", aim.alias("aim"), F.ceil(F.col("words") / block).alias("blocks"))
    base = base.withColumn("start", F.floor(F.col("aim") / block + 0.5))
    shard = W.partitionBy("shard")
    base = base.withColumn("off", F.floor(F.sum("aim").over(shard) / block + 0.5) - F.sum("start").over(shard))

    step = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("off")))
    up = F.col("off") > 0
    moves = base.filter("off != 0").select("skey", "shard", "aim", "blocks", "start", "off", step.alias("step"))
    moves = moves.withColumn("seat", F.when(up, F.col("start") + F.col("step")).otherwise(F.col("start") - F.col("step") + 1))
    moves = moves.filter((F.col("seat") >= 1) & (F.col("seat") <= most * F.col("blocks")))
    moves = moves.withColumn("quotient", F.col("aim") / (2 * F.col("seat") - 1))
    first = F.row_number().over(shard.orderBy(F.when(up, -F.col("quotient")).otherwise(F.col("quotient")), "skey", "step"))
    moved = moves.withColumn("nth", first).filter("nth <= abs(off)").groupBy("skey", "shard").agg(F.count(F.lit(1)).alias("moved"))

    quota = F.col("start") + F.coalesce("moved", F.lit(0)) * F.signum("off").cast("long")
    return base.join(moved, ["skey", "shard"], "left").select("skey", "shard", "source_size", "target", "words", "blocks", F.least(quota, most * F.col("blocks")).alias("quota"))


def _taken(placed: DataFrame, block: int, seed: str) -> DataFrame:
    """Adds up, over the blocks that a document touches, its words in each times the block's copies."""
    begin = F.col("stop") - F.col("size")
    group = [F.col("skey"), F.col("shard").cast("string")]
    placed = placed.withColumn("prime", F.element_at(F.array(*map(F.lit, PRIMES)), F.pmod(_draw(f"{seed}:prime", *group), F.lit(len(PRIMES))).cast("int") + 1).cast("long"))
    placed = placed.withColumn("shift", F.when(F.col("blocks") > 0, F.pmod(_draw(f"{seed}:shift", *group), F.col("blocks"))).otherwise(F.lit(0)))
    placed = placed.withColumns({"begin": begin, "whole": F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0))})
    placed = placed.withColumn("extra", F.col("quota") - F.col("whole") * F.col("blocks"))

    def words(b: Column) -> Column:
        inside = F.least(F.col("stop"), (b + 1) * block) - F.greatest(F.col("begin"), b * block)
        chosen = (b * F.col("prime") + F.col("shift")) % F.col("blocks") < F.col("extra")
        return F.when(chosen, inside).otherwise(F.lit(0).cast("long"))

    blocks = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("stop") - 1) / block))
    once_more = F.aggregate(blocks, F.lit(0).cast("long"), lambda acc, b: acc + words(b))
    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + once_more).otherwise(F.lit(0).cast("long"))
    return placed.select("doc_id", "key", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("skey") != "1", F.substring("skey", 2, 1 << 30)).alias("source"), "shard")


#: The same mix in DuckDB, with the default parameters; md5 draws agree on both sides.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key, coalesce('0' || source, '1') AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
total AS (SELECT greatest(1, ceil(count(*) / 512.0)::BIGINT) AS shards FROM docs),
rows AS (
  SELECT d.*, ('0x' || substr(md5(concat_ws('|', 'mix:shard', key)), 1, 15))::BIGINT % shards AS shard,
         ('0x' || substr(md5(concat_ws('|', 'mix:order', key)), 1, 15))::BIGINT AS draw
  FROM docs d, total),
groups AS (SELECT skey, shard, sum(size)::BIGINT AS words FROM rows GROUP BY skey, shard),
sources AS (SELECT skey, sum(words)::BIGINT AS source_size, 2 * sum(words)::BIGINT AS cap,
                   [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY skey)) - 1) % 3 + 1] AS weight
            FROM groups GROUP BY skey),
ratios AS (SELECT *, cap / weight AS ratio FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
filled AS (
  SELECT skey, source_size, CASE WHEN final IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, final * weight) END AS target
  FROM levels, (SELECT arg_min(level, struct_pack(r := ratio, s := skey)) AS final FROM levels WHERE level <= ratio)),
aims AS (
  SELECT *, CASE WHEN source_size > 0 THEN target * words / source_size ELSE 0.0::DOUBLE END AS aim,
         ceil(words / 32.0)::BIGINT AS blocks
  FROM groups JOIN filled USING (skey)),
starts AS (SELECT *, floor(aim / 32 + 0.5)::BIGINT AS start FROM aims),
offs AS (SELECT *, floor(sum(aim) OVER (PARTITION BY shard) / 32 + 0.5)::BIGINT - sum(start) OVER (PARTITION BY shard)::BIGINT AS off FROM starts),
moves AS (
  SELECT *, CASE WHEN off > 0 THEN start + step ELSE start - step + 1 END AS seat
  FROM (SELECT *, unnest(range(1, abs(off)::BIGINT + 1)) AS step FROM offs)),
ranked AS (
  SELECT skey, shard, off, row_number() OVER (PARTITION BY shard
           ORDER BY (CASE WHEN off > 0 THEN -1 ELSE 1 END) * aim / (2 * seat - 1), skey, step) AS nth
  FROM moves WHERE seat >= 1 AND seat <= 2 * blocks),
moved AS (SELECT skey, shard, count(*) AS moved FROM ranked WHERE nth <= abs(off) GROUP BY skey, shard),
quotas AS (
  SELECT o.*, least((start + coalesce(moved, 0) * sign(off))::BIGINT, 2 * blocks) AS quota
  FROM offs o LEFT JOIN moved m ON o.skey = m.skey AND o.shard = m.shard),
placed AS (
  SELECT r.doc_id, r.size, q.*, sum(r.size) OVER (PARTITION BY r.skey, r.shard ORDER BY r.draw, r.doc_id, r.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS stop,
         [1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093, 1000000097, 1000000103][
           ('0x' || substr(md5(concat_ws('|', 'mix:prime', r.skey, r.shard::VARCHAR)), 1, 15))::BIGINT % 8 + 1]::BIGINT AS prime,
         ('0x' || substr(md5(concat_ws('|', 'mix:shift', r.skey, r.shard::VARCHAR)), 1, 15))::BIGINT AS draw
  FROM rows r JOIN quotas q ON r.skey = q.skey AND r.shard = q.shard)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (quota // blocks) * size + list_sum(list_transform(range((stop - size) // 32, (stop - 1) // 32 + 1),
         lambda b: CASE WHEN (b * prime + draw % blocks) % blocks < quota % blocks
                   THEN least(stop, (b + 1) * 32) - greatest(stop - size, b * 32) ELSE 0 END)) END::BIGINT AS taken
FROM placed
"""
