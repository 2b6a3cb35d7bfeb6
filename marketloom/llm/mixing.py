"""Operator 12: mix sources to target weights by capped water-filling, sampled in whole and fractional repetitions.

The budget (a multiple of all words) is shared by weight. A source whose share is above ``cap`` times its words is clamped
there and the excess goes to the others by weight, until none is above. With one water level for all sources, a source's
share is the smaller of its cap and weight * level; each round raises the level to (budget - clamped caps) / (weights of the
others), and the level settles when no further source is clamped. The driver holds this one number.

A source's target is then met by whole and fractional repetitions: every document is repeated floor(target / words) times,
and once more if its seeded slot lies below the slot in which the rest of the target runs out. The documents of that one
slot, about one in ``SLOTS``, are repeated in part: the same fraction of their words, rounded by a seeded number. So a
source misses its target by no more than the rounding of those documents, whatever the sizes of its documents.

Main path: built-in functions only.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last; rows of
one doc_id and size (repeated rows too) are taken alike; a null doc_id is kept; a source without words has target 0; a
table without words takes nothing; an empty table gives no rows. ``plan`` returns only the columns it names, ``mixed`` those
of the input and three more, which replace columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import positions, same
from .shared import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words; most repetitions of a source.
BUDGET, CAP = 1.5, 2.0
SEED = 12
#: Slots of a source; the documents of one slot are taken in part.
SLOTS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _with_slots(rows: DataFrame, seed: int) -> DataFrame:
    """Add ``slot`` (0 to SLOTS - 1) and ``unit`` (0 to 1), seeded by doc_id and size."""
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    found = rows.withColumn("_hash", F.sha2(named, 256))

    def digits(at: int, n: int) -> Column:
        return F.conv(F.substring("_hash", at, n), 16, 10).cast("long")

    return found.withColumns({"slot": digits(1, 3), "unit": digits(4, 12) / F.lit(float(1 << 48))}).drop("_hash")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, slot and unit of every document."""
    size = words_in(F.col("text").cast("string")).alias("size")
    return _with_slots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size), seed)


def water_level(sources: DataFrame, budget: float) -> float:
    """The level at which the smaller of cap and weight * level, over all sources, uses up the budget. ``sources``: weight, cap."""
    level = 0.0
    while True:
        above = F.col("weight") * level > F.col("cap")
        row = sources.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        if row.free is None:
            return math.inf  # all are clamped
        raised = (budget - row.used) / row.free
        if raised <= level:
            return level
        level = raised


def by_order(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight``: the given weights in turn, sources by code point, null last."""
    ranked = positions(sources.withColumn("_group", F.lit(0)).withColumn("_null", F.col("source").isNull()), ["_group"], ["_null", "source"])
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    return ranked.select(*sources.columns, turn.alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame | None = None, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, target of every source. ``weights`` (source, weight) must name every source that has rows; by
    default ``by_order`` gives them."""
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        known = by_order(known)
    else:
        own = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        known = known.join(own, same([(F.col("source"), F.col("_source"))]), "left").drop("_source")
        named = F.when(F.col("weight") > 0, F.col("weight"))
        known = known.withColumn("weight", F.coalesce(named, F.raise_error(F.concat(F.lit("no weight above 0 for source "), F.coalesce("source", F.lit("null")))).cast("double")))
    known = staged(known.withColumn("cap", F.col("source_size") * F.lit(cap)), "sources")
    whole = known.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(known, budget * whole)
    return known.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def schedule(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source: ``whole`` repetitions of every document, the ``cut`` slot below which documents are repeated once more,
    and the ``part`` of the documents of that slot. Sums are combined per slot before they are shuffled."""
    filled = sizes.groupBy("source", "slot").agg(F.sum("size").alias("held")).where("held > 0")
    own = goals.select(F.col("source").alias("_source"), "source_size", "target", F.floor(F.col("target") / F.nullif("source_size", F.lit(0))).alias("whole"))
    rows = filled.join(own, same([(F.col("source"), F.col("_source"))]))
    upto = Window.partitionBy("source").orderBy("slot")
    rows = rows.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = rows.withColumn("before", F.sum("held").over(upto) - F.col("held"))
    part = (F.col("rest") - F.col("before")) / F.col("held")
    cuts = rows.where("before <= rest and rest < before + held").select(F.col("source").alias("_cut_source"), F.col("slot").alias("cut"), part.alias("part"))
    return own.join(cuts, same([(F.col("_source"), F.col("_cut_source"))]), "left").select("_source", "source_size", "target", "whole", "cut", "part")


def _scheduled(docs: DataFrame, weights: DataFrame | None, budget: float, cap: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents, and the schedule of the sources."""
    sizes = staged(sized(docs, seed), "sizes")
    goals = staged(targets(sizes, weights, budget, cap), "targets")
    return sizes, staged(schedule(sizes, goals), "schedule")


def _repeated(rows: DataFrame, own: DataFrame) -> DataFrame:
    """Join the schedule and add ``copies`` (whole repetitions) and ``words`` (of one more, partial or whole)."""
    joined = rows.join(own, same([(F.col("source"), F.col("_source"))]))
    fraction = F.least(F.floor(F.col("part") * F.col("size") + F.col("unit")), "size")
    words = F.when(F.col("slot") < F.col("cut"), F.col("size")).when(F.col("slot") == F.col("cut"), fraction).otherwise(0)
    return joined.withColumns({"copies": F.coalesce("whole", F.lit(0)).cast("long"), "words": words.cast("long")})


def plan(docs: DataFrame, weights: DataFrame | None = None, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and words of every document."""
    sizes, own = _scheduled(docs, weights, budget, cap, seed)
    return _repeated(sizes, own).select("doc_id", "source", "size", "source_size", "target", "copies", "words")


def mixed(docs: DataFrame, weights: DataFrame | None = None, budget: float = BUDGET, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself: every repetition of every document as a row, with ``size``, ``repetition`` (from 1), ``words`` and
    the text that is taken: the whole text, or its first ``words`` words with what stands between them."""
    _, own = _scheduled(docs, weights, budget, cap, seed)
    given = F.struct(*docs.columns).alias("given")
    text = F.col("given.text").cast("string")
    rows = docs.select(given, F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = _with_slots(rows.withColumn("size", words_in(text)), seed)
    rows = _repeated(rows, own).withColumn("each", F.array_append(F.array_repeat(F.col("size"), F.col("copies").cast("int")), F.col("words")))
    rows = rows.select("given", "size", F.posexplode("each").alias("nth", "words")).where("words > 0")
    parts = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(parts, 1, F.greatest(F.col("words"), F.lit(1)).cast("int")), "")
    taken = F.when(F.col("words") < F.col("size"), head).otherwise(text).alias("text")
    kept = [c for c in docs.columns if c not in ("size", "repetition", "words")]
    return rows.select(*[taken if c == "text" else F.col(f"given.`{c}`") for c in kept], "size", (F.col("nth") + 1).alias("repetition"), "words")


def op12_mixing(spark, folder: str) -> DataFrame:
    found = plan(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("words")).alias("taken"))


OP12_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
hashed AS (
  SELECT *, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || size::VARCHAR) AS h FROM docs),
rows AS (
  SELECT doc_id, source, size, ('0x' || substr(h, 1, 3))::BIGINT AS slot, ('0x' || substr(h, 4, 12))::BIGINT / {float(1 << 48)}::DOUBLE AS unit FROM hashed),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
sources AS (
  SELECT *, source_size * {CAP}::DOUBLE AS cap,
         [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(WEIGHTS)}) + 1] AS weight
  FROM sizes),
level(v) AS (
  SELECT 0::DOUBLE
  UNION
  SELECT ((SELECT sum(source_size)::DOUBLE * {BUDGET} FROM sources) - (SELECT coalesce(sum(cap) FILTER (weight * v > cap), 0) FROM sources))
         / (SELECT sum(weight) FILTER (NOT weight * v > cap) FROM sources)
  FROM level),
goals AS (SELECT source, source_size, least(cap, weight * (SELECT max(v) FROM level)) AS target FROM sources),
held AS (SELECT source, slot, sum(size)::BIGINT AS held FROM rows GROUP BY ALL HAVING sum(size) > 0),
upto AS (
  SELECT h.source, slot, held, sum(held) OVER (PARTITION BY h.source ORDER BY slot) - held AS before,
         target - floor(target / source_size) * source_size AS rest
  FROM held h JOIN goals g ON h.source IS NOT DISTINCT FROM g.source),
cuts AS (SELECT source, slot AS cut, (rest - before) / held AS part FROM upto WHERE before <= rest AND rest < before + held)
SELECT doc_id, size, source_size, target,
       (coalesce(floor(target / nullif(source_size, 0)), 0) * size
        + CASE WHEN slot < cut THEN size WHEN slot = cut THEN least(floor(part * size + unit), size) ELSE 0 END)::BIGINT AS taken
FROM rows r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source"""
