"""News refresh: cards, dedupe, texts, vectors, sentiment, cap per ticker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import article_string
from ..operators import dml, enrich, windows
from ..operators.filters import not_enriched
from ..operators.setops import keep_first
from ..sources import readers, tables, versions


def articles_of(cards: DataFrame) -> DataFrame:
    """Accepted cards, once per ticker and link, with an id that grows with the
    extraction time."""
    once = keep_first(readers.accepted_cards(cards), ["ticker", "link"], F.struct("page_id", "card_no"))
    return once.select(
        F.concat(F.date_format("extraction_timestamp_utc", "yyyyMMddHHmmss"), F.lit("-"), F.lpad(F.col("page_id").cast("string"), 19, "0"), F.lit("-"), F.lpad(F.col("card_no").cast("string"), 6, "0")).alias("_id"),
        "headline", "source", "posted", "description", "link", "synced", "extraction_timestamp_utc", "ticker",
        F.lit(None).cast("string").alias("article_string"),
        F.lit(None).cast("array<float>").alias("article_embedding"),
        F.lit(None).cast("struct<positive:double,negative:double,neutral:double>").alias("sentiment_score"),
    )


def with_embeddings(df: DataFrame, embed) -> DataFrame:
    """Text and vector of articles that have neither; a failed vector leaves
    the text unset as well, so that the next run tries again."""
    pending = not_enriched("article_string", "article_embedding")
    text = article_string(*[F.col(c) for c in ("headline", "description", "source", "ticker", "link")])
    fresh = df.withColumn("_text", F.when(pending, text))
    filled = fresh.withColumn("_vector", embed("_text"))
    done = F.col("_vector").isNotNull()
    return filled.withColumn(
        "article_embedding", F.coalesce("article_embedding", "_vector")
    ).withColumn(
        "article_string", F.coalesce("article_string", F.when(done, F.col("_text")))
    ).drop("_text", "_vector")


def with_sentiment(df: DataFrame, scores: Callable[[Column], Column] = enrich.lexicon_scores) -> DataFrame:
    return enrich.score_missing(df, "article_string", "sentiment_score", scores)


def recreate_embeddings(df: DataFrame, embed) -> DataFrame:
    """Drop every vector and compute it anew where there is a text."""
    cleared = dml.unset(df, "article_embedding")
    return enrich.embed_missing(cleared, "article_string", "article_embedding", embed)


def refresh(stored: DataFrame, fetched: DataFrame, mapping: DataFrame, embed, *, keep: int = 100, scores: Callable[[Column], Column] = enrich.lexicon_scores) -> DataFrame:
    """The new state of the article table.

    Dedupe and cap look at ids and times only, so they run before the vectors
    and scores: rows about to be dropped are never sent to a model, and the
    table ends up the same. A fetched row whose id is stored is the stored row
    fetched again, as a repeated run does.
    """
    new = fetched.join(stored.select("_id"), "_id", "left_anti").select(*stored.columns)
    kept = windows.dedupe_and_cap(stored.unionByName(new), mapping, keep=keep)
    return with_sentiment(with_embeddings(kept, embed), scores)


def run(spark: SparkSession, pages: DataFrame, table: tables.Table, mapping: DataFrame, embed, as_of: str, **options) -> int:
    """``pages`` has page_id, ticker and html. Parsed cards are staged, as they
    are read once to find broken tickers and once more for their rows. Returns
    the number of rows of the table."""
    moment = F.lit(as_of).cast("timestamp")
    with tables.staged(readers.article_cards(pages, "html", "ticker", moment), "cards") as cards:
        return store(spark, articles_of(cards), table, mapping, embed, **options)


def store(spark: SparkSession, fetched: DataFrame, table: tables.Table, mapping: DataFrame, embed, **options) -> int:
    """Refresh the table with fetched articles. Of a bucketed table only those
    buckets are read and written that the change can touch."""
    if table.bucket_by:
        return _store_in_buckets(spark, fetched, table, mapping, embed, **options)
    stored = tables.read(spark, table)
    return tables.replace(refresh(stored, fetched.select(*stored.columns), mapping, embed, **options), table)


def _store_in_buckets(spark: SparkSession, fetched: DataFrame, table: tables.Table, mapping: DataFrame, embed, **options) -> int:
    """Dedupe and cap look at one ticker at a time, so a bucket changes only if
    the batch has rows of it, if it holds rows without a vector or score, or if
    the mapping, by which tickers are capped, is another one than last time.

    The driver holds bucket numbers, never tickers or rows.
    """
    before = versions.latest(spark, table.path)
    bucket = tables.bucket_of(table)
    names = mapping.select("ticker").distinct()
    hashed = F.xxhash64("ticker").cast("decimal(38,0)")
    digest = "-".join(str(x) for x in names.agg(F.count("*"), F.sum(hashed)).first())
    with tables.staged(fetched, "fetched") as rows:
        asked = rows.select(bucket.alias("b"))
        if before is None or before.notes.get("mapping") != digest:
            asked = asked.unionByName(names.select(bucket.alias("b")))
        touched = {r.b for r in asked.distinct().collect()}
        if before is not None:
            touched |= {int(b) for b, f in before.facts.items() if f["pending"]}
        stored = tables.read(spark, table, touched)
        new = refresh(stored, rows.select(*stored.columns), mapping, embed, **options)
        pending = F.count_if(not_enriched("article_string", "article_embedding") | not_enriched("sentiment_score"))
        after = tables.replace_buckets(new, table, touched, before, facts={"pending": pending}, notes={"mapping": digest})
    return sum(f["rows"] for f in after.facts.values())


def run_recreate(spark: SparkSession, table: tables.Table, embed) -> int:
    """Drop and recreate all vectors of the stored articles."""
    anew = recreate_embeddings(tables.read(spark, table), embed)
    if not table.bucket_by:
        return tables.replace(anew, table)
    before = versions.latest(spark, table.path)
    pending = F.count_if(not_enriched("article_string", "article_embedding") | not_enriched("sentiment_score"))
    after = tables.replace_buckets(anew, table, range(table.buckets), before, facts={"pending": pending}, notes=before.notes if before else {})
    return sum(f["rows"] for f in after.facts.values())
