"""Forum refresh: what to fetch, upsert, texts, vectors, sentiment, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import embedding_text, fit_for_scorer, query_or_asset, sentiment_text
from ..operators import dml, enrich, joins, keywords, windows
from ..operators.filters import not_enriched, with_values
from ..sources import readers, tables

KEYS = ["url", "asset_id"]


def pairs_to_fetch(mapping: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Asset and subreddit pairs without rows of today, with query and cross ids."""
    fanned = joins.fan_out(with_values(mapping, "asset_id"))
    named = fanned.withColumn("query", query_or_asset(F.col("query"), F.col("asset_id")))
    return joins.not_fetched_today(named, stored, as_of)


def fetched_rows(landed: DataFrame, pairs: DataFrame, as_of: Column, *, limit: int = 10) -> DataFrame:
    """Landed posts of the wanted pairs that match the pair's query, the newest
    of the last day per pair. ``landed`` has subreddit, title, selftext,
    created_at_utc and _id, which is unique."""
    matched = keywords.matching_pairs(landed, pairs, "_id", ["title", "selftext"], on="subreddit")
    return windows.newest_per_pair(matched, as_of, limit=limit)


def store(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return dml.upsert(
        stored, incoming.drop("submission_embeddings", "sentiment_score"), KEYS,
        F.struct("extraction_timestamp_utc", "created_at_utc"), only_if_present=("binance_asset", "asset_yfinance"),
    )


def _chosen(df: DataFrame, pending: Column, max_documents: int | None) -> DataFrame:
    """Mark the pending rows to work on: all, or the first ones by id."""
    if max_documents is None:
        return df.withColumn("_chosen", pending)
    first = windows.latest_rows(df.filter(pending).select("_id"), [F.col("_id")], max_documents)
    marked = df.join(first.withColumn("_chosen", F.lit(True)), "_id", "left")
    return marked.withColumn("_chosen", F.col("_chosen").isNotNull())


def with_embeddings(df: DataFrame, embed, *, max_documents: int | None = None) -> DataFrame:
    rows = _chosen(df, not_enriched("submission_embeddings"), max_documents)
    texted = rows.withColumn("_text", embedding_text(F.col("submission_dict")))
    filled = enrich.embed_missing(texted, "_text", "submission_embeddings", embed, where=F.col("_chosen"))
    return filled.select(*df.columns)


def with_sentiment(
    df: DataFrame, scores=enrich.lexicon_scores, *, limit: int | None = None, max_documents: int | None = None
) -> DataFrame:
    """Score the chosen rows; ``limit`` is the length a scorer states, if it states one."""
    rows = _chosen(df, not_enriched("sentiment_score"), max_documents)
    whole = sentiment_text(F.col("submission_dict"))
    fitted = whole if limit is None else fit_for_scorer(whole, limit)
    texted = rows.withColumn("_text", F.when(F.col("_chosen"), fitted))
    return enrich.score_missing(texted, "_text", "sentiment_score", scores).select(*df.columns)


def clean(df: DataFrame, mapping: DataFrame, as_of: Column, *, days: int = 60, floor: int = 40) -> DataFrame:
    cutoff = as_of - F.expr(f"INTERVAL {days} DAYS")
    kept = windows.retention_with_floor(df, mapping, cutoff, floor=floor)
    return dml.purge_unkeyed(kept, mapping, cutoff)


def refresh(stored: DataFrame, incoming: DataFrame, mapping: DataFrame, embed, as_of: Column, *, days: int = 60, floor: int = 40) -> DataFrame:
    """The new state of the submission table. Retention looks at keys and times
    only and runs before the vectors and scores, which leaves the same rows."""
    kept = clean(store(stored, incoming), mapping, as_of, days=days, floor=floor)
    return with_sentiment(with_embeddings(kept, embed))


def run(spark: SparkSession, landed: str, table: tables.Table, mapping: DataFrame, embed, as_of: str) -> int:
    """Landed submissions of the pairs that are due. A pair counts as fetched
    when a row of today carries its name exactly as the mapping writes it."""
    moment = F.lit(as_of).cast("timestamp")
    stored = tables.read(spark, table)
    incoming = readers.read_submissions(spark, landed, moment)
    searched = F.substr(F.col("submission_dict.subreddit"), F.lit(3))
    due = joins.not_fetched_today(joins.fan_out(mapping), stored, moment)
    wanted = incoming.withColumn("_searched", searched).join(
        due.select("asset_id", F.col("subreddit").alias("_searched")), ["asset_id", "_searched"], "left_semi"
    )
    return tables.replace(refresh(stored, wanted.drop("_searched"), mapping, embed, moment), table)


def run_embeddings(spark: SparkSession, table: tables.Table, embed, *, max_documents: int | None = None, anew: bool = False) -> int:
    """Vectors only; ``anew`` drops the stored ones first."""
    rows = tables.read(spark, table)
    rows = dml.unset(rows, "submission_embeddings") if anew else rows
    return tables.replace(with_embeddings(rows, embed, max_documents=max_documents), table)


def run_sentiment(
    spark: SparkSession, table: tables.Table, *, scores=enrich.lexicon_scores, max_documents: int | None = None, anew: bool = False
) -> int:
    """Sentiment only; ``anew`` drops the stored scores first."""
    rows = tables.read(spark, table)
    rows = dml.unset(rows, "sentiment_score") if anew else rows
    return tables.replace(with_sentiment(rows, scores, max_documents=max_documents), table)


def run_clean(spark: SparkSession, table: tables.Table, mapping: DataFrame, as_of: str, *, days: int = 60, floor: int = 40) -> int:
    """Retention only."""
    moment = F.lit(as_of).cast("timestamp")
    return tables.replace(clean(tables.read(spark, table), mapping, moment, days=days, floor=floor), table)
