"""Submission, mapping and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, dml, filters, joins, keywords, windows
from ..operators.skew import top_k
from ..plans import forum
from ..sources import readers
from .base import Registry
from .views import (
    AGED_AS_OF, AGED_POSTS, ASSETS, MAPPING, POSTS, aged_posts, articles, assets, conversation_turns, mapping, posts, show, sql_show, table,
)

forum_queries = Registry()
add = forum_queries.add


def _as_of():
    return F.lit(AGED_AS_OF).cast("timestamp")


# -- submissions --------------------------------------------------------------------------


@add("""WITH turns AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(conv_id * 3600 + turn * 60) AS created FROM conversations),
replies AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM turns WHERE turn > 0),
c AS (SELECT conv_id, max(n) AS n, string_agg(CASE WHEN rn <= 3 THEN CASE WHEN role = 'system' THEN '[deleted]' ELSE role END || '@' || strftime(created, '%H:%M') || ':' || substring("text", 1, 250) END, '|' ORDER BY rn) AS body FROM replies GROUP BY 1)
SELECT t.conv_id, strftime(t.created, '%Y-%m-%d %H:%M:%S') AS created_at_utc, CASE WHEN t.role <> 'system' THEN t.role END AS author, 'r/s' || CAST(t.conv_id % 6 AS VARCHAR) AS doc_subreddit,
  CASE WHEN t.role = 'user' THEN 'A' || CAST(t.conv_id % 18 AS VARCHAR) ELSE 'Unknown' END AS doc_asset, substring(t."text", 1, 1000) AS doc_selftext, t."text" AS selftext,
  coalesce(n, 0) AS num_comments, coalesce(body, '') AS comments, CASE WHEN t.role = 'user' THEN 'AUSDT' END AS binance_asset FROM turns t LEFT JOIN c USING (conv_id) WHERE t.turn = 0""")
def submissions(spark, folder):
    """Landed submissions with nested comments in the table's shape. The four
    newest turns stand for the landed comment list; the reader keeps three."""
    turns = conversation_turns(spark, folder)
    heads, replies = turns.filter("turn = 0"), turns.filter("turn > 0")
    counts = replies.groupBy("conv_id").agg(F.count("*").alias("n"))
    comment = F.struct(
        F.col("turn").cast("string").alias("id"), F.when(F.col("role") != "system", F.col("role")).alias("author"), F.col("text").alias("body"),
        F.lit(1).cast("long").alias("score"), F.unix_seconds("created").cast("double").alias("created_utc"),
    )
    landed = top_k(replies, ["conv_id"], [F.col("turn").desc()], 4, spread=["turn"])
    nested = landed.groupBy("conv_id").agg(F.array_sort(F.collect_list(comment)).alias("comments"))
    when_user = lambda c: F.when(F.col("role") == "user", c)
    none = lambda t: F.lit(None).cast(t)
    raw = heads.join(counts, "conv_id", "left").join(nested, "conv_id", "left").select(
        F.lit("display").alias("subreddit"), F.substring_index("text", ".", 1).alias("title"), F.when(F.col("role") != "system", F.col("role")).alias("author"),
        none("string").alias("author_fullname"), none("boolean").alias("author_premium"), none("boolean").alias("author_is_blocked"),
        F.unix_seconds("created").cast("double").alias("created"), F.unix_seconds("created").cast("double").alias("created_utc"),
        F.lit("self").alias("domain"), F.col("conv_id").cast("string").alias("name"), F.lit(0).cast("long").alias("score"),
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("url"), F.col("text").alias("selftext"), F.coalesce("n", F.lit(0).cast("long")).alias("num_comments"),
        F.lit(0).cast("long").alias("ups"), F.lit(0).cast("long").alias("downs"), "comments",
        F.concat(F.lit("s"), (F.col("conv_id") % 6).cast("string")).alias("searched_subreddit"),
        when_user(F.concat(F.lit("A"), (F.col("conv_id") % 18).cast("string"))).alias("asset_id"), none("string").alias("query"),
        F.when(F.col("role") == "user", "AUSDT").otherwise("").alias("asset_binance"), none("string").alias("asset_yfinance"),
    )
    rows = readers.submissions(raw, F.lit("2024-03-01").cast("timestamp"), body_size=250, selftext_size=1000, comment_count=3)
    line = lambda c: F.concat(c["author"], F.lit("@"), F.date_format(c["created_at_utc"], "HH:mm"), F.lit(":"), c["body"])
    doc = F.col("submission_dict")
    return rows.select(
        F.col("name").cast("long").alias("conv_id"), show("created_at_utc").alias("created_at_utc"), "author", doc["subreddit"].alias("doc_subreddit"),
        doc["asset_id"].alias("doc_asset"), doc["selftext"].alias("doc_selftext"), "selftext", "num_comments",
        F.array_join(F.transform("comments", line), "|").alias("comments"), "binance_asset",
    )


EMBED_TEXT = """'Title: ' || title || chr(10) || 'Content: ' || selftext || chr(10) || 'Subreddit: ' || subreddit || chr(10) || 'Asset: ' || asset_id ||
  CASE WHEN len(comments) > 0 THEN chr(10) || 'Comments: ' || array_to_string(list_transform(comments, lambda c, i: 'Comment ' || CAST(i AS VARCHAR) || ' by ' || c.author || ': ' || c.body), ' | ') ELSE '' END"""
SENTIMENT_TEXT = """'TITLE: ' || title || chr(10) || chr(10) || 'CONTENT: ' || CASE WHEN length(selftext) > 500 THEN substring(selftext, 1, 500) || '...' ELSE selftext END || chr(10) || chr(10) || 'SUBREDDIT: ' || subreddit || chr(10) || chr(10) || 'ASSET: ' || asset_id ||
  CASE WHEN len(comments) > 0 THEN chr(10) || chr(10) || 'COMMENTS SECTION:' || chr(10) || chr(10) || array_to_string(list_transform(comments, lambda c, i: 'COMMENT ' || CAST(i AS VARCHAR) || ' BY ' || c.author || ': ' || CASE WHEN length(c.body) > 150 THEN substring(c.body, 1, 150) || '...' ELSE c.body END), chr(10) || chr(10)) ELSE '' END"""


#: Sizes of the original's requests.
REQUEST = {"content_size": 500, "comment_size": 150, "comment_count": 3}


@add(f"WITH {POSTS} SELECT conv_id, {EMBED_TEXT} AS embed_text FROM posts")
def submission_embed_text(spark, folder):
    return posts(spark, folder).select("conv_id", text.embedding_text(F.col("submission_dict"), comment_count=3).alias("embed_text"))


@add(f"WITH {POSTS} SELECT conv_id, {SENTIMENT_TEXT} AS sentiment_text FROM posts")
def submission_sentiment_text(spark, folder):
    return posts(spark, folder).select("conv_id", text.sentiment_text(F.col("submission_dict"), **REQUEST).alias("sentiment_text"))


LIMIT = 600


@add(f"""WITH {POSTS}, t AS (SELECT conv_id, {SENTIMENT_TEXT} AS s FROM posts),
l AS (SELECT conv_id, s, regexp_extract(s, '^(TITLE:[^\\n]*)', 1) || chr(10) || chr(10) || substring(s, 1, length(s) // 2) AS h,
  array_to_string(string_split(s, chr(10) || chr(10))[1:2], chr(10) || chr(10)) AS p FROM t)
SELECT conv_id, CASE WHEN length(s) <= {LIMIT} THEN s WHEN length(h) <= {LIMIT} THEN h WHEN length(p) <= {LIMIT} THEN p END AS fitted FROM l""")
def scorer_text_ladder(spark, folder):
    """The first form of the text that a scorer of limited length accepts."""
    fitted = text.fit_for_scorer(text.sentiment_text(F.col("submission_dict"), **REQUEST), LIMIT)
    return posts(spark, folder).select("conv_id", fitted.alias("fitted"))


UPSERT = """
stored AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, event_type AS asset_id, max(value) AS score, 'B' || CAST(count(*) AS VARCHAR) AS binance_asset, CAST(min(event_id) AS VARCHAR) AS vec
  FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
incoming AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, event_type AS asset_id, CASE WHEN value >= 5 THEN value END AS score, CASE WHEN value >= 40 THEN 'N' || CAST(event_id AS VARCHAR) END AS binance_asset, ts
  FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
batch AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY url, asset_id ORDER BY ts DESC) = 1)"""


def _upsert_sides(spark, folder):
    events = table(spark, folder, "events").withColumn("url", F.concat(F.lit("u"), F.col("user_id").cast("string"))).withColumn("asset_id", F.col("event_type"))
    at = lambda t: F.lit(t).cast("timestamp")
    stored = events.filter(F.col("ts") < at("2024-01-20")).groupBy("url", "asset_id").agg(
        F.max("value").alias("score"), F.concat(F.lit("B"), F.count("*").cast("string")).alias("binance_asset"), F.min("event_id").cast("string").alias("vec")
    )
    incoming = events.filter(F.col("ts") >= at("2024-01-15")).select(
        "url", "asset_id", F.when(F.col("value") >= 5, F.col("value")).alias("score"),
        F.when(F.col("value") >= 40, F.concat(F.lit("N"), F.col("event_id").cast("string"))).alias("binance_asset"), "ts",
    )
    return stored, incoming


@add(f"""WITH {UPSERT} SELECT coalesce(b.url, s.url) AS url, coalesce(b.asset_id, s.asset_id) AS asset_id, CASE WHEN b.url IS NOT NULL THEN b.score ELSE s.score END AS score,
  coalesce(b.binance_asset, s.binance_asset) AS binance_asset, vec FROM stored s FULL JOIN batch b ON s.url = b.url AND s.asset_id = b.asset_id""")
def submission_upsert(spark, folder):
    """Stored rows updated or inserted by (url, asset_id)."""
    stored, incoming = _upsert_sides(spark, folder)
    return dml.upsert(stored, incoming, ["url", "asset_id"], F.col("ts"), only_if_present=("binance_asset",))


@add(f"WITH {UPSERT} SELECT count(*) FILTER (s.url IS NULL) AS inserted, count(*) FILTER (s.url IS NOT NULL) AS updated FROM batch b LEFT JOIN stored s ON s.url = b.url AND s.asset_id = b.asset_id")
def upsert_summary(spark, folder):
    stored, incoming = _upsert_sides(spark, folder)
    return aggregates.upsert_counts(incoming, stored, ["url", "asset_id"])


# -- mapping --------------------------------------------------------------------------------


@add(f"WITH {MAPPING} SELECT asset_id, subreddit, coalesce(query, asset_id) AS query FROM mapping")
def subreddit_fan_out(spark, folder):
    fanned = joins.fan_out(filters.with_values(mapping(spark, folder), "asset_id"))
    return fanned.select("asset_id", "subreddit", text.query_or_asset(F.col("query"), F.col("asset_id")).alias("query"))


@add(f"""WITH {MAPPING} SELECT doc_id, asset_id, query FROM documents JOIN mapping ON source = subreddit
WHERE query IS NOT NULL AND (contains(lower("text"), lower(string_split(query, ' OR ')[1])) OR contains(lower("text"), lower(string_split(query, ' OR ')[2])))""")
def keyword_matches(spark, folder):
    """Texts of the mapped sources in which a query term occurs."""
    pairs = joins.fan_out(filters.with_values(mapping(spark, folder), "asset_id", "query"))
    docs = table(spark, folder, "documents").withColumnRenamed("source", "subreddit")
    return filters.matching_query(docs.join(pairs, "subreddit"), "query", "text").select("doc_id", "asset_id", "query")


@add("""WITH m AS (SELECT 'D' || CAST(doc_id AS VARCHAR) AS asset_id, source AS subreddit, string_split("text", ' ')[1] AS a, string_split("text", ' ')[3] AS b FROM documents),
t AS (SELECT *, lower(regexp_replace(a, '^\\s+|\\s+$', '', 'g')) AS x, lower(regexp_replace(b, '^\\s+|\\s+$', '', 'g')) AS y FROM m WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT doc_id, t.asset_id, a || ' OR ' || b AS query FROM documents d JOIN t ON d.source = t.subreddit
WHERE x <> '' AND contains(lower(d."text"), x) OR y <> '' AND contains(lower(d."text"), y)""")
def keyword_index_matches(spark, folder):
    """One mapping per document, of two words of its text, matched with the texts of its source through the index."""
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("subreddit"), "text")
    word = lambda n: F.get(F.split("text", " ", 4), n - 1)
    query = F.concat(word(1), F.lit(" OR "), word(3))
    pairs = docs.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("asset_id"), "subreddit", query.alias("query")).filter("query IS NOT NULL")
    return keywords.matching_pairs(docs, pairs, "doc_id", ["text"], on="subreddit", whole=False).select("doc_id", "asset_id", "query")


@add(f"""WITH {MAPPING}, seen AS (SELECT lang AS l, source, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60) AS t FROM documents)
SELECT asset_id, subreddit, coalesce(query, asset_id) AS query FROM mapping m WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source = m.subreddit AND 'NATION_' || CAST(length(s.source) * 3 AS VARCHAR) = m.asset_id
  AND t >= TIMESTAMP '2024-01-01' AND t < TIMESTAMP '2024-01-02')""")
def pairs_to_fetch(spark, folder):
    """Asset and subreddit pairs without rows extracted on the day."""
    docs = articles(spark, folder).select(
        F.concat(F.lit("NATION_"), (F.length("source") * 3).cast("string")).alias("asset_id"), F.col("source").alias("subreddit"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("_id") * 60).alias("extraction_timestamp_utc"),
    )
    pairs = forum.pairs_to_fetch(mapping(spark, folder), docs, F.lit("2024-01-01 12:00:00").cast("timestamp"))
    return pairs.select("asset_id", "subreddit", "query")


@add("""SELECT event_id AS _id, event_type AS asset_id, 's' || CAST(user_id % 4 AS VARCHAR) AS subreddit FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-01-30'
QUALIFY row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts DESC, event_id DESC) <= 10""")
def newest_per_subreddit(spark, folder):
    """The ten newest recent rows per asset and subreddit."""
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("_id"), F.col("event_type").alias("asset_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("subreddit"), F.col("ts").alias("created_at_utc"),
    )
    recent = windows.newest_per_pair(rows, F.lit("2024-01-30").cast("timestamp"), within="10 DAYS")
    return recent.select("_id", "asset_id", "subreddit")


# -- retention -------------------------------------------------------------------------------

CUTOFF = f"TIMESTAMP '{AGED_AS_OF}' - INTERVAL 7 DAY"
FLOOR_SQL = f"""
w AS (SELECT a.*, m.asset_id IS NOT NULL AS mapped, coalesce(created_at_utc < {CUTOFF}, FALSE) AS old FROM aged a LEFT JOIN assets m USING (asset_id)),
c AS (SELECT *, count(*) OVER p AS total, count(*) FILTER (old) OVER p AS old_n, row_number() OVER (PARTITION BY asset_id, old ORDER BY created_at_utc DESC NULLS LAST, _id DESC) AS rn FROM w WINDOW p AS (PARTITION BY asset_id)),
floored AS (SELECT * FROM c WHERE NOT (mapped AND old AND rn > greatest(0, 20 - (total - old_n))))"""


@add(f"WITH {AGED_POSTS}, {ASSETS}, {FLOOR_SQL} SELECT _id, asset_id, {sql_show('created_at_utc')} AS created FROM floored")
def retention_with_floor(spark, folder):
    """Old rows dropped, but a minimum kept per mapped asset."""
    cutoff = _as_of() - F.expr("INTERVAL 7 DAYS")
    kept = windows.retention_with_floor(aged_posts(spark, folder), assets(spark, folder), cutoff, floor=20)
    return kept.select("_id", "asset_id", show("created_at_utc").alias("created"))


@add(f"WITH {AGED_POSTS} SELECT _id, asset_id FROM aged WHERE NOT (asset_id IS NULL AND coalesce(created_at_utc < {CUTOFF}, FALSE))")
def unkeyed_purge(spark, folder):
    cutoff = _as_of() - F.expr("INTERVAL 7 DAYS")
    return dml.purge_unkeyed(aged_posts(spark, folder), assets(spark, folder), cutoff).select("_id", "asset_id")


@add(f"WITH {AGED_POSTS}, {ASSETS}, {FLOOR_SQL} SELECT _id, asset_id FROM floored WHERE NOT (asset_id IS NULL AND old)")
def forum_clean_up(spark, folder):
    """Retention with floor, then the purge of rows without an asset."""
    return forum.clean(aged_posts(spark, folder), assets(spark, folder), _as_of(), days=7, floor=20).select("_id", "asset_id")


@add(f"WITH {AGED_POSTS} SELECT asset_id, count(*) AS total, count(*) FILTER (created_at_utc < {CUTOFF}) AS old, count(*) FILTER (created_at_utc IS NULL) AS undated FROM aged GROUP BY 1")
def retention_counts(spark, folder):
    ts = F.col("created_at_utc")
    return aggregates.counts_by(aged_posts(spark, folder), "asset_id", old=filters.older_than(ts, _as_of(), 7), undated=ts.isNull())


@add(f"WITH {AGED_POSTS} SELECT asset_id, count(*) AS submissions FROM aged WHERE asset_id IS NOT NULL GROUP BY 1")
def fetch_summary(spark, folder):
    return aggregates.fetch_summary(filters.with_values(aged_posts(spark, folder), "asset_id"), "asset_id")


@add(f"WITH {AGED_POSTS} SELECT DISTINCT asset_id FROM aged")
def distinct_assets(spark, folder):
    return aggregates.distinct_values(aged_posts(spark, folder), "asset_id")


@add(f"""WITH {AGED_POSTS} SELECT _id, asset_id IS DISTINCT FROM 'view-1' AS not_view_1, subreddit IN ('click', 'error') AS listed,
  asset_id IS NULL OR asset_id NOT IN ('view-2', 'click-3') AS not_listed, created_at_utc IS NOT NULL AND created_at_utc BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AS that_day FROM aged""")
def set_predicates(spark, folder):
    """Not-equal and not-in keep missing fields; ranges are closed."""
    at = lambda t: F.lit(t).cast("timestamp")
    a, ts = F.col("asset_id"), F.col("created_at_utc")
    return aged_posts(spark, folder).select(
        "_id", filters.differs(a, "view-1").alias("not_view_1"), F.col("subreddit").isin("click", "error").alias("listed"),
        filters.none_of(a, ["view-2", "click-3"]).alias("not_listed"),
        F.coalesce(ts.between(at("2024-01-05"), at("2024-01-06")), F.lit(False)).alias("that_day"),
    )


@add(f"WITH {AGED_POSTS} SELECT _id, subreddit FROM aged WHERE created_at_utc IS NOT NULL AND asset_id IS NULL")
def find_with_projection(spark, folder):
    wanted = F.col("created_at_utc").isNotNull() & F.col("asset_id").isNull()
    return filters.find(aged_posts(spark, folder), wanted, "_id", "subreddit")


@add(f"WITH {MAPPING}, hits AS (SELECT d.doc_id, m.asset_id, m.subreddit FROM documents d JOIN mapping m ON d.source = m.subreddit WHERE m.query IS NOT NULL AND (contains(lower(d.\"text\"), lower(string_split(m.query, ' OR ')[1])) OR contains(lower(d.\"text\"), lower(string_split(m.query, ' OR ')[2])))) SELECT doc_id AS _id, asset_id, subreddit FROM hits QUALIFY row_number() OVER (PARTITION BY asset_id, subreddit ORDER BY doc_id DESC) <= 10")
def wanted_submissions(spark, folder):
    """The ten newest matching posts of every pair that is due."""
    pairs = joins.fan_out(filters.with_values(mapping(spark, folder), "asset_id", "query"))
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("subreddit"), F.col("text").alias("title"), F.lit("").alias("selftext"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("created_at_utc"),
    )
    matched = filters.matching_query(docs.join(pairs, "subreddit"), "query", "title", "selftext")
    newest = windows.newest_per_pair(matched.drop("title", "selftext"), F.lit("2030-01-01").cast("timestamp"), within="3650 DAYS")
    return newest.select("_id", "asset_id", "subreddit")
