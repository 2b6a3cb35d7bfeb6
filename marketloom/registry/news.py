"""Article, enrichment and vector queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates, enrich, filters, joins, vectors, windows
from ..plans import news
from ..session import run_folder, spread_scan
from ..sources import readers, tables
from .base import Registry
from .views import ARTICLES, TICKERS, articles, even, show, sql_even, sql_show, table, tickers

news_queries = Registry()
add = news_queries.add

# Words that do occur in the given texts, so that the scores differ.
GOOD = ("the", "and", "le", "und", "que", "los")
BAD = ("of", "with", "la", "die", "et", "para")
DIM = 64
SQL_SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def embed():
    return enrich.hashed_vectors(DIM)


def sql_words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{SQL_SPACE}'), lambda w: w <> '')"


STRING = "'Headline: ' || coalesce(headline, '') || chr(10) || '/n Description: ' || coalesce(description, '') || chr(10) || '/n Source: ' || coalesce(source, '') || chr(10) || '/n Ticker: ' || coalesce(ticker, '') || chr(10) || '/n Link: ' || coalesce(link, '')"


def _string():
    return text.article_string(*[F.col(c) for c in ("headline", "description", "source", "ticker", "link")])


# -- cards ---------------------------------------------------------------------------

NAV = r"""<a href="([^"]*)">([^<]*)</a>"""


def _result_pages(spark, folder):
    """Search result pages made of the navigation links of the given pages; a
    link text that ends in a comma yields a card without a redirect target."""
    pages = spread_scan(table(spark, folder, "pages"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    host = F.regexp_extract("url", "://([^/]*)/", 1)
    hrefs = F.regexp_extract_all("html", F.lit(NAV), F.lit(1))
    names = F.regexp_extract_all("html", F.lit(NAV), F.lit(2))

    def card(link, i):
        target = F.url_encode(F.concat(F.col("url"), link["href"]))
        tail = F.when(link["name"].endswith(","), F.lit("/XX=2")).otherwise(F.lit("/RK=2/RS=x"))
        return F.concat(
            F.lit('<div class="dd NewsArticle"><h4 class="s-title fz-16"><a class="t" href="https://r.example/RU='),
            target, tail, F.lit('">'), link["name"], F.lit('</a></h4><span class="mr-5 s-source">'), F.col("host"),
            F.lit('</span><span class="fc-2nd s-time mr-8">· '), i.cast("string"),
            F.lit(' hours ago </span><p class="s-desc">  '), F.col("title"), F.lit(" <b>x</b>\n</p></div>"),
        )

    links = F.arrays_zip(hrefs.alias("href"), names.alias("name"))
    shaped = pages.select("page_id", "url", title.alias("title"), host.alias("host"), links.alias("links"))
    body = F.array_join(F.transform("links", card), "\n")
    return shaped.select("page_id", F.col("url").alias("ticker"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


def _sql_plain(c: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{char}')"
    return c


CARDS = f"""
links AS (SELECT page_id, url, regexp_extract(url, '://([^/]*)/', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  unnest(regexp_extract_all(html, '{NAV}', 1)) AS href, unnest(regexp_extract_all(html, '{NAV}', 2)) AS name, generate_subscripts(regexp_extract_all(html, '{NAV}', 1), 1) - 1 AS i FROM pages),
cards AS (SELECT page_id, i AS card_no, url AS ticker, {_sql_plain('name')} AS headline, host AS source, CAST(i AS VARCHAR) || ' hours ago' AS posted,
  regexp_replace({_sql_plain("title || ' x'")}, '^\\s+|\\s+$', '', 'g') AS description, CASE WHEN name NOT LIKE '%,' THEN url || href END AS link,
  FALSE AS synced, '2024-02-01 00:00:00' AS extracted FROM links)"""

CARD_COLUMNS = ["page_id", "card_no", "ticker", "headline", "source", "posted", "description", "link", "synced"]


def _cards(spark, folder):
    return readers.article_cards(_result_pages(spark, folder), "html", "ticker", F.lit("2024-02-01").cast("timestamp"))


def _card_rows(df, *extra):
    return df.select(*[F.col(c).cast("long").alias(c) if c == "card_no" else F.col(c) for c in CARD_COLUMNS], show("extraction_timestamp_utc").alias("extracted"), *extra)


@add(f"WITH {CARDS} SELECT *, link IS NOT NULL AS complete FROM cards")
def article_cards(spark, folder):
    """Cards parsed out of result pages."""
    return _card_rows(_cards(spark, folder), "complete")


@add(f"WITH {CARDS} SELECT * FROM cards WHERE ticker NOT IN (SELECT ticker FROM cards WHERE link IS NULL)")
def accepted_cards(spark, folder):
    """Cards of tickers without a broken card."""
    return _card_rows(readers.accepted_cards(_cards(spark, folder)))


@add(r"""WITH a AS (SELECT page_id, url, string_split(html, '<article>')[2] AS card FROM pages WHERE contains(html, '<article>')),
p AS (SELECT page_id, url, regexp_extract(card, '(?s)<h1>(.*?)</h1>', 1) AS headline, regexp_extract_all(card, '(?s)<p>(.*?)</p>', 1)[1] AS description, contains(card, '</h1>') AS has_h FROM a),
c AS (SELECT page_id, url, CASE WHEN has_h THEN regexp_replace(headline, '<[^>]*>', '', 'g') END AS headline, regexp_replace(description, '<[^>]*>', '', 'g') AS description FROM p)
SELECT page_id, url AS ticker, replace(replace(replace(replace(headline, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS headline,
  regexp_replace(replace(replace(replace(replace(description, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '^\s+|\s+$', '', 'g') AS description,
  headline IS NOT NULL AND description IS NOT NULL AS complete FROM c""")
def page_cards(spark, folder):
    """The articles of the given pages as cards, by selectors of their own markup."""
    pages = table(spark, folder, "pages")
    fields = {"headline": ("h1", None), "description": ("p", None)}
    rows = readers.article_cards(pages, "html", "url", F.lit("2024-02-01").cast("timestamp"), start="<article>", fields=fields, link=None)
    return rows.filter("card_no = 0").select("page_id", "ticker", "headline", "description", "complete")


@add("SELECT page_id, url || '+%zz#%' AS link FROM pages")
def redirect_links(spark, folder):
    href = F.concat(F.lit("https://r.example/RU="), F.url_encode("url"), F.lit("+%zz%23%/RK=1/RS=2"))
    return table(spark, folder, "pages").select("page_id", text.unwrap_link(href).alias("link"))


# -- article table ------------------------------------------------------------------------


@add(f"WITH {ARTICLES} SELECT _id, {STRING} AS article_string FROM articles")
def article_text(spark, folder):
    return articles(spark, folder).select("_id", _string().alias("article_string"))


@add(f"WITH {ARTICLES} SELECT _id, ticker, link FROM articles WHERE _id IN (SELECT min(_id) FROM articles GROUP BY ticker, link)")
def article_dedupe(spark, folder):
    return windows.dedupe_keep_first(articles(spark, folder)).select("_id", "ticker", "link")


@add(f"WITH {ARTICLES}, g AS (SELECT *, count(*) OVER (PARTITION BY ticker, link) AS copies, min(_id) OVER (PARTITION BY ticker, link) AS kept_id FROM articles) SELECT ticker, link, copies, kept_id, _id FROM g WHERE copies > 1")
def duplicate_articles(spark, folder):
    """Every copy of a repeated link, with the group's size and surviving id."""
    return aggregates.duplicate_rows(articles(spark, folder), ["ticker", "link"], "_id")


@add(f"""WITH {ARTICLES}, {TICKERS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY extraction_timestamp_utc DESC NULLS LAST, _id DESC) AS rn FROM articles)
SELECT _id, ticker, {sql_show('extraction_timestamp_utc')} AS extracted FROM r WHERE rn <= 100 OR ticker NOT IN (SELECT ticker FROM tickers)""")
def article_cap(spark, folder):
    """The newest hundred of every mapped ticker; other tickers stay whole."""
    rows = windows.cap_newest(articles(spark, folder), tickers(spark, folder))
    return rows.select("_id", "ticker", show("extraction_timestamp_utc").alias("extracted"))


def _scored_articles(spark, folder, *, heavy=False):
    """Articles with a stored score where the document is labelled."""
    docs = articles(spark, folder, heavy=heavy)
    labels = table(spark, folder, "labels")
    score = F.struct(
        F.col("quality").cast("double").alias("positive"), F.col("toxic").cast("double").alias("negative"),
        (F.lit(1.0) - F.greatest("quality", "toxic")).alias("neutral"),
    )
    joined = docs.join(labels, docs["_id"] == labels["doc_id"], "left")
    return joined.select(docs["*"], F.when(F.col("doc_id").isNotNull(), score).alias("sentiment_score"))


SCORED = (
    ARTICLES
    + """,
scored AS (SELECT a.*, CASE WHEN l.doc_id IS NOT NULL THEN {'positive': CAST(quality AS DOUBLE), 'negative': CAST(toxic AS DOUBLE), 'neutral': 1.0::DOUBLE - greatest(quality, toxic)} END AS sentiment_score
  FROM articles a LEFT JOIN labels l ON a._id = l.doc_id)"""
)


@add(f"WITH {SCORED} SELECT _id, ticker FROM scored WHERE sentiment_score IS NULL")
def unscored_articles(spark, folder):
    rows = _scored_articles(spark, folder)
    return filters.find(rows, filters.not_enriched("sentiment_score"), "_id", "ticker")


@add(f"WITH {SCORED} SELECT _id, ticker FROM scored WHERE sentiment_score IS NULL ORDER BY _id LIMIT 100")
def next_unscored_batch(spark, folder):
    """The first ``max_documents`` rows that still need a score."""
    rows = _scored_articles(spark, folder).filter(filters.not_enriched("sentiment_score"))
    return windows.latest_rows(rows, [F.col("_id")], 100).select("_id", "ticker")


def _sql_scores(c: str) -> str:
    good = ", ".join(f"'{w}'" for w in GOOD)
    bad = ", ".join(f"'{w}'" for w in BAD)
    return f"""words AS (SELECT *, {sql_words(f'lower({c})')} AS w FROM %s),
counted AS (SELECT *, len(w) AS n, len(list_filter(w, lambda t: t IN ({good}))) AS g, len(list_filter(w, lambda t: t IN ({bad}))) AS b FROM words)"""


@add(f"""WITH {ARTICLES}, {_sql_scores('description') % 'articles'}
SELECT _id, {sql_even('(g + 1) / CAST(n + 3 AS DOUBLE)', 9)} AS positive, {sql_even('(b + 1) / CAST(n + 3 AS DOUBLE)', 9)} AS negative, {sql_even('(n - g - b + 1) / CAST(n + 3 AS DOUBLE)', 9)} AS neutral
FROM counted WHERE description <> '' """)
def article_sentiment(spark, folder):
    """Word-list scores of whole texts."""
    rows = articles(spark, folder, heavy=True).withColumn("s", enrich.lexicon_scores(F.col("description"), GOOD, BAD))
    return rows.filter("s IS NOT NULL").select("_id", *[even(F.col(f"s.{c}"), 9).alias(c) for c in enrich.LABELS])


@add(f"""WITH {SCORED}, {TICKERS} SELECT ticker, count(*) AS articles, round(CAST(avg(sentiment_score.positive) AS DOUBLE), 6) AS positive,
  round(CAST(avg(sentiment_score.negative) AS DOUBLE), 6) AS negative, round(CAST(avg(sentiment_score.neutral) AS DOUBLE), 6) AS neutral
FROM scored JOIN tickers USING (ticker) WHERE sentiment_score IS NOT NULL GROUP BY 1""")
def sentiment_by_ticker(spark, folder):
    """Mean stored sentiment of the mapped tickers."""
    rows = _scored_articles(spark, folder).join(tickers(spark, folder), "ticker")
    return aggregates.average_sentiment(rows, "ticker")


@add(f"""WITH {SCORED}, fresh AS (SELECT doc_id AS _id, 'q' || CAST(quality AS VARCHAR) AS source FROM labels)
SELECT s._id, coalesce(f.source, s.source) AS source, s.ticker FROM scored s LEFT JOIN fresh f ON s._id = f._id""")
def update_by_id(spark, folder):
    """A column set by id from a batch of updates."""
    updates = table(spark, folder, "labels").select(F.col("doc_id").alias("_id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return joins.update_by_id(articles(spark, folder).select("_id", "source", "ticker"), updates, "_id", ["source"])


@add(f"""WITH {SCORED}, t AS (SELECT *, {sql_words('description')} AS w FROM scored)
SELECT count(*) AS processed, count(*) FILTER (sentiment_score IS NOT NULL) AS successful, count(*) FILTER (sentiment_score IS NULL) AS failed,
  count(*) FILTER (description <> '') AS requests, CAST(sum(len(w) + length(description) // 20) AS BIGINT) AS tokens FROM t""")
def enrichment_statistics(spark, folder):
    return aggregates.batch_statistics(_scored_articles(spark, folder, heavy=True), "description", "sentiment_score")


@add("""SELECT doc_id, CAST(quality AS DOUBLE) AS positive, CAST(toxic AS DOUBLE) AS negative, 1.0::DOUBLE - greatest(quality, toxic) AS neutral FROM labels""")
def label_scores(spark, folder):
    """Classifier output as (label, score) pairs to a struct by label."""
    q, t = F.col("quality").cast("double"), F.col("toxic").cast("double")
    pair = lambda name, c: F.struct(F.lit(name).alias("label"), c.alias("score"))
    entries = F.array(pair("Neutral", F.lit(1.0) - F.greatest(q, t)), pair("POSITIVE", q), pair("negative", t))
    rows = table(spark, folder, "labels").select("doc_id", enrich.label_scores(entries).alias("s"))
    return rows.select("doc_id", *[F.col(f"s.{c}") for c in enrich.LABELS])


# -- vectors -------------------------------------------------------------------------------


def sql_vectors(source: str, key: str, c: str) -> str:
    """Hashed word counts of a text column as (key, pos, value) rows."""
    return f"""
tok AS (SELECT {key}, unnest({sql_words(f'lower({c})')}) AS t FROM {source}),
cnt AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {DIM} AS pos, count(*) AS n FROM tok GROUP BY 1, 2),
nrm AS (SELECT {key}, sqrt(CAST(sum(n * n) AS DOUBLE)) AS l FROM cnt GROUP BY 1),
vec AS (SELECT {key}, pos, CAST(CAST(n / l AS FLOAT) AS DOUBLE) AS v FROM cnt JOIN nrm USING ({key}))"""


@add(f"""WITH {ARTICLES}, strings AS (SELECT _id, {STRING} AS s FROM articles), {sql_vectors('strings', '_id', 's')}
SELECT _id, pos, {sql_even('v', 6)} AS value FROM vec""")
def article_embeddings(spark, folder):
    """Vectors of the article texts, as their non-zero components."""
    rows = articles(spark, folder, heavy=True).select("_id", _string().alias("article_string"), F.lit(None).cast("array<float>").alias("article_embedding"))
    filled = enrich.embed_missing(rows, "article_string", "article_embedding", embed())
    parts = filled.select("_id", F.posexplode("article_embedding").alias("pos", "v")).filter("v <> 0")
    return parts.select("_id", F.col("pos").cast("long").alias("pos"), even(F.col("v").cast("double"), 6).alias("value"))


@add(f"""WITH {SCORED}, strings AS (SELECT _id, {STRING} AS s FROM scored WHERE sentiment_score IS NOT NULL), {sql_vectors('strings', '_id', 's')}
SELECT s._id, count(pos) AS components, {sql_even('coalesce(max(v), 0)', 6)} AS largest FROM scored s LEFT JOIN vec ON s._id = vec._id GROUP BY 1""")
def embeddings_recreated(spark, folder):
    """All vectors dropped and computed anew where there is a text."""
    rows = _scored_articles(spark, folder, heavy=True).select(
        "_id", F.when(F.col("sentiment_score").isNotNull(), _string()).alias("article_string"),
        F.array(F.lit(1.0).cast("float")).alias("article_embedding"),
    )
    fresh = news.recreate_embeddings(rows, embed())
    v = F.coalesce("article_embedding", F.array().cast("array<float>"))
    return fresh.select(
        "_id", F.size(F.filter(v, lambda x: x != 0)).cast("long").alias("components"),
        even(F.coalesce(F.array_max(v).cast("double"), F.lit(0.0)), 6).alias("largest"),
    )


@add("""WITH shaped AS (SELECT vec_id, CASE label WHEN 3 THEN embedding[1:63] WHEN 4 THEN list_transform(embedding, lambda x: x * 2) WHEN 5 THEN NULL ELSE embedding END AS v FROM embeddings)
SELECT vec_id, CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <> 64 THEN 'wrong dimension'
  WHEN abs(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) > 1e-3 THEN 'not unit length' END AS problem FROM shaped""")
def vector_problems(spark, folder):
    """Vectors that break the declared dimension or unit length."""
    e = F.col("embedding")
    shaped = (
        F.when(F.col("label") == 3, F.slice(e, 1, 63))
        .when(F.col("label") == 4, F.transform(e, lambda x: x * F.lit(2).cast("float")))
        .when(F.col("label") == 5, F.lit(None))
        .otherwise(e)
    )
    return table(spark, folder, "embeddings").select("vec_id", enrich.vector_problem(shaped, 64).alias("problem"))


@add("""WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY 1, 2),
q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY pos) AS qv FROM means GROUP BY 1),
s AS (SELECT query_id, vec_id, round_even(list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) * 1e6, 0) / 1e6 AS score FROM embeddings CROSS JOIN q)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def nearest_to_topics(spark, folder):
    """The ten vectors nearest to the mean vector of every label."""
    corpus = table(spark, folder, "embeddings")
    queries = vectors.mean_vectors(corpus, "label", "embedding")
    found = vectors.nearest(corpus, queries, 10, row_id="vec_id", vector="embedding", dim=64)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@add("""WITH v AS (SELECT vec_id, 'article-' || CAST(vec_id AS VARCHAR) AS _id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q._id AS query_id, v._id, round_even(list_cosine_similarity(v.e, q.e) * 1e6, 0) / 1e6 AS score FROM v JOIN v AS q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, _id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, _id) AS rank FROM s QUALIFY rank <= 5""")
def nearest_articles(spark, folder):
    """The five articles nearest to every hundredth one, itself left out; ids are texts as in the article table."""
    name = F.concat(F.lit("article-"), F.col("vec_id").cast("string"))
    corpus = table(spark, folder, "embeddings").select("vec_id", name.alias("_id"), "embedding")
    queries = corpus.filter("vec_id % 100 = 0").select(F.col("_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.nearest(corpus, queries, 5, row_id="_id", vector="embedding", dim=64, exclude_self=True)
    return found.select("query_id", "_id", "score", F.col("rank").cast("long").alias("rank"))


@add("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round_even(list_cosine_similarity(v.e, q.e) * 1e6, 0) / 1e6 AS score FROM v JOIN v AS q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def nearest_in_blocks(spark, folder):
    """The ten vectors nearest to every hundredth one, by blocks of a few queries against parts of the corpus, as any
    number of queries is searched."""
    corpus = table(spark, folder, "embeddings")
    queries = corpus.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = vectors.nearest(corpus, queries, 10, row_id="vec_id", vector="embedding", dim=64, exclude_self=True, pass_bytes=64 * 8 * 4)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


# -- the whole refresh -----------------------------------------------------------------------


@add(f"""WITH {ARTICLES}, {TICKERS}, uniq AS (SELECT *, {STRING} AS article_string FROM articles WHERE _id IN (SELECT min(_id) FROM articles GROUP BY ticker, link)),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY extraction_timestamp_utc DESC NULLS LAST, _id DESC) AS rn FROM uniq) WHERE rn <= 100 OR ticker NOT IN (SELECT ticker FROM tickers)),
{_sql_scores('article_string') % 'kept'}
SELECT _id, ticker, md5(article_string) AS text_md5, {sql_even('(g + 1) / CAST(n + 3 AS DOUBLE)', 9)} AS positive, CAST({DIM} AS BIGINT) AS vector_size FROM counted""")
def news_refresh(spark, folder):
    """Dedupe, texts, vectors, sentiment and the cap, over stored and fetched rows."""
    full = articles(spark, folder, heavy=True).select(
        "*", F.lit(None).cast("string").alias("article_string"), F.lit(None).cast("array<float>").alias("article_embedding"),
        F.lit(None).cast("struct<positive:double,negative:double,neutral:double>").alias("sentiment_score"),
    )
    known = F.col("source").isin("src0", "src1", "src2", "src3", "src4")
    scores = partial(enrich.lexicon_scores, positive=GOOD, negative=BAD)
    kept = news.refresh(full.filter(known), full.filter(~known), tickers(spark, folder), embed(), scores=scores)
    return kept.select(
        "_id", "ticker", F.md5("article_string").alias("text_md5"), even(F.col("sentiment_score.positive"), 9).alias("positive"),
        F.size("article_embedding").cast("long").alias("vector_size"),
    )


def _sql_refresh(out: str, stored: str | None, fetched: str) -> str:
    """CTEs of one refresh: rows fetched anew, the first of each link, the newest hundred of mapped tickers."""
    both = f"SELECT * FROM {fetched}" if stored is None else f"SELECT * FROM {stored} UNION ALL SELECT * FROM {fetched} WHERE _id NOT IN (SELECT _id FROM {stored})"
    return f"""{out}_all AS ({both}),
{out}_once AS (SELECT * FROM {out}_all WHERE _id IN (SELECT min(_id) FROM {out}_all GROUP BY ticker, link)),
{out} AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY extraction_timestamp_utc DESC NULLS LAST, _id DESC) AS rn FROM {out}_once)
  WHERE rn <= 100 OR ticker NOT IN (SELECT ticker FROM tickers))"""


STORED_SOURCES = ("src0", "src1", "src2", "src3", "src4")


@add(f"""WITH {ARTICLES}, {TICKERS}, named AS (SELECT * REPLACE (lpad(CAST(_id AS VARCHAR), 12, '0') AS _id) FROM articles),
known AS (SELECT * FROM named WHERE source IN {STORED_SOURCES}), later AS (SELECT * FROM named WHERE source NOT IN {STORED_SOURCES}),
{_sql_refresh('first', None, 'known')}, {_sql_refresh('second', 'first', 'later')}, {_sql_refresh('third', 'second', 'later')},
strings AS (SELECT *, {STRING} AS article_string FROM third), {_sql_scores('article_string') % 'strings'}, {sql_vectors('strings', '_id', 'article_string')},
found AS (SELECT _id, count(*) AS components, max(v) AS v FROM vec GROUP BY 1)
SELECT _id, ticker, link, {sql_show('extraction_timestamp_utc')} AS extracted, md5(article_string) AS text_md5,
  {sql_even('(g + 1) / CAST(n + 3 AS DOUBLE)', 9)} AS positive, components, {sql_even('v', 6)} AS largest FROM counted JOIN found USING (_id)""")
def article_increments(spark, folder):
    """The article table after a first load, an increment and the same increment again, each a new version of the buckets
    that it touches."""
    full = articles(spark, folder, heavy=True).select(
        F.lpad(F.col("_id").cast("string"), 12, "0").alias("_id"), "headline", "source", F.lit(None).cast("string").alias("posted"),
        "description", "link", F.lit(False).alias("synced"), "extraction_timestamp_utc", "ticker",
        F.lit(None).cast("string").alias("article_string"), F.lit(None).cast("array<float>").alias("article_embedding"),
        F.lit(None).cast("struct<positive:double,negative:double,neutral:double>").alias("sentiment_score"),
    )
    known = F.col("source").isin(*STORED_SOURCES)
    stored = tables.article_table(run_folder(spark, "articles"), buckets=16)
    tables.create(spark, stored)
    scores = partial(enrich.lexicon_scores, positive=GOOD, negative=BAD)
    for batch in (full.filter(known), full.filter(~known), full.filter(~known)):
        news.store(spark, batch, stored, tickers(spark, folder), embed(), scores=scores)
    rows = tables.read(spark, stored)
    return rows.select(
        "_id", "ticker", "link", show("extraction_timestamp_utc").alias("extracted"), F.md5("article_string").alias("text_md5"),
        even(F.col("sentiment_score.positive"), 9).alias("positive"),
        F.size(F.filter("article_embedding", lambda x: x != 0)).cast("long").alias("components"),
        even(F.array_max("article_embedding").cast("double"), 6).alias("largest"),
    )
