"""Text assembly and clean-up, all as column expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python-style whitespace, which is wider than what SQL trim removes.
SPACE = r"(?U)\s"


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_posted(c: Column) -> Column:
    return strip(F.replace(c, F.lit("·"), F.lit("")))


def unwrap_link(href: Column) -> Column:
    """Target of a redirect link ``…RU=<target>/RK…``; NULL when there is none.

    ``+`` stays a plus and a percent sign without two hex digits stays as it is.
    """
    guarded = F.regexp_replace(F.replace(href, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    target = F.regexp_extract(F.url_decode(guarded), "RU=(.+)/RK", 1)
    return F.nullif(target, F.lit(""))


def article_string(headline: Column, description: Column, source: Column, ticker: Column, link: Column) -> Column:
    # The "/n " separators are part of the fixed format.
    return F.concat(
        F.lit("Headline: "), blank_if_null(headline),
        F.lit("\n/n Description: "), blank_if_null(description),
        F.lit("\n/n Source: "), blank_if_null(source),
        F.lit("\n/n Ticker: "), blank_if_null(ticker),
        F.lit("\n/n Link: "), blank_if_null(link),
    )


def clip(c: Column, size: int | None) -> Column:
    """The first ``size`` characters; None leaves the text whole."""
    return c if size is None else F.substring(c, 1, size)


def clip_with_dots(c: Column, size: int | None) -> Column:
    if size is None:
        return c
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def author_or_deleted(author: Column) -> Column:
    return F.coalesce(author, F.lit("[deleted]"))


def asset_or_unknown(asset: Column) -> Column:
    return F.coalesce(F.nullif(asset, F.lit("")), F.lit("Unknown"))


def query_or_asset(query: Column, asset: Column) -> Column:
    return F.coalesce(query, asset)


def _numbered(comments: Column, label: str, join_word: str, body, k: int | None) -> Column:
    def line(comment: Column, i: Column) -> Column:
        return F.concat(
            F.lit(f"{label} "), (i + 1).cast("string"), F.lit(f" {join_word} "),
            author_or_deleted(comment["author"]), F.lit(": "), body(blank_if_null(comment["body"])),
        )

    return F.transform(comments if k is None else F.slice(comments, 1, k), line)


def embedding_text(doc: Column, *, comment_count: int | None = None) -> Column:
    """Text handed to the embedder, with all comments or the first ``comment_count``; ``doc`` is the submission struct."""
    comments = doc["comments"]
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), blank_if_null(doc["title"])),
        F.concat(F.lit("Content: "), blank_if_null(doc["selftext"])),
        F.concat(F.lit("Subreddit: "), blank_if_null(doc["subreddit"])),
        F.concat(F.lit("Asset: "), blank_if_null(doc["asset_id"])),
    )
    tail = F.concat(
        F.lit("\nComments: "),
        F.array_join(_numbered(comments, "Comment", "by", lambda b: b, comment_count), " | "),
    )
    has_comments = F.coalesce(F.size(comments) > 0, F.lit(False))
    return F.when(doc.isNull(), F.lit("")).otherwise(
        F.concat(head, F.when(has_comments, tail).otherwise(F.lit("")))
    )


def sentiment_text(
    doc: Column, *, content_size: int | None = None, comment_size: int | None = None, comment_count: int | None = None
) -> Column:
    """Text handed to the sentiment scorer; the sizes cut the content and each comment, the count the list of comments."""
    comments = doc["comments"]
    head = F.concat_ws(
        "\n\n",
        F.concat(F.lit("TITLE: "), blank_if_null(doc["title"])),
        F.concat(F.lit("CONTENT: "), clip_with_dots(blank_if_null(doc["selftext"]), content_size)),
        F.concat(F.lit("SUBREDDIT: "), blank_if_null(doc["subreddit"])),
        F.concat(F.lit("ASSET: "), blank_if_null(doc["asset_id"])),
    )
    lines = _numbered(comments, "COMMENT", "BY", lambda b: clip_with_dots(b, comment_size), comment_count)
    tail = F.concat(F.lit("\n\nCOMMENTS SECTION:\n\n"), F.array_join(lines, "\n\n"))
    has_comments = F.coalesce(F.size(comments) > 0, F.lit(False))
    return F.when(doc.isNull(), F.lit("")).otherwise(
        F.concat(head, F.when(has_comments, tail).otherwise(F.lit("")))
    )


def fit_for_scorer(text: Column, limit: int) -> Column:
    """First form of the text that a scorer with ``limit`` characters accepts:
    the whole text, then the title line with the first half of the whole text,
    then the first two sections; NULL when none fits."""
    title = F.regexp_extract(text, r"(?m)^(TITLE:[^\n]*)", 1)
    half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    shorter = F.when(title != "", F.concat(title, F.lit("\n\n"), half)).otherwise(half)
    sections = F.substring_index(text, "\n\n", 2)
    return (
        F.when(F.length(text) <= limit, text)
        .when(F.length(shorter) <= limit, shorter)
        .when(F.length(sections) <= limit, sections)
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    return F.size(words(text)).cast("long") + F.floor(F.length(text) / 20).cast("long")


def query_terms(query: Column) -> Column:
    return F.transform(F.split(query, r"\s+OR\s+"), lambda t: F.lower(strip(t)))


def matches_any(text: Column, terms: Column) -> Column:
    """True when any of the (lower-case) terms occurs in the text."""
    return F.exists(terms, lambda t: F.contains(F.lower(text), t))
