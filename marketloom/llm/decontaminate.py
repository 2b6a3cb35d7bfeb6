"""Operator 5: benchmark decontamination with built-in functions only.

Words are runs of 0-9, a-z, A-Z (lower-cased) and characters beyond ASCII. A window is 10 consecutive words of a benchmark
item, or the whole item if it has fewer. Each document's windows are hashed in its own row and looked up in the hash set
of the benchmark's windows; the few that are found are compared word by word with the item's windows before they count.

The hash set is sent to the executors only when the items have at most ``SET_LIMIT`` windows in all (counted first);
beyond, the documents' window hashes are joined with the benchmark's in a shuffle, with the same result.

Defined results: null and empty texts have no words; repeated rows are judged each; a null doc_id keeps its row; items
without words or with a null item_id are no items; repeated items count once per item_id; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

WINDOW = 10
#: Benchmark windows up to which their hashes and texts go into each task (about 100 bytes each, 2 MB).
SET_LIMIT = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
FOUND = "array<struct<at:int,n:int,gram:string>>"


#: Lower-cased words of ``text``; only A-Z change case. A text of ASCII alone takes the faster function.
WORDS_SQL = (
    "transform(array(coalesce(CAST(text AS STRING), '')), t -> regexp_extract_all("
    f"CASE WHEN length(t) = octet_length(t) THEN lower(t) ELSE translate(t, '{UPPER}', '{LOWER}') END, r'{WORD}', 0))[0]"
)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, gram, key): the windows of each item, their number of words, text and hash."""
    items = benchmark.where("item_id is not null").select("item_id", F.expr(WORDS_SQL).alias("w")).where("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    each = items.select("item_id", n.alias("n"), F.explode(grams).alias("gram")).distinct()
    return each.withColumn("key", F.xxhash64(F.split("gram", " ")))


def _hashes(words: Column, n: int) -> Column:
    """Hash of each run of n words, in order."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n))),
    ).otherwise(F.array().cast("array<bigint>"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SET_LIMIT) -> DataFrame:
    """docs with ``n_words`` and ``found``: place (word), length and text of every benchmark window in the document."""
    grams = item_windows(benchmark, window).select("n", "gram", "key").distinct()
    # At most limit + 1 rows reach the driver.
    known = grams.limit(limit + 1).collect()
    if len(known) > limit:
        return _find_by_join(docs, grams)
    parts = [_found_sql([r for r in known if r.n == n], n) for n in sorted({r.n for r in known})]
    found = f"concat({', '.join([f'CAST(array() AS {FOUND})', *parts])})"
    # The words are bound inside the expression: a filter on it, pushed down to the scan, still splits a text once.
    held = docs.withColumn(
        "_hit",
        F.expr(
            f"transform(array({WORDS_SQL}), _w -> named_struct('n_words', CAST(size(_w) AS BIGINT), 'found', {found}))[0]"
        ),
    )
    return held.withColumns({"n_words": F.col("_hit.n_words"), "found": F.col("_hit.found")}).drop("_hit")


def _found_sql(known: list, n: int) -> str:
    """The expression that finds windows of n words in ``_w``: as SQL text, so that thousands of constants are one call.

    A window is looked for around its longest word only, because no other place can hold it. Words hold no quote or
    backslash, so they are constants as they are.
    """
    text = lambda values: ", ".join(f"'{x}'" for x in values)
    anchors = text(sorted({max(r.gram.split(" "), key=len) for r in known}))
    near = f"array_compact(transform(_w, (x, p) -> IF(x IN ({anchors}), p, NULL)))"
    starts = f"array_distinct(flatten(transform({near}, p -> sequence(greatest(p - {n - 1}, 0), least(p, size(_w) - {n})))))"
    places = f"filter({starts}, i -> xxhash64(slice(_w, i + 1, {n})) IN ({', '.join(f'{r.key}L' for r in known)}))"
    windows = f"transform({places}, i -> named_struct('at', i, 'n', {n}, 'gram', array_join(slice(_w, i + 1, {n}), ' ')))"
    verified = f"filter({windows}, f -> f.gram IN ({text(r.gram for r in known)}))"
    return f"CASE WHEN size(_w) >= {n} THEN {verified} ELSE CAST(array() AS {FOUND}) END"


def _window(at: Column, n: Column, gram: Column) -> Column:
    return F.struct(at.cast("int").alias("at"), n.cast("int").alias("n"), gram.alias("gram"))


def _find_by_join(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The way for a benchmark of any size."""
    lengths = [r.n for r in grams.select("n").distinct().collect()]  # at most ``window`` numbers
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_w", F.expr(WORDS_SQL)), "words")

    def keyed(n: int) -> Column:
        return F.transform(_hashes(F.col("_w"), n), lambda h, i: F.struct(i.alias("at"), F.lit(n).alias("n"), h.alias("key")))

    parts = [keyed(n) for n in lengths]
    none = F.array().cast("array<struct<at:int,n:int,key:bigint>>")
    each = rows.select("_row", F.explode(F.concat(none, *parts)).alias("f")).select("_row", "f.at", "f.n", "f.key")
    met = each.join(grams, ["n", "key"]).groupBy("_row").agg(F.collect_set(_window(F.col("at"), F.col("n"), F.col("gram"))).alias("_met"))
    right = lambda f: F.array_join(F.slice(F.col("_w"), f["at"] + 1, f["n"]), " ") == f["gram"]
    checked = F.filter(F.coalesce(F.col("_met"), F.array().cast(FOUND)), right)
    return rows.join(met, "_row", "left").withColumns({"n_words": F.size("_w").cast("long"), "found": checked}).drop("_row", "_w", "_met")


def words_hit(found: Column) -> Column:
    """Words under at least one of the windows."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))

    def add(a: Column, f: Column) -> Column:
        end = f["at"] + f["n"]
        return F.struct((a["sum"] + F.greatest(F.lit(0), end - F.greatest(f["at"], a["end"]))).alias("sum"), F.greatest(a["end"], end).alias("end"))

    return F.aggregate(F.sort_array(found), start, add, lambda a: a["sum"]).cast("long")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SET_LIMIT) -> DataFrame:
    """The documents without any benchmark window, with the columns they had."""
    marked = find(docs.select(F.struct("*").alias("_doc"), "text"), benchmark, window, limit)
    return marked.where(F.size("found") == 0).select("_doc.*")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = SET_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = find(docs.select("doc_id", "text"), benchmark, window, limit)
    rows = marked.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", words_hit(F.col("found")).alias("n_hit"),
        F.array_distinct(F.transform("found", lambda f: f["gram"])).alias("grams"),
    ).select("row", "doc_id", "n_words", "n_hit", F.explode_outer("grams").alias("gram"))
    # Documents without a hit get keys of their own, which match nothing and spread over all tasks.
    rows = rows.withColumn("gram", F.coalesce("gram", F.concat(F.lit("- "), F.col("row").cast("string"))))
    items = rows.join(item_windows(benchmark, window).select("gram", F.col("item_id").cast("string").alias("item")), "gram", "left")
    each = items.groupBy("row", "doc_id", "n_words", "n_hit").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return each.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_decontamination(spark, folder: str) -> DataFrame:
    return report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
#: Windows of documents that some item holds: (rid, i, n, item_id); ``d`` are the numbered documents with their words.
SQL_HITS = f"""
b AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
        SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (
          SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL)
          WHERE len(w) > 0))),
g AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
        SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
hits AS (SELECT rid, i, n, item_id FROM g JOIN b USING (n, gram))"""
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents), {SQL_HITS},
places AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)"""
