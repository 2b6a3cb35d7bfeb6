"""Operator 8: quality rules, one table of thresholds compiled into one projection of built-in functions.

Words are runs of characters other than space and tab to carriage return. Repeated words are found per row: the
3-word windows of a text are hashed to 62 bits, joined with their position into one number, sorted, and equal
neighbours mark their words. (Two different windows of one text of n words share a hash with a chance of n^3 / 2^63.)

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged each; a null doc_id
is kept as it is; other columns of the input stay in ``apply_rules``, and the metrics replace columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are as with at by an be this from or "
    "der die und das ist von zu den mit sich ein eine nicht auf des im dem es "
    "le la les et que en un une est pour dans qui par pas sur plus ce "
    "el los las y se del con su al lo como no o de"
).split()
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A ratio of two metrics, and the closed range in which a text is kept."""

    name: str
    above: str
    below: str
    low: float | None = None
    high: float | None = None


#: The verdict of a text is that all of these hold. Ratios with a denominator of zero count as zero.
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("dup_line_share", "n_dup_lines", "n_lines", None, 0.4),
    Rule("words_per_line", "n_words", "n_lines", 1.5, None),
)
MIN_WORDS = 50
MAX_REPEATED = 50


def let(value: Column, use) -> Column:
    """use(value), with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more in the text."""

    def windows(w: Column, n: Column) -> Column:
        def key(i: Column) -> Column:
            h = F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit((1 << 62) - 1))
            return F.call_function("div", h, n) * n + i

        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), key)

    def covered(keys: Column, n: Column) -> Column:
        """Words under repeated windows; keys are sorted, and key div n is the window's hash, key % n its place."""
        groups = F.transform(keys, lambda k: F.call_function("div", k, n))
        as_next = let(groups, lambda g: F.zip_with(g, F.slice(g, 2, F.size(g)), lambda a, b: F.equal_null(a, b)))
        place = let(
            as_next,
            lambda e: F.zip_with(
                keys, F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: a | b), lambda k, f: F.when(f, k % n)
            ),
        )
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).cast("long").alias("last"))
        return F.aggregate(
            F.sort_array(F.array_compact(place)), start,
            lambda a, p: F.struct((a["sum"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("sum"), p.alias("last")),
            lambda a: a["sum"],
        )

    def count(w: Column) -> Column:
        n = (F.size(w) - 2).cast("long")
        return let(n, lambda n: let(F.sort_array(windows(w, n)), lambda keys: covered(keys, n)))

    return F.when(F.size(words) >= 3, count(words)).otherwise(F.lit(0)).cast("long")


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def metrics() -> Column:
    """The metrics of the rules, as one struct."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of(text: Column, w: Column, x: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(x).cast("long").alias("n_lines"),
            F.size(F.filter(w, lambda v: F.lower(v).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: let(_lines(t), lambda x: of(t, w, x))))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])


def holds(rule: Rule, m: Column) -> Column:
    ratio = F.when(m[rule.below] == 0, F.lit(0.0)).otherwise(m[rule.above].cast("double") / m[rule.below].cast("double"))
    low = F.lit(True) if rule.low is None else ratio >= rule.low
    return low & (F.lit(True) if rule.high is None else ratio <= rule.high)


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    passed = ~base_failed(m)
    for rule in rules:
        passed = passed & holds(rule, m)
    return passed


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the metrics, ``base_failed`` and ``kept``.

    The verdict is made inside the struct of the metrics: a filter on ``kept`` that Spark moves before the projection then
    works the metrics out once, not once for each rule that names them.
    """
    judged = let(metrics(), lambda m: F.struct(*(m[n].alias(n) for n in METRICS), base_failed(m).alias("base_failed"), verdict(m, rules).alias("kept")))
    held = docs.withColumn("_metrics", judged)
    return held.withColumns({n: F.col("_metrics")[n] for n in (*METRICS, "base_failed", "kept")}).drop("_metrics")


RESULT = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_rules(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return apply_rules(docs).select(*RESULT)


def _sql_rule(rule: Rule) -> str:
    ratio = f"(CASE WHEN {rule.below} = 0 THEN 0 ELSE {rule.above}::DOUBLE / {rule.below}::DOUBLE END)"
    parts = [f"{ratio} >= {rule.low}" if rule.low is not None else "", f"{ratio} <= {rule.high}" if rule.high is not None else ""]
    return " AND ".join(p for p in parts if p)


#: Metrics of every row of ``documents``, numbered by ``rid``.
SQL_METRICS = rf"""
SELECT rid, doc_id, text, lang, source, n_chars, len(w)::BIGINT AS n_words,
       length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
       (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       coalesce(covered, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
       len(list_filter(w, lambda v: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(v))))::BIGINT AS n_stop_words
FROM (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents))
LEFT JOIN (
  SELECT rid, count(DISTINCT p) AS covered FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, a) AS n FROM (
        SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS a FROM (
          SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM (
            SELECT row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents))))
    WHERE n > 1)
  GROUP BY rid) USING (rid)"""
SQL_BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)"
SQL_KEPT = f"(NOT {SQL_BASE_FAILED} AND {' AND '.join(_sql_rule(r) for r in RULES)})"
OP8_SQL = f"""SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {SQL_BASE_FAILED} AS base_failed,
{SQL_KEPT} AS kept FROM ({SQL_METRICS})"""
