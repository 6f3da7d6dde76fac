"""Operator 6: line-first cleaning with built-in functions only.

Every line with a word is judged by three rules: it ends without closing punctuation and is
no long paragraph; it is navigation (several separators, or a short line with a menu
phrase); it holds a boilerplate phrase. Failing lines go; a document that loses more than
half of its word characters is rejected.

Repeated three-word windows are found inside a row by comparing 64-bit hashes of the
windows (within one text; Spark's xxhash64). Null text: no words. Empty texts fail the base
rule. Repeated rows are judged alike; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the rules.
WHITE = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"
CLOSERS = [".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]"]
SEPARATORS = "|»›•·>"
MENU_PHRASES = ["sign in", "log in", "sign up", "click here", "read more", "next page", "previous page", "main menu",
                "skip to content", "share this", "home page", "site map", "back to top", "subscribe"]
BOILERPLATE_PHRASES = ["all rights reserved", "cookie policy", "use cookies", "uses cookies", "privacy policy", "terms of use",
                       "terms of service", "enable javascript", "lorem ipsum", "licensed under", "copyright ©", "(c) copyright"]
PARAGRAPH_CHARS, SHORT_LINE_CHARS, SEPARATORS_MOST = 200, 80, 2
MIN_WORDS, REPEAT_PERCENT, LOST_SHARE = 50, 50, 0.5
FEW = 48  # up to so many repeated windows are looked up one by one


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def _any_phrase(line: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(line, F.lit(p)) for p in phrases])


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks one of the three rules."""
    chars, low = F.length(_without(line, WHITE)), F.lower(line)
    unpunctuated = ~F.substring(F.rtrim(line, F.lit(WHITE)), -1, 1).isin(CLOSERS) & (chars < PARAGRAPH_CHARS)
    separators = F.length(line) - F.length(_without(line, SEPARATORS))
    navigation = (separators > SEPARATORS_MOST) | ((chars < SHORT_LINE_CHARS) & _any_phrase(low, MENU_PHRASES))
    return unpunctuated | navigation | _any_phrase(low, BOILERPLATE_PHRASES)


def _covered(starts: Column, width: int) -> Column:
    """Number of positions covered by windows of ``width`` at the ascending ``starts``."""
    gaps = F.transform(starts, lambda s, i: F.least(F.lit(width), F.coalesce(F.try_element_at(starts, i + 2) - s, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)


def _repeated_starts(rows: DataFrame) -> DataFrame:
    """Adds ``starts``: ascending places of the three-word windows found twice or more."""
    hashes = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(1), F.col("n_words") - 2), lambda i: F.xxhash64(
        F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("h", hashes)
    distinct = F.size(F.array_distinct("h"))
    ordered = F.when(distinct < F.size("h"), F.sort_array("h")).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("ordered", ordered)
    twice = F.array_distinct(F.filter("ordered", lambda v, i: v == F.try_element_at("ordered", i + 2)))
    rows = rows.withColumn("twice", twice)
    places = F.filter(F.transform("h", lambda v, i: F.when(F.array_contains("twice", v), i)), lambda p: p.isNotNull())
    # many different repeats: sort windows with their places and keep those equal to a neighbour
    pairs = F.sort_array(F.transform("h", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    rows = rows.withColumn("pairs", F.when(F.size("twice") > FEW, pairs))
    beside = F.filter("pairs", lambda p, i: (p["v"] == F.try_element_at("pairs", i + 2)["v"])
                      | ((i > 0) & (p["v"] == F.element_at("pairs", F.greatest(i, F.lit(1)))["v"])))
    many = F.sort_array(F.transform(beside, lambda p: p["i"]))
    none = F.array().cast("array<int>")
    return rows.withColumn("starts", F.when(F.size("twice") == 0, none).when(F.size("twice") <= FEW, places).otherwise(many)).drop(
        "h", "ordered", "twice", "pairs")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and clean_text (lines that pass, by newline)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("words", word_list(F.col("text")))
    rows = rows.withColumn("n_words", F.size("words"))
    rows = _repeated_starts(rows).drop("words")
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda l: F.length(_without(l, WHITE)) > 0))
    rows = rows.withColumn("good", F.filter("lines", lambda l: ~line_fails(l)))
    chars = F.length(_without(F.col("text"), WHITE)).cast("bigint")
    left = F.aggregate("good", F.lit(0).cast("bigint"), lambda a, l: a + F.length(_without(l, WHITE)))
    repeated = F.least(_covered(F.col("starts"), 3), F.col("n_words").cast("bigint"))
    counted = rows.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), chars.alias("word_chars"),
                          (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
                          (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                          repeated.alias("n_repeat_words"), left.alias("left_chars"), F.array_join("good", "\n").alias("clean_text"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words"))
    lost = F.col("word_chars") - F.col("left_chars")
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (lost <= F.col("word_chars") * F.lit(LOST_SHARE))).drop("left_chars")


def oracle() -> str:
    """DuckDB SQL for ``judge`` without clean_text."""
    quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    phrases = lambda ps: " OR ".join(f"contains(lower(l), {quoted([p])})" for p in ps)
    bare = r"regexp_replace({}, '[\x09-\x0D\x20]', '', 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
x AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r),
n AS (SELECT r, count(*) AS n_words FROM w GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
l AS (SELECT r, l, length({bare.format('l')}) AS c FROM l0 WHERE length({bare.format('l')}) > 0),
f AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, sum(CASE WHEN
  (right(rtrim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1) NOT IN ({quoted(CLOSERS)}) AND c < {PARAGRAPH_CHARS})
  OR length(l) - length(translate(l, '{SEPARATORS}', '')) > {SEPARATORS_MOST}
  OR (c < {SHORT_LINE_CHARS} AND ({phrases(MENU_PHRASES)})) OR {phrases(BOILERPLATE_PHRASES)} THEN c ELSE 0 END) AS lost FROM l GROUP BY r),
b AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length({bare.format('t')}) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r) LEFT JOIN f USING (r)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND lost <= word_chars * {LOST_SHARE} AS kept FROM s"""
