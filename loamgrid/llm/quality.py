"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: a short line needs a closing mark, and no line may be made of separators (navigation), of signs, of
shouting, or hold a boilerplate phrase. Lines that fail are removed; a document that loses too much of its text is rejected, as is
one that fails the base rules on its whole text.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import others

#: White space that separates words.
SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
#: Marks that close a sentence, signs that count as symbols, phrases of boilerplate (lower case).
CLOSING = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")")
SYMBOLS = "#*$%&|<>"
PHRASES = ("all rights reserved", "terms of use", "privacy policy", "cookie policy", "use of cookies", "enable javascript", "lorem ipsum", "click here", "sign up for", "log in to", "share this page")

MIN_WORDS = 50
#: Characters of a line that needs no closing mark; characters a separator, a sign, a "!!" stand for; least share of text kept.
SHORT, PER_SEPARATOR, PER_SIGN, PER_SHOUT, KEEP_SHARE = 60, 25, 12, 16, 0.5


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def line_passes(line: Column) -> Column:
    """Whether a line passes all rules; counts are held against the line's length in characters."""
    size = F.length(line)
    punctuated = (size >= SHORT) | F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1)).isin(*CLOSING)
    navigation = (occurrences(line, "|") + occurrences(line, " > ")) * PER_SEPARATOR > size
    signs = sum((occurrences(line, s) for s in "%*$&#"), F.lit(0)) * PER_SIGN > size
    shouting = occurrences(line, "!!") * PER_SHOUT > size
    holds = lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in PHRASES))
    boilerplate = F.exists(F.array(F.lower(line)), holds)  # lower-cased once
    return punctuated & ~navigation & ~signs & ~shouting & ~boilerplate


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in windows of `width` words that occur twice or more.

    Windows are hashed to 64 bits and sorted with their positions; equal neighbours repeat. Of the sorted positions each covers what
    the one before left open, so the work is that of two sorts, whatever repeats.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.struct(F.xxhash64(*(F.get(words, i + k) for k in range(width))).alias("h"), i.alias("i")))
    return F.when(F.size(words) >= width, F.sort_array(windows))


def covered(sorted_windows: Column, width: int = 3) -> Column:
    twice = F.filter(sorted_windows, lambda x, j: (x["h"] == F.get(sorted_windows, j - 1)["h"]) | (x["h"] == F.get(sorted_windows, j + 1)["h"]))
    positions = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    total = F.aggregate(positions, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")))
    return F.coalesce(total["n"], F.lit(0)).cast("long")


OWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "clean_text")


def assess(docs: DataFrame) -> DataFrame:
    """docs' columns (but for those named like the operator's own) with the counts of the whole text, the verdicts, and the clean text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long); base_failed: under 50 words, or over half of the words in
    repeated windows; n_lines, n_lines_removed; clean_text: the lines that pass (null if text is null); kept: not base_failed and at
    least half of the characters of lines with a word are in lines that pass. Null text counts as empty: zero counts, base_failed.
    Rows that repeat are judged alike, one by one; nothing is shuffled.
    """
    base = docs.select(*others(docs, *OWN, "_text", "_words", "_lines", "_good", "_windows"), F.coalesce("text", F.lit("")).alias("_text"))
    words = base.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), "")).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(rf"[^\x20\x09-\x0D]"))))
    windows = words.withColumn("_windows", repeated_words(F.col("_words"))).withColumn("_good", F.filter("_lines", line_passes))
    counted = windows.select(
        *others(docs, *OWN, "_text", "_words", "_lines", "_good", "_windows"),
        "_lines",
        "_good",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("_windows")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = F.length(F.array_join("_good", "")) >= KEEP_SHARE * F.length(F.array_join("_lines", ""))
    return counted.select(
        *others(docs, *OWN, "_text", "_words", "_lines", "_good", "_windows"),
        *OWN[:5],
        failed.alias("base_failed"),
        (~failed & share).alias("kept"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_lines_removed"),
        F.when(F.col("text").isNotNull(), F.array_join("_good", "\n")).alias("clean_text"),
    )


def oracle() -> str:
    """DuckDB SQL for op4."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    count = lambda part: f"((length(l) - length(replace(l, {quote(part)}, ''))) // {len(part)})"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    phrases = " OR ".join(f"contains(lower(l), {quote(p)})" for p in PHRASES)
    passes = (
        f"(length(l) >= {SHORT} OR right(rtrim(l, {blanks}), 1) IN ({', '.join(map(quote, CLOSING))})) AND NOT (({count('|')} + {count(' > ')}) * {PER_SEPARATOR} > length(l)) "
        f"AND NOT (({' + '.join(count(s) for s in '%*$&#')}) * {PER_SIGN} > length(l)) AND NOT ({count('!!')} * {PER_SHOUT} > length(l)) AND NOT ({phrases})"
    )
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
     w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS ws,
                  list_filter(string_split(x, chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS ls FROM t),
     p AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
     g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
     c AS (SELECT r, count(DISTINCT j) AS n_repeat FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
     a AS (SELECT r, doc_id, x, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                  CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, ls FROM w),
     f AS (SELECT a.*, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN c ON a.r = c.r),
     b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                  list_filter(ls, lambda l: {passes}) AS good FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND length(array_to_string(good, '')) >= {KEEP_SHARE} * length(array_to_string(ls, '')) AS kept,
       CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(good) AS BIGINT) AS n_lines_removed
FROM b
"""
