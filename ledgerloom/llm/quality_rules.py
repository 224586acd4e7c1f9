"""Quality rules, line first, in DataFrame functions only.

Every line is judged on its own: a line without a letter or digit, a navigation line
(three or more separators), a boilerplate line, a line of symbols, or a short line
without closing punctuation fails.  Failing lines are removed; a document that
loses more than half of its word characters so, or fails the base rules (under 50
words, or over half of its words in repeated three-word windows), is rejected.

One narrow pass: no shuffle, no Python.  Repeated windows are counted by hashing each
window, sorting (hash, position) within the row, and summing what the repeated
windows cover, so a long text costs n log n.

Edge cases: a null text has no words and is rejected; empty tables give empty
results; repeated rows are judged alike; columns of the input named like an output
are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import shared

# The words and limits of the rules.
SPACE = r"[\x20\x09-\x0D]"
WORDY = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_LOST_PERCENT = 50
SHORT_LINE_WORDS = 6
NAVIGATION = r"([|»›·•].*){3}"
BOILERPLATE = r"(?i)(all rights reserved|copyright ©|cookie policy|privacy policy|terms of (use|service)|enable javascript|licensed under|released under the|is licensed under|sign up for|subscribe to our|click here)"
#: A text without one of these, in small letters, has no boilerplate line.
BOILERPLATE_MARKS = ("rights reserved", "copyright ©", "policy", "terms of ", "javascript", "licensed under", "released under", "sign up for", "subscribe to", "click here")
CLOSED = "[.!?:;…\"'»”’)\\]]" + r"[\x20\x09-\x0D]*$"
SYMBOL_RUN = r"[#*$%&|<>]{2}"


def _line_fails(line: Column, boilerplate: Column) -> Column:
    """`boilerplate`: may a line of the text be of that kind?"""
    words = F.regexp_count(line, F.lit(WORDY + "+"))
    return (
        ((words < SHORT_LINE_WORDS) & ~line.rlike(CLOSED))
        | (boilerplate & line.rlike(BOILERPLATE))
        | line.rlike(NAVIGATION)
        | ((F.regexp_count(line, F.lit(SYMBOL_RUN)) * 100) > words * 30)
        | ~line.rlike(r"[\p{L}\p{N}]")
    )


def rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Appends the statistics, `base_failed`, `clean_text`, `n_lines_removed` and `kept`."""
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_lines_removed", "kept"]
    keep = [c for c in docs.columns if c not in own]
    left = shared.fresh(docs, "_left")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # What passes through is one column, so that its names meet none of the steps'.
    passed = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    step = docs.select(passed.alias("_row"), t.alias("_t"))
    step = step.select("_row", "_t", reduce(lambda a, w: a | F.lower("_t").contains(w), BOILERPLATE_MARKS, F.lit(False)).alias("_b"), F.array_remove(F.split("_t", SPACE + "+"), "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORDY)).alias("_l"))
    n = F.size("_w")
    window = lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2))
    step = step.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), window)).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window; only those that do are sorted.
    step = step.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    same = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])
    step = step.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    step = step.withColumn("_k", F.filter("_l", lambda x: ~_line_fails(x, F.col("_b"))))
    step = step.select(
        *(F.col("_row").getField(c).alias(c) for c in keep),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join("_k", "\n").alias("clean_text"),
        (F.size("_l") - F.size("_k")).cast("long").alias("n_lines_removed"),
        F.length(F.array_join(F.split(F.array_join("_k", "\n"), SPACE + "+"), "")).alias(left),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    enough = F.col(left) * 100 >= F.col("word_chars") * (100 - MOST_LOST_PERCENT)
    return step.withColumns({"base_failed": failed, "kept": ~failed & enough}).drop(left)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the statistics and verdicts of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
k AS (SELECT r, list_filter(l, lambda x: NOT (regexp_matches(x, '([|»›·•].*){3}')
        OR regexp_matches(x, '(?i)(all rights reserved|copyright ©|cookie policy|privacy policy|terms of (use|service)|enable javascript|licensed under|released under the|is licensed under|sign up for|subscribe to our|click here)')
        OR len(regexp_extract_all(x, '[#*$%&|<>]{2}')) * 100 > len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) * 30
        OR (len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) < 6 AND NOT regexp_matches(x, '[.!?:;…"''»”’)\]][\x20\x09-\x0D]*$'))
        OR NOT regexp_matches(x, '[\p{L}\p{N}]'))) AS k FROM w),
s AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) - len(k) AS BIGINT) AS n_lines_removed,
        length(regexp_replace(array_to_string(k, chr(10)), '[\x20\x09-\x0D]', '', 'g')) AS kept_chars
      FROM w JOIN k USING (r) LEFT JOIN n USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND kept_chars * 100 >= word_chars * 50) AS kept, n_lines_removed FROM b
"""
