"""Measuring a statement: columns from clustered edges, grammars, dates and currencies by vote (F2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import amounts as A


def sample_pages(n: int, want: int = 20) -> list[int]:
    """SC12: all pages of a short file; else the first three, last two, and evenly spaced ones."""
    if n <= want:
        return list(range(1, n + 1))
    picks = {1, 2, 3, n - 1, n}
    step = max(1, n // max(1, want - len(picks)))
    return sorted(picks | set(range(1, n + 1, step)))[:want]


def edge_clusters(edges: DataFrame, keys: list[str], x: str = "x", tolerance: float = 3.0) -> DataFrame:
    """WN04: (keys, cluster, lo, hi, n): sorted edges, a new cluster where the gap to the one before passes the tolerance."""
    w = Window.partitionBy(*keys).orderBy(x)
    e = edges.withColumn("_new", F.coalesce((F.col(x) - F.lag(x).over(w) > tolerance).cast("int"), F.lit(0)))
    e = e.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return e.groupBy(*keys, "cluster").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"))


def merged_clusters(clusters: DataFrame, keys: list[str], gap: float = 10.0) -> DataFrame:
    """WN05: neighbours at most `gap` apart become one; counts add up."""
    w = Window.partitionBy(*keys).orderBy("lo")
    c = clusters.withColumn("_hi", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("_new", F.coalesce((F.col("lo") - F.col("_hi") > gap).cast("int"), F.lit(0))).withColumn("merged", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return c.groupBy(*keys, "merged").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def number_vote(tokens: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """AG12: us and eu counts of each group and the style; `tie` is left to the caller to refuse."""
    us, eu = (F.count_if(A.cleaned(F.col(token)).rlike(p)) for p in (A.US, A.EU))
    v = tokens.groupBy(*keys).agg(us.alias("us"), eu.alias("eu"), F.count("*").alias("n"))
    return v.withColumn("style", F.when((F.col("n") == 0) | (F.col("us") > F.col("eu")), "us").when(F.col("us") < F.col("eu"), "eu").otherwise("tie"))


def date_vote(tokens: DataFrame, keys: list[str], token: str = "token", ord_: str = "ord") -> DataFrame:
    """AG14: the dominant separator, first seen on ties, and the order that the first decisive date shows."""
    t = tokens.withColumn("sep", F.regexp_extract(token, r"^[0-9]+([./-])", 1)).withColumn("_p", F.split(token, "[./-]"))
    seps = t.groupBy(*keys, "sep").agg(F.count("*").alias("n"), F.min(ord_).alias("first"))
    best = seps.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))).where("_r = 1").select(*keys, "sep")
    head, middle = (F.try_element_at("_p", F.lit(k)) for k in (1, 2))
    order = F.when(F.length(head) == 4, "ymd").when(head.try_cast("int") > 12, "dmy").when(middle.try_cast("int") > 12, "mdy")
    decided = t.join(best, [*keys, "sep"]).withColumn("order", order)
    return decided.groupBy(*keys, "sep").agg(F.coalesce(F.min_by("order", F.when(F.col("order").isNotNull(), F.col(ord_))), F.lit("dmy")).alias("date_order"))


def currency_hits(cells: DataFrame, keys: list[str], token: str = "token", x: str = "x") -> DataFrame:
    """AG15: currency codes with their counts and extents."""
    return cells.withColumn("code", A.currency_of(F.col(token))).where("code IS NOT NULL").groupBy(*keys, "code").agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def header_score(cells: Column, words: list[str]) -> Column:
    """PF15: 10 for each distinct column word (by six letters), less 25 for each amount and 5 for a colon; null under two words."""
    low = F.transform(cells, lambda c: F.left(F.lower(c), F.lit(6)))
    hits = F.size(F.array_intersect(F.array_distinct(low), F.array(*(F.lit(w[:6].lower()) for w in words))))
    money = F.size(F.filter(cells, lambda c: A.is_money_shaped(c)))
    return F.when(hits >= 2, hits * 10 - money * 25 - F.exists(cells, lambda c: c.contains(":")).cast("int") * 5)


def column_scores(tokens: DataFrame, keys: list[str], style: str, totals: DataFrame | None = None) -> DataFrame:
    """AG17, JN19: (keys, cluster): count, negative and positive sums of each column, constant columns dropped, printed totals confirmed."""
    # A token is read once, as a key; tokens that are no amounts stay until the sums, since a filter on the key would read each again.
    v = tokens.groupBy(*keys, "cluster", A.amount_or_null(F.col("token"), style).alias("v")).agg(F.count("*").alias("_n"))
    zero = F.lit(0).cast("decimal(38,2)")
    sums = (F.col("v") * F.col("_n").cast("decimal(19,0)")).cast("decimal(38,2)")
    c = v.groupBy(*keys, "cluster").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("_n"))).alias("n"), F.sum(F.when(F.col("v") < 0, -sums).otherwise(zero)).cast("decimal(38,2)").alias("negative"), F.sum(F.when(F.col("v") > 0, sums).otherwise(zero)).cast("decimal(38,2)").alias("positive"), F.count("v").alias("distinct"))
    c = c.where("distinct > 1 OR n = 1")
    if totals is None:
        return c.withColumn("confirmed", F.lit(False))
    # The totals of a group are few: the columns meet them as one list, and are not made twice.
    printed = totals.groupBy(*keys).agg(F.collect_set("total").alias("_totals"))
    near = lambda a: F.exists("_totals", lambda x: F.abs(F.abs(x) - F.col(a)) < 0.01)
    return c.join(printed, keys, "left").withColumn("confirmed", F.coalesce(near("positive") | near("negative"), F.lit(False))).drop("_totals")


def top_columns(clusters: DataFrame, keys: list[str], width: float, most: int = 3) -> DataFrame:
    """TK03: the fullest clusters of the right 45 % of the page, at least 3 and 15 % of the fullest, by position."""
    c = clusters.where(F.col("hi") >= width * 0.55).withColumn("_top", F.max("n").over(Window.partitionBy(*keys)))
    c = c.where(F.col("n") >= F.greatest(F.lit(3.0), F.col("_top") * 0.15)).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "lo"))).where(F.col("_r") <= most)
    return c.drop("_top", "_r").orderBy(*keys, "lo")


def nearest_headers(clusters: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """JN22: the header word whose right edge is nearest to each cluster's, not more than 120 to its left.

    A page's header words meet its clusters as one list.  Both are shuffled before they
    are gathered: clusters hardly repeat, so a table of those of a whole input split
    would only take memory.
    """
    words = headers.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("x1", "text")).alias("_words"))
    c = clusters.select(*keys, "cluster", "lo", "hi", "n").repartition(*keys).distinct()
    near = F.filter("_words", lambda w: w["x1"] >= F.col("lo") - 120)
    ranked = F.transform(near, lambda w: F.struct(F.abs(w["x1"] - F.col("hi")), w["x1"].alias("_x"), w["text"].alias("text")))
    best = c.join(words, keys).withColumn("_best", F.array_min(ranked)).where("_best IS NOT NULL")
    return best.select(*keys, "cluster", "lo", "hi", "n", F.col("_best.text").alias("header"))


def glued(loose: DataFrame, tight: DataFrame) -> DataFrame:
    """JN21: right edges at which a tighter tokenisation reads another text; the last text of an edge counts."""
    last = lambda df, name: df.groupBy("page", F.round("x1", 1).alias("edge")).agg(F.max_by("text", "ord").alias(name))
    return last(loose, "loose").join(last(tight, "tight"), ["page", "edge"]).where("loose <> tight")


def best_header(rows: DataFrame, keys: list[str], words: list[str], cells: str = "cells", ord_: str = "ord") -> DataFrame:
    """TK02: (keys, ord, score): the row of the best positive header score, the first of equal ones; groups without one have no row."""
    s = rows.withColumn("score", header_score(F.col(cells), words)).where("score > 0")
    return s.groupBy(*keys).agg(F.min_by(ord_, F.struct(-F.col("score"), ord_)).alias(ord_), F.max("score").alias("score"))


def column_arithmetic(clusters: DataFrame, keys: list[str], width: float) -> DataFrame:
    """AG16: groups with exactly three big columns, by position, of which the first two have as many amounts as the third.

    Big are columns with 3 amounts at least and 15 % of the fullest, in the right 45 %
    of the page or, where it has none, on the whole page.
    """
    per = Window.partitionBy(*keys)
    right = F.col("hi") >= width * 0.55
    c = clusters.withColumn("_right", right).withColumn("_any", F.max("_right").over(per)).where("_right OR NOT _any")
    c = c.withColumn("_top", F.max("n").over(per)).where(F.col("n") >= F.greatest(F.lit(3.0), F.col("_top") * 0.15))
    c = c.withColumn("_k", F.row_number().over(per.orderBy("lo"))).withColumn("_many", F.count("*").over(per)).where("_many = 3")
    n = [F.max(F.when(F.col("_k") == k, F.col("n"))).alias(f"n{k}") for k in (1, 2, 3)]
    return c.groupBy(*keys).agg(*n).where("n1 + n2 = n3")


def row_starts(rows: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """AG18: rows with money, rows that begin with a date, and `amount` where the latter are over 1.3 times the former."""
    c = F.col(cells)
    dated = F.coalesce(F.try_element_at(c, F.lit(1)).rlike(r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$"), F.lit(False))
    g = rows.groupBy(*keys).agg(F.count_if(F.exists(c, lambda x: A.is_money_shaped(x))).alias("amount_rows"), F.count_if(dated).alias("date_rows"))
    return g.withColumn("row_start", F.when(F.col("date_rows") * 10 > F.col("amount_rows") * 13, "amount"))


def date_edges(edges: DataFrame, keys: list[str], x: str = "x", ord_: str = "ord") -> DataFrame:
    """AG19: (keys, bucket, edge): the five-point bucket with most date edges, the first seen of equal ones, and the last edge within 6 of it."""
    e = edges.withColumn("bucket", (F.bround(F.col(x) / 5) * 5).cast("int"))
    b = e.groupBy(*keys, "bucket").agg(F.count("*").alias("_n"), F.min(ord_).alias("_first"))
    b = b.groupBy(*keys).agg(F.min_by("bucket", F.struct(-F.col("_n"), "_first")).alias("bucket"))
    return e.drop("bucket").join(b, keys).where(F.abs(F.col(x) - F.col("bucket")) <= 6).groupBy(*keys, "bucket").agg(F.max(x).alias("edge"))


def tabular_preview(rows: DataFrame, keys: list[str], cells: str = "cells", row_no: str = "row_no", read: int = 31, shown: int = 25) -> tuple[DataFrame, DataFrame]:
    """SC11: the first rows of a table as `column:text` of their filled cells, and the money-looking cells of each column among the rows read.

    The preview is the feature; `row_no` counts from 1 within a file.
    """
    head = rows.where(F.col(row_no) <= read)
    filled = F.filter(F.transform(cells, lambda c, i: F.when(c != "", F.concat(i.cast("string"), F.lit(":"), F.left(c, F.lit(22))))), lambda c: c.isNotNull())
    lines = head.where(F.col(row_no) <= shown).select(*keys, row_no, F.array_join(filled, " | ").alias("line"))
    each = head.select(*keys, F.posexplode(cells).alias("column", "_cell"))
    return lines, each.where(A.stripped(F.col("_cell")).rlike(A.MONEY_SHAPE)).groupBy(*keys, "column").agg(F.count("*").alias("n"))
