"""Queries of naming, typing, planning, posting and assembly rules on stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import coercion, names as N
from ledgerloom.operators import graph, ledger, lookup, planning, statements as S
from ledgerloom.plans import graph_queries as G


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(k: Column, values: list[str | None]) -> Column:
    """The k-th of the values, in turn."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.pmod(k, F.lit(len(values))) + 1).cast("int"))


WIDGETS = ["Check", "datepicker", "select", "radio", "actorLink", "reference", "edit", "edit", "edit", "edit", None, "toggle"]
KINDS = ["int", "int", "int", "int", "int", "int", "Integer", "decimal", "string", "string", "float", "string"]


def field_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF15-SF19, JN13, GR04: names and types of form fields, references named by the types of the layer."""
    k = F.col("p_partkey")
    options = F.when(k % 24 < 12, N.option_values(F.array(*(F.struct(F.lit(t).alias("title"), F.lit(v).cast("string").alias("value")) for t, v in (("One", "1"), ("a,b", None), ("Two", ""), ("c", "x]")))))).otherwise(F.array().cast("array<string>"))
    kind = N.field_type(_one_of(k, WIDGETS), _one_of(k, KINDS), F.pmod(k, F.lit(12)) == 8, F.when(k % 24 < 12, k % 7), options)
    field = F.concat(F.when(k % 3 == 0, "item_").when(k % 3 == 1, "FullName").otherwise("a-"), k)
    title = F.concat(F.initcap("p_name"), F.lit(" of  the Whole World"))
    fields = _table(spark, sf_dir, "part").select(k.alias("part"), N.field_slug(field, title).alias("name"), kind.alias("type"))
    forms = spark.createDataFrame([(k, f"form{k}") for k in (0, 1, 2, 3)], "form_id long, slug string")
    return graph.resolve_refs(fields, forms)


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF24-SF25, SF27, SF41, SF43, PF13, PF23: one-line texts, paths without marks, addresses, durations, ids."""
    k = F.col("c_custkey")
    path = F.concat(F.lit("Top @ab12 > "), "c_name", F.when(k % 2 == 0, F.lit(" @0a1b2c")).otherwise(""))
    h = F.md5(k.cast("string"))
    return _table(spark, sf_dir, "customer").select(
        k.alias("k"), N.shortened(F.concat(F.lit(" a\n b "), F.repeat("c_name", (k % 6).cast("int")))).alias("short"),
        N.without_discriminators(path).alias("bare"), N.path_title(path).alias("title"), N.renamed_path(path, F.lit("New")).alias("renamed"), N.without_type(F.concat("c_name", F.when(k % 2 == 0, F.lit(" [dto]")).otherwise(""))).alias("untyped"),
        N.duration(F.lit(0.375) + k % 200).alias("took"), N.is_uuid(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.when(k % 2 == 0, F.substring(h, 21, 12)))).alias("full_id"),
        N.is_identity_title(F.concat("c_mktsegment", F.when(k % 3 == 0, F.lit(" (Identity KEY)")).otherwise(""))).alias("identity"),
        N.base_url(F.concat(_one_of(k, ["", " http://", "https://"]), F.lit("host"), k, F.lit("/a?b"))).alias("base"), N.page_address(_one_of(k, ["", "u", None]), _one_of(k, ["s", "s", None])).alias("address"),
    )


def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF20-SF21, PF10: stored keys of multi-form records, their leaf form, and values without blanks and prefixes."""
    k = F.col("c_custkey")
    key = F.concat(F.lit("__form__"), (k % 5).cast("string"), F.lit(":age"))
    data = F.create_map(F.when(k % 3 == 0, F.lit("age")).otherwise(key), k.cast("string"), F.lit("blank"), F.lit("  "), F.lit("zero"), F.lit("0"))
    c = _table(spark, sf_dir, "customer").select(k.alias("k"), data.alias("data"))
    clean = N.clean_values(F.col("data"))
    return c.select("k", N.storage_key(F.map_keys("data"), F.lit("age")).alias("stored"), N.storage_key(F.map_keys("data"), F.lit("name")).alias("absent"), N.resolved_form_id(F.map_keys("data"), F.lit(77)).cast("long").alias("form"), F.array_join(F.sort_array(F.map_keys(clean)), ",").alias("names"), clean["age"].alias("age"))


_RAW = [("int", '"5"'), ("int", "5.0"), ("int", "true"), ("number", '"1.5"'), ("number", '"nan"'), ("bool", '"T"'), ("bool", "1"), ("date", '"2024-01-02T03:04:05.678"'), ("date", '"2024-13-01"'), ("date", '"2024-01-02T03:04"'), ("enum[a, b]", '"b"'), ("string", '["x"]'), ("ref(t)", '" A > B "'), ("string", '""')]


def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF22-SF23: raw values coerced to their field's type, or refused."""
    k = F.col("o_orderkey")
    o = _table(spark, sf_dir, "orders").select(k.alias("k"), _one_of(k, [t for t, _ in _RAW]).alias("kind"), _one_of(k, [v for _, v in _RAW]).alias("raw"))
    o = o.withColumn("c", coercion.coerced("kind", "raw"))
    return o.select("k", F.col("c.value").alias("value"), F.col("c.error").isNotNull().alias("failed"), coercion.rendered("raw").alias("text"))


def error_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SF28: messages and codes of error bodies, and those that say that a reference is there already."""
    k = F.col("c_custkey")
    body = _one_of(k, ['{"message": "Ref already exists", "code": "E1"}', '{"error": {"message": "no such id", "code": 7}}', "plain  text", '{"description": "ref is not unique"}'])
    message, code = N.error_parts(F.col("body"))
    return _table(spark, sf_dir, "customer").select(k.alias("k"), body.alias("body")).select("k", message.alias("message"), code.alias("code"), N.is_duplicate_ref(F.when(F.col("k") % 8 < 4, 409).otherwise(500), F.col("body")).alias("duplicate"))


def field_names_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN09: names of a type's fields made unique against all taken so far."""
    f = _table(spark, sf_dir, "nation").select((F.col("n_regionkey").cast("string")).alias("slug"), F.col("n_nationkey").cast("int").alias("ord"), _one_of(F.floor(F.col("n_nationkey") / 5), ["a", "a", "a_2", "a", "b"]).alias("name"))
    return graph.deduped_names(f)


def node_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF12: nodes of a type under a part of a path that hold no values and no picture."""
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    nodes = c.select(k.alias("k"), F.lower("c_mktsegment").alias("slug"), F.concat(F.lit("Top > "), "c_name").alias("path"), (k % 2).alias("n_values"), F.when(k % 3 == 0, " ").when(k % 3 == 1, "p").alias("picture"))
    return graph.filtered(nodes, type_="building", under="CUSTOMER#", empty=True, no_picture=True).select("k")


def form_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22: the distinct forms of actors, each with its first title that says something."""
    k = F.col("c_custkey")
    return graph.forms(_table(spark, sf_dir, "customer").select(F.when(k % 11 != 0, k % 10).alias("form_id"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("Form "), k)).alias("form_title"), k.alias("ord")))


def _loops(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    n = _table(spark, sf_dir, "nation")
    nodes = n.select(F.lit("loop").alias("layer"), k.cast("long").alias("ord"), F.concat(F.lit("n"), k).alias("id"), F.col("n_name").alias("title"), k.cast("long").alias("x"), F.lit(0).alias("y"))
    following = F.floor(k / 5) * 5 + (k + 1) % 5
    edges = n.select(F.lit("loop").alias("layer"), k.cast("long").alias("ord"), F.concat(F.lit("n"), k).alias("source"), F.concat(F.lit("n"), following).alias("target"))
    return nodes, edges


def cycle_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR02: loops of five nations that no root reaches, the first of each promoted."""
    return graph.forest(*_loops(spark, sf_dir)).select("id", "parent_id", "depth", "path")


def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GR03: roots named like the paths of other nodes carry their id, and the paths below them too."""
    r, n = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    node = lambda df, p, k, title, y: df.select(F.lit("w").alias("layer"), (F.lit(y * 10**6) + F.col(k)).cast("long").alias("ord"), F.concat(F.lit(p), k).alias("id"), title.alias("title"), F.col(k).cast("long").alias("x"), F.lit(y).alias("y"))
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    nodes = node(r, "r", "r_regionkey", F.col("r_name"), 0).unionByName(node(n, "n", "n_nationkey", F.col("n_name"), 1)).unionByName(node(both, "x", "n_nationkey", F.concat_ws(N.SEPARATOR, "r_name", "n_name"), 2)).unionByName(node(n, "k", "n_nationkey", F.lit("K"), 3))
    edge = lambda p, parent, q: n.select(F.lit("w").alias("layer"), F.col("n_nationkey").cast("long").alias("ord"), F.concat(F.lit(p), parent).alias("source"), F.concat(F.lit(q), "n_nationkey").alias("target"))
    return graph.forest(nodes, edge("r", "n_regionkey", "n").unionByName(edge("x", "n_nationkey", "k"))).select("id", "depth", "path")


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tree and stored records of regions and nations."""
    r, n = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    tree = r.select(F.lit("w").alias("layer"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("path")).unionByName(both.select(F.lit("w").alias("layer"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat_ws(N.SEPARATOR, "r_name", "n_name").alias("path")))
    blank = F.lit("").alias
    record = lambda df, p, k, slug, title: df.select(F.concat(F.lit(p), k).alias("id"), F.lit(slug).alias("slug"), F.col(title).alias("title"), blank("description"), blank("ref"), blank("picture"), F.create_map().cast("map<string,string>").alias("data"), F.lit(False).alias("hole"))
    return tree, record(r, "r", "r_regionkey", "region", "r_name").unionByName(record(n, "n", "n_nationkey", "nation", "n_name"))


def _ops(df: DataFrame, n: str, at: Column, **given: Column) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    shape = {"id": none("string"), "at": at, "type": none("string"), "ref": none("string"), "set": none("map<string,string>"), "rename": none("string"), "describe": none("string"), "picture": none("string")} | given
    return df.select(F.col(n).cast("long").alias("n"), *(c.alias(k) for k, c in shape.items()))


def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN23, JN10: nations renamed to the first name of their region, which another node has."""
    tree, actors = _places(spark, sf_dir)
    n = _table(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_name").alias("first"))
    ops = _ops(n.where("n_nationkey % 2 = 0").join(first, "n_regionkey"), "n_nationkey", F.col("n_name"), rename=F.col("first"))
    fields = spark.createDataFrame([], "slug string, ord int, name string, id string, type string, writable boolean")
    return planning.rename_collisions(planning.plan(ops, tree, actors, fields), tree)


def ref_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, JN09, SF23, PL03: fields that take a record of a type by its path."""
    tree, actors = _places(spark, sf_dir)
    k = F.col("n_nationkey")
    both = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.when(k % 4 == 0, F.concat_ws(N.SEPARATOR, "r_name", "n_name")).when(k % 4 == 1, F.col("r_name")).when(k % 4 == 2, F.lit("nowhere")).otherwise(F.col("n_name"))
    quoted = F.concat(F.lit('"'), value, F.lit('"'))
    ops = _ops(both, "n_nationkey", F.col("n_name"), set=F.when(k % 8 == 7, F.create_map(F.lit("onwer"), quoted)).otherwise(F.create_map(F.lit("owner"), quoted)))
    fields = spark.createDataFrame([("nation", 0, "owner", "own", "ref(nation)", True)], "slug string, ord int, name string, id string, type string, writable boolean")
    p = planning.plan(ops, tree, actors, fields)
    return p.select("n", "mark", F.get(F.col("changes"), F.lit(0))["new"].alias("stored"), "error")


def unsupported_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF19: ops of shapes that are not carried out, or that say too much or nothing."""
    k = F.col("n_nationkey")
    ops = _ops(_table(spark, sf_dir, "nation"), "n_nationkey", F.when(k % 6 != 2, F.col("n_name")), type=F.when(k % 6 == 3, "t"), rename=F.when(k % 6 != 4, "N"))
    ops = ops.withColumns({"under": F.when(F.col("n") % 6 == 0, "top"), "append": F.when(F.col("n") % 6 == 1, F.create_map(F.lit("a"), F.lit("b"))), "create": F.lit(None).cast("string")})
    return ops.select("n", planning.op_errors(ops.columns).alias("error"))


def record_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN11: of several claims on one record the first sound one holds."""
    tree, actors = _places(spark, sf_dir)
    k = F.col("o_orderkey")
    o = _table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0")
    ops = _ops(o, "o_orderkey", F.lit(None).cast("string"), type=F.lit("order"), ref=F.concat(F.lit("c"), "o_custkey"), rename=F.when(k % 12 != 0, "X"))
    return planning.resolve_ops(ops, tree, actors).select("n", "creates", "error")


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG09, AG23: what a plan would do, in numbers."""
    return planning.summary(planning.plan(*G._plan(spark, sf_dir))).select("creates", "writes", "renames", "describes", "holes", "pictures", "satisfied", "errors")


def found_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG08: how many values of the cascade were found."""
    return lookup.tally(G.candidate_cascade(spark, sf_dir))


def want_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: nodes, nodes with holes, missing fields and nodes without a picture."""
    nodes = _table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id")).distinct()
    pictured = _table(spark, sf_dir, "events").where("event_id % 40 = 0").select(F.col("user_id").alias("node_id"))
    return lookup.want_totals(nodes, G.want_list(spark, sf_dir), pictured)


def account_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18: accounts of an actor, name and currency as one row with its two sides."""
    k = F.col("o_orderkey")
    a = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("actor_id"), F.col("o_orderstatus").alias("name_id"), F.lit(1).alias("currency_id"), F.when(k % 2 == 0, "debit").otherwise("credit").alias("income_type"), k.alias("id"), k.alias("ord"))
    return ledger.sides(a)


def account_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LP03: the accounts that entries need, each pair once."""
    c = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("actor"), F.substring("o_orderpriority", 1, 1).alias("currency")).distinct()
    return c.select("actor", "currency", ledger.account_id(F.col("actor"), N.pair_name(" Bank ", 3), F.col("currency"), "debit").alias("debit"), ledger.account_id(F.col("actor"), "Bank", F.col("currency"), "credit").alias("credit"))


def _jobs(spark: SparkSession, sf_dir: str, dry_run: bool) -> tuple[DataFrame, DataFrame]:
    """Rows and entries of orders as five files of JSON lines, of which one has a bad row."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = F.concat(
        F.lit('{"transaction_date": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('", "debit_sum": "'), F.when((F.col("o_orderpriority").startswith("5")), "x").when(k % 2 == 0, price).otherwise("0.00"), F.lit('", "credit_sum": "'), F.when(k % 3 == 0, "1.00").otherwise("0.00"),
        F.lit('", "currency": "EUR", "description": "'), F.when(k % 10 == 0, "same").otherwise(k.cast("string")), F.lit('"'), F.when(k % 7 == 0, ', "uniq_actor_field_value": "none"').when(k % 7 == 1, ', "uniq_actor_field_value": "boss"').otherwise(""), F.lit("}"),
    )
    lines = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("file"), k.alias("line_no"), raw.alias("raw"))
    held = spark.createDataFrame([("b1", "key", "boss", "2024", 1)], "actor_id string, field_id string, value string, created_at string, listing int")
    options = ledger.PostOptions("Bank", actor_id="house", actor_field="key", actor_type="t", dry_run=dry_run)
    rows = ledger.resolved(lines, options, held, "key")
    return rows, ledger.posting(rows, options)


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LP01-LP02, JN06, AG24: records, entries and actors of every job; a file with a bad row posts nothing, others go on."""
    return ledger.job_counts(*_jobs(spark, sf_dir, False))


def dry_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LP04: the sides that a dry run counts, and no duplicates."""
    return ledger.job_counts(*_jobs(spark, sf_dir, True)).select("file", "posted", "duplicate")


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG02, ST01, TK01: all jobs together; failed ones give nothing, actors count once."""
    return ledger.batch_counts(*_jobs(spark, sf_dir, False))


def _sided(spark: SparkSession, sf_dir: str, cells: list[Column]) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    made = F.array(*(F.struct(F.coalesce(c, F.lit("")).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(x)).alias("x1")) for x, c in enumerate(cells)))
    return e.select(F.col("user_id").cast("string").alias("file"), F.lit(1).alias("page"), F.col("event_id").alias("row_no"), F.lit(0.0).alias("top"), F.filter(made, lambda c: c["text"] != "").alias("cells")).repartition("file")  # the table is small, reading its cells is not; assembly has its rows by file anyway


def two_sided_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM4-ASM5: negatives go to the other side; rows with both sides are left out."""
    k = F.col("event_id")
    v = (F.col("value").cast("decimal(18,2)") + F.lit(1)).cast("decimal(18,2)")
    money = F.when((k % 5 == 0) & (k % 7 != 0), -v).otherwise(v).cast("string")
    rows = _sided(spark, sf_dir, [F.col("event_type"), F.when((k % 2 == 0) | (k % 7 == 0), money), F.when((k % 2 == 1) | (k % 7 == 0), money), F.date_format("ts", "dd/MM/yyyy")])
    spec = S.ColumnSpec(debit=S.col(1), credit=S.col(2), description=S.col(0), date=S.col(3), numbers="us", currency_default="EUR")
    return S.transactions(rows, spec).select("file", "line_no", "transaction_date", "debit_sum", "credit_sum", "description")


def one_column_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM6: one amount column; a printed mark beats the sign."""
    k = F.col("event_id")
    v = (F.col("value").cast("decimal(18,2)") + F.lit(1)).cast("decimal(18,2)")
    rows = _sided(spark, sf_dir, [F.col("event_type"), F.when(k % 2 == 0, -v).otherwise(v).cast("string"), F.date_format("ts", "dd/MM/yyyy"), _one_of(k, ["D", "C", None])])
    spec = S.ColumnSpec(amount=S.col(1), sign_band=S.col(3), sign_re_debit="^D$", sign_re_credit="^C$", description=S.col(0), date=S.col(2), numbers="us", currency_default="EUR")
    return S.transactions(rows, spec).select("file", "line_no", "debit_sum", "credit_sum")


def backfilled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASM8-ASM9: currency and actor of a transaction from its first later row that has them."""
    k = F.col("event_id")
    v = (F.col("value").cast("decimal(18,2)") + F.lit(1)).cast("decimal(18,2)").cast("string")
    rows = _sided(spark, sf_dir, [F.col("event_type"), F.when(k % 3 == 0, v), F.when(k % 3 == 0, F.date_format("ts", "dd/MM/yyyy")), F.when(k % 3 == 1, _one_of(F.floor(k / 3), ["USD", "eur"])), F.when(k % 3 == 2, F.concat(F.lit("actor"), k))])
    spec = S.ColumnSpec(debit=S.col(1), description=S.col(0), date=S.col(2), currency=S.col(3), actor=S.col(4), numbers="us")
    return S.transactions(rows, spec).select("file", "line_no", "debit_sum", "currency", F.coalesce("uniq_actor_field_value", F.lit("")).alias("actor"), "description")


QUERIES = {f.__name__: f for f in (
    field_vocabulary, name_rules, stored_keys, coerced_values, error_bodies, field_names_once, node_filters, form_titles, cycle_forest, path_collisions, rename_collisions, ref_fields, unsupported_ops, record_claims,
    plan_summary, found_tally, want_totals, account_sides, account_ids, job_counts, dry_run_counts, batch_counts, two_sided_rows, one_column_signs, backfilled_rows,
)}

_JOBS = """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS skipped, o_orderpriority LIKE '5%' AND o_orderkey % 7 <> 0 AS bad, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
  CASE WHEN o_orderkey % 7 = 1 THEN 'b1' ELSE 'house' END AS actor FROM orders),
t AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') || '|' || CASE WHEN o_orderkey % 10 = 0 THEN 'same' ELSE CAST(o_orderkey AS VARCHAR) END || '|' || CASE WHEN o_orderkey % 2 = 0 THEN price ELSE '0' END || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '0' END || '|' || (o_orderkey % 7 = 1) AS raw FROM o),
f AS (SELECT DISTINCT o_orderpriority AS file FROM o WHERE bad),
e AS (SELECT o_orderpriority AS file, o_orderkey, 'debit' AS side, raw FROM t WHERE skipped = 0 AND o_orderkey % 2 = 0 UNION ALL SELECT o_orderpriority, o_orderkey, 'credit', raw FROM t WHERE skipped = 0 AND o_orderkey % 3 = 0),
g AS (SELECT *, row_number() OVER (PARTITION BY raw, side ORDER BY file, o_orderkey) AS n FROM e WHERE file NOT IN (SELECT file FROM f)),
j AS (SELECT o_orderpriority AS file, count(*) AS records, CAST(sum(skipped) AS BIGINT) AS skipped, count(DISTINCT actor) FILTER (skipped = 0) AS actors, min(o_orderkey) FILTER (bad) AS first_bad FROM o GROUP BY 1),
p AS (SELECT file, count(*) FILTER (n = 1) AS posted, count(*) FILTER (n > 1) AS duplicate FROM g GROUP BY 1),
k AS (SELECT file, CASE WHEN first_bad IS NULL THEN records END AS records, CASE WHEN first_bad IS NULL THEN coalesce(posted, 0) END AS posted, CASE WHEN first_bad IS NULL THEN coalesce(duplicate, 0) END AS duplicate,
  CASE WHEN first_bad IS NULL THEN skipped END AS skipped, CASE WHEN first_bad IS NULL THEN actors END AS actors, 'line ' || first_bad || ': debit_sum' AS error FROM j LEFT JOIN p USING (file))
"""
_CASE = lambda k, values: f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_V = "CAST(CAST(value AS DECIMAL(18,2)) + 1 AS DECIMAL(18,2))"

ORACLES = {
    "field_vocabulary": """
WITH p AS (SELECT p_partkey AS k, p_name, p_partkey % 12 AS w, p_partkey % 24 < 12 AS half, p_partkey % 7 AS form FROM part)
SELECT k AS part, CASE WHEN k % 3 = 1 THEN 'FullName' || k ELSE array_to_string(string_split(lower(p_name), ' ')[1:4] || CASE len(string_split(p_name, ' ')) WHEN 1 THEN ['of', 'the', 'whole'] WHEN 2 THEN ['of', 'the'] WHEN 3 THEN ['of'] ELSE [] END, '_') END AS name,
  CASE WHEN w IN (0, 11) THEN 'bool' WHEN w = 1 THEN 'date' WHEN w IN (2, 3) THEN CASE WHEN half THEN 'enum[1, Two]' ELSE 'string' END WHEN w IN (4, 5) THEN CASE WHEN half AND form IN (1, 2, 3) THEN 'ref(form' || form || ')' ELSE 'string' END
       WHEN w = 6 THEN 'int' WHEN w IN (7, 10) THEN 'number' WHEN w = 8 THEN 'text' ELSE 'string' END AS type FROM p""",
    "name_rules": r"""
WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment, 'a b ' || repeat(c_name, CAST(c_custkey % 6 AS INT)) AS line FROM customer)
SELECT k, CASE WHEN length(trim(line)) > 72 THEN left(trim(line), 71) || '…' ELSE trim(line) END AS short, 'Top > ' || c_name AS bare, c_name AS title, 'Top @ab12 > New' AS renamed, c_name AS untyped,
  CASE WHEN k % 200 = 0 THEN '375ms' WHEN k % 200 < 60 THEN (k % 200) || '.375s' ELSE ((k % 200) // 60) || 'm' || ((k % 200) % 60) || '.375s' END AS took,
  k % 2 = 0 AS full_id, k % 3 = 0 AS identity, CASE WHEN k % 3 = 1 THEN 'http' ELSE 'https' END || '://host' || k AS base, CASE k % 3 WHEN 0 THEN 's' WHEN 1 THEN 'u' ELSE '' END AS address FROM c""",
    "stored_keys": "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'age' ELSE '__form__' || (c_custkey % 5) || ':age' END AS stored, 'name' AS absent, CAST(CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 > 0 THEN c_custkey % 5 ELSE 77 END AS BIGINT) AS form, 'age,zero' AS names, CAST(c_custkey AS VARCHAR) AS age FROM customer",
    "coerced_values": "SELECT o_orderkey AS k, " + _CASE("o_orderkey", ["'5'", "'5'", "NULL", "'1.5'", "NULL", "'true'", "NULL", "'\"2024-01-02\"'", "NULL", "'\"2024-01-02\"'", "'\"b\"'", "NULL", "'\"A > B\"'", "NULL"]) + " AS value, o_orderkey % 14 IN (2, 4, 6, 8, 11, 13) AS failed, " + _CASE("o_orderkey", ["'5'", "'5'", "'true'", "'1.5'", "'nan'", "'T'", "'1'", "'2024-01-02T03:04:05.678'", "'2024-13-01'", "'2024-01-02T03:04'", "'b'", "'x'", "'A > B'", "''"]) + " AS text FROM orders",
    "error_bodies": "SELECT c_custkey AS k, " + _CASE("c_custkey", ["'Ref already exists'", "'no such id'", "'plain text'", "'ref is not unique'"]) + " AS message, " + _CASE("c_custkey", ["'E1'", "'7'", "NULL", "NULL"]) + " AS code, c_custkey % 8 IN (0, 3) AS duplicate FROM customer",
    "field_names_once": """
WITH f AS (SELECT n_regionkey, n_nationkey, list_extract(['a', 'a', 'a_2', 'a', 'b'], CAST((n_nationkey // 5) % 5 + 1 AS INT)) AS name FROM nation)
SELECT CAST(n_regionkey AS VARCHAR) AS slug, CAST(n_nationkey AS INT) AS ord, CASE WHEN n_nationkey // 5 = 1 THEN 'a_2' WHEN n_nationkey // 5 = 2 THEN 'a_2_2' WHEN n_nationkey // 5 = 3 THEN 'a_3' ELSE name END AS name FROM f""",
    "node_filters": "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0 AND c_custkey % 3 <> 1",
    "form_titles": "SELECT c_custkey % 10 AS form_id, 'Form ' || min(c_custkey) FILTER (c_custkey % 4 <> 0) AS form_title FROM customer WHERE c_custkey % 11 <> 0 GROUP BY 1",
    "cycle_forest": "SELECT 'n' || a.n_nationkey AS id, CASE WHEN a.n_nationkey % 5 > 0 THEN 'n' || (a.n_nationkey - 1) END AS parent_id, CAST(a.n_nationkey % 5 AS INT) AS depth, string_agg(b.n_name, ' > ' ORDER BY b.n_nationkey) AS path FROM nation a JOIN nation b ON b.n_nationkey // 5 = a.n_nationkey // 5 AND b.n_nationkey <= a.n_nationkey GROUP BY a.n_nationkey",
    "path_collisions": """
WITH b AS (SELECT n_nationkey AS k, r_name || ' > ' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'r' || r_regionkey AS id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'n' || k, 1, p FROM b UNION ALL SELECT 'x' || k, 0, p || '@x' || k FROM b UNION ALL SELECT 'k' || k, 1, p || '@x' || k || ' > K' FROM b""",
    "rename_collisions": "SELECT n_nationkey AS n, r_name || ' > ' || f AS path FROM nation JOIN (SELECT n_regionkey AS r, min(n_name) AS f FROM nation GROUP BY 1) ON n_regionkey = r JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0 AND n_name <> f",
    "ref_fields": """
SELECT n_nationkey AS n, CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 8 = 3 THEN '~' ELSE '!' END AS mark, CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 8 = 3 THEN '{"id":"n' || n_nationkey || '","title":"' || n_name || '"}' END AS stored,
  CASE WHEN n_nationkey % 4 = 1 THEN 'owner takes a nation, ' || r_name || ' is a region' WHEN n_nationkey % 4 = 2 THEN 'owner: missing address nowhere' WHEN n_nationkey % 8 = 7 THEN 'no field onwer' END AS error FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "unsupported_ops": "SELECT n_nationkey AS n, " + _CASE("n_nationkey", ["'under and create are not supported'", "'append is not supported: set the whole value'", "'no address'", "'at and type exclude each other'", "'the op does nothing'", "NULL"]) + " AS error FROM nation",
    "record_claims": """
WITH o AS (SELECT o_orderkey AS n, o_custkey, o_orderkey % 12 <> 0 AS sound FROM orders WHERE o_orderkey % 4 = 0)
SELECT n, true AS creates, CASE WHEN NOT sound THEN 'the op does nothing' WHEN first < n THEN 'the record is claimed by op ' || first END AS error FROM (SELECT *, min(n) FILTER (sound) OVER (PARTITION BY o_custkey) AS first FROM o)""",
    "plan_summary": G._PLAN + """
SELECT count(*) FILTER (mark = '*') AS creates, CAST(coalesce(sum(n_changes) FILTER (mark IN ('+', '~')), 0) AS BIGINT) AS writes, count(*) FILTER (mark IN ('+', '~') AND new_title IS NOT NULL) AS renames, 0 AS describes, count(*) FILTER (mark = '+') AS holes, 0 AS pictures,
  count(*) FILTER (mark = '>') AS satisfied, count(*) FILTER (mark = '!') AS errors FROM m""",
    "found_tally": f"SELECT count(*) FILTER (verdict = 'FOUND') AS found, count(*) FILTER (verdict = 'not found') AS missing FROM ({G.ORACLES['candidate_cascade']})",
    "want_totals": f"SELECT (SELECT count(DISTINCT user_id) FROM events) AS nodes, (SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 40 = 0)) AS faceless, count(DISTINCT node_id) AS with_holes, count(*) AS missing FROM ({G.ORACLES['want_list']})",
    "account_sides": "SELECT o_custkey AS actor_id, o_orderstatus AS name_id, 1 AS currency_id, max(o_orderkey) FILTER (o_orderkey % 2 = 0) AS debit, max(o_orderkey) FILTER (o_orderkey % 2 = 1) AS credit FROM orders GROUP BY 1, 2",
    "account_ids": "SELECT actor, currency, left(sha1(actor || '|Bank 3|' || currency || '|debit'), 32) AS debit, left(sha1(actor || '|Bank|' || currency || '|credit'), 32) AS credit FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS actor, left(o_orderpriority, 1) AS currency FROM orders)",
    "job_counts": _JOBS + "SELECT * FROM k",
    "dry_run_counts": _JOBS + "SELECT file, posted + duplicate AS posted, CASE WHEN error IS NULL THEN 0 END AS duplicate FROM k",
    "batch_counts": _JOBS + "SELECT count(*) AS jobs, count(error) AS failed, CAST(sum(records) AS BIGINT) AS records, CAST(sum(posted) AS BIGINT) AS posted, CAST(sum(duplicate) AS BIGINT) AS duplicate, CAST(sum(skipped) AS BIGINT) AS skipped, (SELECT count(DISTINCT actor) FROM o WHERE skipped = 0 AND o_orderpriority NOT IN (SELECT file FROM f)) AS actors FROM k",
    "two_sided_rows": f"""
WITH e AS (SELECT *, {_V} AS v, event_id % 5 = 0 AS flip FROM events WHERE event_id % 7 <> 0), d AS (SELECT *, (event_id % 2 = 0) <> flip AS debit FROM e)
SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, strftime(ts, '%Y-%m-%d') AS transaction_date, CASE WHEN debit THEN CAST(v AS VARCHAR) ELSE '0.00' END AS debit_sum, CASE WHEN debit THEN '0.00' ELSE CAST(v AS VARCHAR) END AS credit_sum, event_type AS description FROM d""",
    "one_column_signs": f"""
SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, CASE WHEN debit THEN CAST(v AS VARCHAR) ELSE '0.00' END AS debit_sum, CASE WHEN debit THEN '0.00' ELSE CAST(v AS VARCHAR) END AS credit_sum
FROM (SELECT *, {_V} AS v, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE event_id % 2 = 0 END AS debit FROM events)""",
    "backfilled_rows": f"""
WITH e AS (SELECT *, sum(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS txn FROM events)
SELECT CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY txn) AS line_no, CAST(min({_V}) FILTER (event_id % 3 = 0) AS VARCHAR) AS debit_sum,
  coalesce(arg_min(CASE WHEN (event_id // 3) % 2 = 0 THEN 'USD' ELSE 'EUR' END, event_id) FILTER (event_id % 3 = 1), 'XXX') AS currency, coalesce(arg_min('actor' || event_id, event_id) FILTER (event_id % 3 = 2), '') AS actor, string_agg(event_type, ' ' ORDER BY event_id) AS description FROM e WHERE txn > 0 GROUP BY user_id, txn""",
}
