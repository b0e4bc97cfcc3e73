"""Queries that score completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions import scores as C
from sqlgauge.functions.sqltext import sql_features, with_table_score
from sqlgauge.functions.text import hash_bucket, prompt_key
from sqlgauge.operators.alignment import align_columns, schema_scores
from sqlgauge.operators.resultsets import value_scores
from sqlgauge.plans import reward as W
from sqlgauge.querybook import inputs as I
from sqlgauge.querybook.registry import query, rounded, table
from sqlgauge.querybook.results import _NUMBER, sql_walk
from sqlgauge.session import spread
from sqlgauge.sources import runner


def scored_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Completions with a token count in the range of the penalty."""
    return I.completions(spark, sf).withColumn("n_tokens", F.col("n_tokens") * 20)


def _session(spark: SparkSession, sf: str) -> SparkSession:
    return runner.guarded_session(spark, {"orders": f"{sf}/orders.parquet"})


def validated_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the validity of the answers, told by the engine."""
    return W.with_validity(_session(spark, sf), scored_inputs(spark, sf))


# Hand-derived from the forms: format and answers of each form of a completion.
_FORMAT = "(form IN (0, 2, 5))::INTEGER::DOUBLE"
_SOLE = "form IN (0, 1, 5)"
_STRICT = "form IN (0, 5)"
_BODY = f"""CASE WHEN task_no < 4 THEN {I.sql_pick("body_no", "gold",
    "'select o.o_orderstatus from customer_orders_hf o where o.o_custkey = ' || conv_id || ' -- all'",
    "'SELECT count(*) AS n FROM orders ORDER BY 1 LIMIT 10'", "text")}
  ELSE {I.sql_pick("body_no", "text", "text || ' ok'", "'SELECT 1'", "'no ' || text")} END"""
# Which bodies the engine can analyse: not the one about an unknown table, and no prose.
_VALID = "CASE WHEN t3.task_no < 4 THEN c.body_no IN (0, 2) ELSE c.body_no = 2 END"
_LENGTH = "least(-(n_tokens * 20 - (2048 - 409)) / 409.0::DOUBLE, 0)::DOUBLE"
_ROWS = f"""{I.COMPLETIONS},
r AS (SELECT c.*, t3.conv_id, t3.task_no, t3.body, {_VALID} AS valid FROM completions c JOIN t3 USING (key)),
s AS (SELECT *, {_FORMAT} AS format_reward, {_LENGTH} AS length_reward,
  CASE WHEN NOT ({_SOLE}) THEN 0.0::DOUBLE WHEN task = 'degenerate_dim' THEN (NOT valid)::INTEGER::DOUBLE
    WHEN upper(body) LIKE '%SELECT%' THEN valid::INTEGER::DOUBLE WHEN upper(gold) LIKE '%SELECT%' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS grammar_reward FROM r)"""


@query("format_rewards", "W1", f"WITH {_ROWS} SELECT key, format_reward FROM s")
def format_rewards(spark: SparkSession, sf: str) -> DataFrame:
    return scored_inputs(spark, sf).select("key", C.format_reward(F.col("content")).alias("format_reward"))


@query("grammar_rewards", "W2", f"WITH {_ROWS} SELECT key, grammar_reward FROM s")
def grammar_rewards(spark: SparkSession, sf: str) -> DataFrame:
    return validated_inputs(spark, sf).select("key", C.grammar_reward(
        F.col("content"), F.col("gold"), F.col("task"), F.col("valid")).alias("grammar_reward"))


@query("length_rewards", "W3", f"""
WITH {_ROWS} SELECT key, round(length_reward, 6) AS length_reward, round(least(-(n_tokens - 48) / 16.0::DOUBLE, 0)::DOUBLE, 6) AS short_reward FROM s""")
def length_rewards(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_tokens")
    return scored_inputs(spark, sf).select(
        "key", rounded(C.length_reward(n)).alias("length_reward"),
        rounded(C.length_reward(n / 20, 64, 16)).alias("short_reward"))


@query("exact_rewards", "W4", f"""
WITH {_ROWS} SELECT key, ({_STRICT} AND body = gold)::INTEGER::DOUBLE AS exact_reward FROM s""")
def exact_rewards(spark: SparkSession, sf: str) -> DataFrame:
    return scored_inputs(spark, sf).select(
        "key", C.exact_reward(F.col("content"), F.col("gold")).alias("exact_reward"))


_COS = "list_cosine_similarity(emb_pred, emb_gold)"
_BANDED = f"CASE WHEN {_COS} >= 0.96 THEN {_COS} WHEN {_COS} >= 0.9 THEN {_COS} * 0.8 ELSE 0 END"


@query("similarity_rewards", "W5, W6", f"""
WITH {I.PAIRS} SELECT pair_id, round({_COS}, 6) AS similarity, round(({_BANDED})::DOUBLE, 6) AS reward FROM pairs""")
def similarity_rewards(spark: SparkSession, sf: str) -> DataFrame:
    sim = I.vector_pairs(spark, sf).select(
        "pair_id", C.cosine(F.col("emb_pred"), F.col("emb_gold")).alias("similarity"))
    return sim.select("pair_id", rounded("similarity").alias("similarity"),
                      rounded(C.similarity_reward(F.col("similarity"))).alias("reward"))


@query("set_scores", "W7, X8", f"""
WITH {I.WORD_SETS}, n AS (SELECT doc_id, len(list_intersect(pred, gold)) AS shared, len(pred) AS p, len(gold) AS g FROM word_sets)
SELECT doc_id, CASE WHEN g = 0 THEN 1.0::DOUBLE WHEN p = 0 THEN 0.0::DOUBLE ELSE round(shared / g, 6) END AS recall,
  CASE WHEN g = 0 THEN 1.0::DOUBLE WHEN p = 0 THEN 0.0::DOUBLE ELSE round(shared / (p + g - shared), 6) END AS jaccard FROM n""")
def set_scores(spark: SparkSession, sf: str) -> DataFrame:
    p, g = F.col("pred"), F.col("gold")
    return I.word_sets(spark, sf).select(
        "doc_id", rounded(C.set_score(p, g)).alias("recall"), rounded(C.set_score(p, g, "jaccard")).alias("jaccard"))


# --- statement features ------------------------------------------------------------

def _statements(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    simple = F.concat(F.lit("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey = "), key,
                      F.lit(" GROUP BY o_orderstatus"))
    rich = F.concat(
        F.lit("WITH m AS (SELECT o.o_custkey AS ck, sum(o.o_totalprice) total FROM orders o JOIN customer c "
              "ON o.o_custkey = c.c_custkey WHERE c.c_name = 'It''s "), key,
        F.lit("' GROUP BY o.o_custkey) SELECT DISTINCT ck FROM m ORDER BY total DESC LIMIT 5"))
    small = F.concat(F.lit("select count(distinct p_brand) from db.part p where p.p_size > 1.5 -- "), key)
    listed = F.concat(F.lit("SELECT a.c_name FROM customer a JOIN nation b ON a.c_nationkey = b.n_nationkey, region "
                            "WHERE a.c_custkey = "), key)
    nested = F.concat(
        F.lit("SELECT substring(c_phone FROM 1 FOR 2) AS p, trim(both 'x' FROM c_name) FROM (SELECT * FROM customer) s, "
              "orders o TABLESAMPLE (5 PERCENT) WHERE o.o_custkey = "), key)
    return spread(table(spark, sf, "customer").select("c_custkey")).select(
        "c_custkey", I.pick(hash_bucket(key, 5), simple, rich, small, listed, nested).alias("sql"))


@query("statement_features", "W8", f"""
WITH c AS (SELECT c_custkey, {I.sql_bucket('c_custkey::VARCHAR', 5)} AS form FROM customer)
SELECT c_custkey, {I.sql_pick('form', "'orders'", "'customer,m,orders'", "'part'", "'customer,nation,region'", "'customer,orders'")} AS tables,
  {I.sql_pick('form', "'o_custkey,o_orderstatus'", "'c_custkey,c_name,ck,o_custkey,o_totalprice,total'", "'p_brand,p_size'",
    "'c_custkey,c_name,c_nationkey,n_nationkey'", "'c_name,c_phone,o_custkey'")} AS columns,
  {I.sql_pick('form', "'GROUP BY,WHERE'", "'CTE,DISTINCT,GROUP BY,JOIN,LIMIT,ORDER BY,WHERE'", "'DISTINCT,WHERE'", "'JOIN,WHERE'", "'JOIN,WHERE'")} AS keywords,
  {I.sql_pick('form', "c_custkey::VARCHAR", "'5,Its ' || c_custkey", "'1.5'", "c_custkey::VARCHAR",
    "array_to_string(list_sort(list_distinct(['1', '2', '5', 'x', c_custkey::VARCHAR])), ',')")} AS literals FROM c""")
def statement_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = _statements(spark, sf).withColumn("f", sql_features(F.col("sql")))
    return rows.select("c_custkey", *[
        F.array_join(F.array_sort(f"f.{n}"), ",").alias(n) for n in ("tables", "columns", "keywords", "literals")])


# A table named after each customer, and what a prediction makes of it. Letters in one run on both sides are all
# that the two names share, so their ratio follows from the lengths.
_NAME = "lower(replace(c_name, '#', '_'))"


@query("table_scores", "W9", f"""
WITH n AS (SELECT c_custkey, length({_NAME}) AS l, {I.sql_bucket('c_custkey::VARCHAR', 6)} AS form FROM customer),
r AS (SELECT *, CASE form WHEN 1 THEN 2 * l / (2 * l + 3) WHEN 2 THEN 2 * (l - 1) / (2 * l - 1) WHEN 3 THEN 2 * (l - 4) / (2 * l) ELSE 0 END AS ratio FROM n)
SELECT c_custkey, CASE form WHEN 5 THEN 0.0::DOUBLE ELSE round((1 + CASE WHEN form = 0 THEN 1 WHEN ratio > 0.85 THEN 0.8 ELSE 0 END) / 2, 6)::DOUBLE END AS score FROM r""")
def table_scores(spark: SparkSession, sf: str) -> DataFrame:
    named = F.lower(F.replace("c_name", F.lit("#"), F.lit("_")))
    rows = table(spark, sf, "customer").select("c_custkey", named.alias("n"))
    form, n, other = hash_bucket(F.col("c_custkey").cast("string"), 6), F.col("n"), F.lit("orders")
    listed = F.array(
        F.array(other, n), F.array(F.concat(n, F.lit("_hf")), other), F.array(n.substr(F.lit(1), F.length(n) - 1), other),
        F.array(F.concat(F.lit("####"), n.substr(F.lit(5), F.length(n))), other), F.array(F.lit("####"), other),
        F.array().cast("array<string>"))
    rows = rows.select("c_custkey", F.array(n, other).alias("gold"), F.get(listed, form.cast("int")).alias("pred"))
    return with_table_score(rows, "gold", "pred", "score").select("c_custkey", rounded("score").alias("score"))


# Hand-derived rule scores of the four bodies of a SQL task.
_RULE = "CASE body_no WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 + CASE WHEN conv_id IN (1, 10) THEN 0.2 ELSE 0 END ELSE 0 END"


@query("rule_scores", "W10", f"""
WITH {_ROWS} SELECT key, CASE WHEN task_no < 4 AND {_SOLE} THEN ({_RULE})::DOUBLE ELSE 0.0::DOUBLE END AS rule_score, task_no < 4 AS gold_parsed FROM s""")
def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    from sqlgauge.functions.replies import sole_answer

    rows = scored_inputs(spark, sf).withColumn("pred", sole_answer(F.col("content")))
    is_sql = F.col("task").isin(*S.SQL_TASKS)
    return W.with_rule_score(rows).select(
        "key", F.when(is_sql, F.coalesce("rule_score", F.lit(0.0))).otherwise(F.lit(0.0)).alias("rule_score"),
        "gold_parsed")


# --- result schemas ------------------------------------------------------------------

def result_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Name vectors of two result schemas, from four neighbouring vectors per case."""
    emb = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 4).cast("bigint").alias("case_id"), (F.col("vec_id") % 4).cast("int").alias("j"),
        F.col("embedding").cast("array<double>").alias("v"))
    four = emb.groupBy("case_id").agg(
        *[F.max(F.when(F.col("j") == j, F.col("v"))).alias(f"v{j}") for j in range(4)])
    mix = lambda a, b: F.zip_with(a, b, lambda x, y: x + F.lit(0.3) * y)
    column = lambda side, no, vec: F.struct(
        F.lit(side).alias("side"), F.lit(no).alias("col_no"), F.lit(f"{side[0]}{no}").alias("col"), vec.alias("vec"))
    extra = F.when(F.col("case_id") % 2 == 0, F.col("v3"))
    cols = [column("gold", j, F.col(f"v{j}")) for j in range(3)]
    cols += [column("pred", j, mix(f"v{(j + 1) % 3}", f"v{(j + 2) % 3}")) for j in range(3)]
    cols.append(column("pred", 3, extra))
    return four.select("case_id", F.inline(F.array(*cols))).filter("vec is not null")


_COLUMNS = """emb AS (SELECT vec_id // 4 AS case_id, vec_id % 4 AS j, embedding::DOUBLE[] AS v FROM embeddings),
mixed AS (SELECT a.case_id, (a.j + 2) % 3 AS no, list_transform(list_zip(a.v, b.v), lambda z: z[1] + 0.3::DOUBLE * z[2]) AS v
  FROM emb a JOIN emb b ON a.case_id = b.case_id AND a.j < 3 AND b.j = (a.j + 1) % 3
  UNION ALL SELECT case_id, 3, v FROM emb WHERE j = 3 AND case_id % 2 = 0),
sims AS (SELECT g.case_id, g.j AS g, p.no AS p, list_cosine_similarity(g.v, p.v) AS sim FROM emb g JOIN mixed p ON g.case_id = p.case_id AND g.j < 3),
combos AS (SELECT a.case_id, [a.p, b.p, c.p] AS ps, [a.sim, b.sim, c.sim] AS ss, a.sim + b.sim + c.sim AS total
  FROM sims a JOIN sims b ON a.case_id = b.case_id AND a.g = 0 AND b.g = 1 AND a.p <> b.p
  JOIN sims c ON a.case_id = c.case_id AND c.g = 2 AND c.p <> a.p AND c.p <> b.p),
best AS (SELECT case_id, arg_max(ps, total) AS ps, arg_max(ss, total) AS ss FROM combos GROUP BY case_id),
pairs AS (SELECT case_id, unnest(['g0', 'g1', 'g2']) AS true_col, unnest(ps) AS p, unnest(ss) AS sim FROM best),
aligned AS (SELECT case_id, true_col, 'p' || p AS pred_col, sim FROM pairs WHERE sim > 0.75)"""


@query("column_alignment", "W11", f"WITH {_COLUMNS} SELECT case_id, true_col, pred_col, round(sim, 6) AS sim FROM aligned")
def column_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align_columns(result_columns(spark, sf)).withColumn("sim", rounded("sim"))


@query("schema_scores", "W12", f"""
WITH {_COLUMNS}, n AS (SELECT case_id, 3 AS g, 3 + (case_id % 2 = 0)::INTEGER AS p FROM best), s AS (SELECT case_id, sum(sim) AS s FROM aligned GROUP BY case_id)
SELECT n.case_id, g::BIGINT AS n_gold_cols, p::BIGINT AS n_pred_cols,
  round(least(coalesce(s, 0) / g / (1 + 0.2::DOUBLE * (p - g) / g), 1)::DOUBLE, 6) AS schema_score FROM n LEFT JOIN s ON n.case_id = s.case_id""")
def schema_score_rows(spark: SparkSession, sf: str) -> DataFrame:
    columns = result_columns(spark, sf)
    return schema_scores(columns, align_columns(columns)).withColumn("schema_score", rounded("schema_score"))


@query("row_count_scores", "W13", """
WITH n AS (SELECT c_custkey, count(o_orderkey) AS g, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS p
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN g = p THEN 1.0::DOUBLE WHEN g = 0 OR p = 0 THEN 0.0::DOUBLE
  ELSE round(1 / (1 + 0.3::DOUBLE * ln(greatest(g, p)::DOUBLE / least(g, p)::DOUBLE)), 6) END AS row_score FROM n""")
def row_count_scores(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("g"), F.count_if(F.col("o_orderstatus") == "F").alias("p"))
    counts = table(spark, sf, "customer").select("c_custkey").join(
        orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = F.lit(0)
    return counts.select("c_custkey", rounded(C.row_count_score(
        F.coalesce("g", zero), F.coalesce("p", zero))).alias("row_score"))


# --- values ---------------------------------------------------------------------------

_HIT_FORMS = ("g", "(g::DOUBLE * 1.009)::VARCHAR", "(g::DOUBLE * 1.011)::VARCHAR", "' ' || g || ' '", "'None'", "'0.0000001'")


def sql_hit(p: str, g: str) -> str:
    number = lambda c: f"CASE WHEN regexp_matches({c}, {_NUMBER}) THEN trim({c})::DOUBLE END"
    x, y = number(p), number(g)
    return (f"CASE WHEN ({x}) IS NOT NULL AND ({y}) IS NOT NULL THEN CASE WHEN ({y}) = 0 THEN abs({x}) < 0.000001 "
            f"ELSE abs(({x}) - ({y})) / abs({y}) < 0.01::DOUBLE END ELSE trim({p}) = trim({g}) END")


@query("value_hits", "W14", f"""
WITH b AS (SELECT o_orderkey, {I.sql_bucket('o_orderkey::VARCHAR', 6)} AS form,
  CASE o_orderstatus WHEN 'O' THEN '0' WHEN 'P' THEN o_orderpriority ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS g, o_orderstatus FROM orders),
v AS (SELECT *, CASE WHEN o_orderstatus = 'P' AND form IN (1, 2) THEN g ELSE {I.sql_pick('form', *[f.replace('g::DOUBLE', 'try_cast(g AS DOUBLE)') for f in _HIT_FORMS])} END AS p FROM b)
SELECT o_orderkey, {sql_hit('p', 'g')} AS hit FROM v""")
def value_hits(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", status, hash_bucket(F.col("o_orderkey").cast("string"), 6).alias("form"),
        F.when(status == "O", F.lit("0")).when(status == "P", F.col("o_orderpriority"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("g"))
    g = F.col("g")
    scaled = lambda k: (g.try_cast("double") * k).cast("string")
    p = F.when((status == "P") & F.col("form").isin(1, 2), g).otherwise(I.pick(
        F.col("form"), g, scaled(1.009), scaled(1.011), F.concat(F.lit(" "), g, F.lit(" ")), "None", "0.0000001"))
    return rows.select("o_orderkey", C.value_hit(p, g).alias("hit"))


def _case_mapping(spark: SparkSession, sf: str) -> DataFrame:
    renamed = F.col("form") == "column_renamed"
    pair = lambda t, p: F.struct(F.lit(t).alias("true_col"), p.alias("pred_col"))
    return I.cases(spark, sf).select("case_id", F.inline(F.array(
        pair("amount", F.lit("amount")), pair("idx", F.lit("idx")),
        pair("status", F.when(renamed, F.lit("state")).otherwise(F.lit("status"))))))


_VALUES = f"""cell_l AS (SELECT case_id, 'amount' AS col, pos, v.amount AS val FROM p_rows UNION ALL SELECT case_id, 'idx', pos, v.idx FROM p_rows
  UNION ALL SELECT case_id, 'status', pos, v.status FROM p_rows),
cell_r AS (SELECT case_id, 'amount' AS col, pos, v.amount AS val FROM g_rows UNION ALL SELECT case_id, 'idx', pos, v.idx FROM g_rows
  UNION ALL SELECT case_id, 'status', pos, v.status FROM g_rows),
lefts AS (SELECT case_id, col, row_number() OVER (PARTITION BY case_id, col ORDER BY pos) AS k, val AS v FROM cell_l),
rights AS (SELECT case_id, col, list(val ORDER BY pos) AS items FROM cell_r GROUP BY ALL),
{sql_walk(sql_hit('l.v', 'r'), 'lefts', 'rights', 'case_id, col')},
hits AS (SELECT case_id, col, max(hits) AS h FROM walk GROUP BY ALL),
np AS (SELECT case_id, count(*) AS p FROM p_rows GROUP BY case_id), ng AS (SELECT case_id, count(*) AS g FROM g_rows GROUP BY case_id),
vals AS (SELECT case_id, sum(CASE WHEN h > 0 THEN 2 * h / (p + g) ELSE 0 END) / 3 AS value_score
  FROM hits JOIN np USING (case_id) JOIN ng USING (case_id) GROUP BY case_id)"""


@query("value_scores", "W15", f"""
WITH RECURSIVE {I.CASE_ROWS}, {_VALUES}
SELECT case_id, round(coalesce(value_score, 0)::DOUBLE, 6) AS value_score FROM cases LEFT JOIN vals USING (case_id)""")
def value_score_rows(spark: SparkSession, sf: str) -> DataFrame:
    widths = I.cases(spark, sf).select("case_id", F.lit(3).alias("n_gold_cols"))
    out = value_scores(I.stored_case_rows(spark, sf), _case_mapping(spark, sf), widths)
    return out.withColumn("value_score", rounded("value_score"))


NAME_VECTORS = {"amount": (1.0, 0.0, 0.0), "idx": (0.0, 1.0, 0.0), "status": (0.0, 0.0, 1.0),
                "state": (0.0, 0.3, 0.95), "extra": (0.5, 0.5, 0.5), "n": (0.0, 1.0, 0.0),
                "o_orderstatus": (0.0, 0.0, 1.0)}


def _case_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Both schemas of each case with the vectors of the column names."""
    def col(side: str, no: int, name: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.lit(no).alias("col_no"), F.lit(name).alias("col"),
                        F.array(*[F.lit(x) for x in NAME_VECTORS[name]]).alias("vec"))

    def schema(side: str, *names: str) -> Column:
        return F.array(*[col(side, i, n) for i, n in enumerate(names)])

    form = F.col("form")
    pred = (
        F.when(form == "column_renamed", schema("pred", "amount", "idx", "state"))
        .when(form == "column_added", schema("pred", "amount", "extra", "idx", "status"))
        .otherwise(schema("pred", "amount", "idx", "status")))
    both = F.concat(schema("gold", "amount", "idx", "status"), pred)
    return I.cases(spark, sf).select("case_id", F.inline(both))


@query("dense_scores", "W16", f"""
WITH RECURSIVE {I.CASE_ROWS}, {_VALUES},
d AS (SELECT c.case_id, coalesce(p, 0) AS p, coalesce(g, 0) AS g, coalesce(value_score, 0)::DOUBLE AS v,
  CASE form WHEN 'column_renamed' THEN (2 + 0.95::DOUBLE / sqrt(0.09::DOUBLE + 0.9025::DOUBLE)) / 3
    WHEN 'column_added' THEN 1 / (1 + 0.2::DOUBLE / 3) ELSE 1.0::DOUBLE END AS s
  FROM cases c LEFT JOIN np USING (case_id) LEFT JOIN ng USING (case_id) LEFT JOIN vals USING (case_id)),
e AS (SELECT case_id, CASE WHEN p = 0 OR g = 0 THEN 0.0::DOUBLE ELSE s END AS s, v, p, g,
  CASE WHEN p = g THEN 1.0::DOUBLE WHEN p = 0 OR g = 0 THEN 0.0::DOUBLE ELSE 1 / (1 + 0.3::DOUBLE * ln(greatest(g, p)::DOUBLE / least(g, p)::DOUBLE)) END AS r FROM d)
SELECT case_id, round(s, 6) AS schema_score, round(r, 6) AS row_score, round(v, 6) AS value_score,
  CASE WHEN p = 0 AND g = 0 THEN 0.0::DOUBLE ELSE round(0.4::DOUBLE * s + 0.1::DOUBLE * r + 0.5::DOUBLE * v, 4) END AS dense_score FROM e""")
def dense_score_rows(spark: SparkSession, sf: str) -> DataFrame:
    out = W.dense_scores(I.stored_case_rows(spark, sf), _case_columns(spark, sf))
    return out.select("case_id", *[rounded(c).alias(c) for c in ("schema_score", "row_score", "value_score")],
                      "dense_score")


# --- dispatch and totals -----------------------------------------------------------------

def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Result match and dense score of the statements that were run, and answer vectors of every completion."""
    pairs = I.vector_pairs(spark, sf).withColumnRenamed("pair_id", "prompt_id")
    names = spark.createDataFrame([(n, list(v)) for n, v in NAME_VECTORS.items()], "col string, vec array<double>")
    vectors = names.select(prompt_key(F.col("col")).alias("text_key"), "vec")
    ran = W.executed_evidence(_session(spark, sf), I.completions(spark, sf), vectors)
    return I.completions(spark, sf).select("key", "prompt_id").join(ran, "key", "left").join(
        pairs, "prompt_id", "left").drop("prompt_id")


# Results of the gold statement of each conversation, against those of the body that counts all orders: one column
# of two is shared, its one value is a hit if a group's count is within a hundredth of it.
_RAN = """grouped AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
ran AS (SELECT o_custkey, count(*) AS n_rows, bool_or(abs((SELECT count(*) FROM orders) - n) / n::DOUBLE < 0.01) AS hit FROM grouped GROUP BY o_custkey)"""
_DENSE = """CASE WHEN n_rows IS NULL THEN 0.0::DOUBLE WHEN body_no = 0 THEN 1.0::DOUBLE WHEN body_no = 2 THEN
  round(0.4::DOUBLE * 0.5 + 0.1::DOUBLE / (1 + 0.3::DOUBLE * ln(n_rows::DOUBLE)) + 0.5::DOUBLE * CASE WHEN hit THEN 1.0::DOUBLE / (1 + n_rows) ELSE 0 END, 4) ELSE 0.0::DOUBLE END"""
_SIM = "CASE WHEN emb_pred IS NULL THEN 0 ELSE list_cosine_similarity(emb_pred, emb_gold) END"
_SCORED = f"""{_ROWS}, {I.PAIRS}, {_RAN}, x AS (SELECT s.*, body_no = 0 AS matched, {_DENSE} AS dense,
  ({_SIM})::DOUBLE AS sim, ({_RULE})::DOUBLE AS rule FROM s LEFT JOIN pairs ON pair_id = prompt_id LEFT JOIN ran ON o_custkey = conv_id),
y AS (SELECT *, (CASE WHEN NOT ({_STRICT}) THEN 0 WHEN task IN ('sql', 'reflection') THEN CASE WHEN matched THEN 1 ELSE 0.5 * rule END
  WHEN task = 'multi_step' THEN 0.5::DOUBLE * rule + 0.5::DOUBLE * dense WHEN task = 'degenerate_dim' THEN rule
  WHEN task IN ('metric_reject', 'constraint_ask') THEN (body = gold)::INTEGER
  ELSE CASE WHEN sim >= 0.96 THEN sim WHEN sim >= 0.9 THEN sim * 0.8 ELSE 0 END END)::DOUBLE AS accuracy_reward FROM x),
z AS (SELECT *, 1.5::DOUBLE * accuracy_reward + 1.0::DOUBLE * format_reward + 0.9::DOUBLE * grammar_reward + 0.8::DOUBLE * length_reward AS total_reward FROM y)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.with_accuracy(validated_inputs(spark, sf), evidence(spark, sf))
    return W.with_rewards(rows)


@query("accuracy_rewards", "W17, W18, W19, W20", f"WITH {_SCORED} SELECT key, task, round(accuracy_reward, 6) AS accuracy FROM z")
def accuracy_rewards(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.with_accuracy(scored_inputs(spark, sf), evidence(spark, sf))
    return rows.select("key", "task", rounded("accuracy").alias("accuracy"))


@query("total_rewards", "W21", f"WITH {_SCORED} SELECT key, round(accuracy_reward, 6) AS accuracy_reward, format_reward, grammar_reward, round(length_reward, 6) AS length_reward, round(total_reward, 6) AS total_reward FROM z")
def total_rewards(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "key", *[rounded(c).alias(c) for c in ("accuracy_reward", "format_reward", "grammar_reward",
                                               "length_reward", "total_reward")])


@query("group_statistics", "W22", f"""
WITH {_SCORED}, k AS (SELECT * FROM z WHERE n_tokens * 20 <= 2048),
g AS (SELECT prompt_id, avg(total_reward) AS m, stddev_samp(total_reward) AS d, count(*) AS n FROM k GROUP BY prompt_id HAVING min(total_reward) < max(total_reward))
SELECT key, prompt_id, round(m, 6) AS mean_reward, round(d, 6) AS std_reward, n AS n_completions FROM k JOIN g USING (prompt_id)""")
def group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return W.group_statistics(scored(spark, sf)).select(
        "key", "prompt_id", rounded("mean_reward").alias("mean_reward"), rounded("std_reward").alias("std_reward"),
        "n_completions")


@query("named_rewards", "U1", f"""
WITH {_ROWS} SELECT key, format_reward, ({_STRICT} AND body = gold)::INTEGER::DOUBLE AS exact_reward, (n_tokens < 100)::INTEGER::DOUBLE AS brief_reward,
  1.0::DOUBLE * format_reward + 2.0::DOUBLE * ({_STRICT} AND body = gold)::INTEGER + 0.5::DOUBLE * (n_tokens < 100)::INTEGER AS total_reward FROM s""")
def named_rewards(spark: SparkSession, sf: str) -> DataFrame:
    W.register_reward("brief", lambda: (F.col("n_tokens") < 2000).cast("double"))
    out = W.with_rewards(scored_inputs(spark, sf), {"format": 1.0, "exact": 2.0, "brief": 0.5})
    return out.select("key", "format_reward", "exact_reward", "brief_reward", "total_reward")
