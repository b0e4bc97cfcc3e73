"""Hand-derived cases of prompt text, replies and SQL text."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import replies as R
from sqlgauge.functions import sqltext as Q
from sqlgauge.functions import templates as T
from sqlgauge.functions import text as X
from sqlgauge.operators.sampling import swap_metric

PROMPT = "问题：q1，写出对应的SQL语句\nSELECT 1\n问题：2024 q2，写出对应的SQL语句"


def test_question_is_the_last_and_replacement_the_first(evaluate):
    assert evaluate(X.question_text, PROMPT) == "2024 q2"
    new = evaluate(lambda c: X.replace_question(c, F.lit(r"2025 \1 $2")), PROMPT)
    assert new == PROMPT.replace("q1", r"2025 \1 $2")
    assert evaluate(lambda c: X.replace_question(c, F.lit("n")), "no question") == "no question"


def test_sections(evaluate):
    text = "--- 2.schema kg a \n--- 3.knowledge graph b--- 4.domain kg c　--- 5.data kg a-b--- 6.few shot"
    assert [evaluate(f, text) for f in (X.schema_section, X.knowledge_section, X.domain_section, X.data_section)] == [
        "a", "b", "c", "ab"]
    assert evaluate(X.schema_section, "--- 3.knowledge graph --- 2.schema kg") == ""


def test_insert_constraint(evaluate):
    add = lambda c: X.insert_constraint(c, F.lit("n"))
    assert evaluate(add, "a😀\n  计算逻辑：x\n计算逻辑：y") == "a😀\n必备约束：n\n  计算逻辑：x\n计算逻辑：y"
    assert evaluate(add, "a 计算逻辑：x") is None


def test_templates_do_not_scan_values(evaluate):
    got = evaluate(lambda a, b: T.render("judge_sentences", sentence_a=a, sentence_b=b), "{sentence_b}", "y")
    assert got.startswith("Sentence A: {sentence_b}\nSentence B: y\n")


def test_doubled_answer_has_format_but_no_answer(evaluate):
    text = "<think>a</think><answer>x</answer><answer>y</answer>"
    assert evaluate(R.has_reply_format, text) is True
    assert evaluate(R.strict_answer, text) is None
    assert evaluate(R.first_answer, text) == "x"


@pytest.mark.parametrize("text, think, answer", [
    ("t```sql\nSELECT 1\n```", "t", "sql\nSELECT 1"), ("plain", "", "plain"), ("<think>a</think>b", "a", ""),
    ("x <answer> y </answer>", "", "y"), ("a ```res\nb\n``` c", "a", "b")])
def test_think_and_answer(evaluate, text, think, answer):
    got = evaluate(R.think_and_answer, text)
    assert (got["think"], got["answer"]) == (think, answer)


@pytest.mark.parametrize("text, valid", [
    ('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}}', False), ("[1,2]", True), ("", False), ("1],[2", False),
    ('1},{"b":2', False), ('{"a":1},"b":2', False), ("nul", False)])
def test_strict_json(evaluate, text, valid):
    assert (evaluate(R.strict_json, text) is not None) is valid


@pytest.mark.parametrize("n, accepted", [(1, False), (2, True), (3, False)])
def test_two_faults_exactly(evaluate, n, accepted):
    item = '{"error_type_applied":"a","modified_sql":"s"}'
    got = evaluate(R.fault_pairs, "[" + ",".join([item] * n) + "]")
    assert (got is not None) is accepted


def test_canonical_sql(evaluate):
    noisy = "Sure: select A.x , 'It''s -- x' FROM `T` a /* c */ where B>=1.50;; "
    assert evaluate(Q.canonical_sql, noisy) == "SELECT a.x , 'It''s -- x' FROM `T` a WHERE b >= 1.50"


def test_features(evaluate):
    f = evaluate(Q.sql_features, "SELECT t.a, sum(b) total FROM s.tab AS t LEFT JOIN u USING (k) WHERE c = 'X' LIMIT 3")
    assert set(f["tables"]) == {"tab", "u"}
    assert {"a", "b", "c"} <= set(f["columns"]) and "total" not in f["columns"]
    assert set(f["keywords"]) == {"LIMIT", "WHERE", "JOIN"}
    assert set(f["literals"]) == {"X", "3"}


def test_swap_prefers_longer_names(evaluate):
    metrics = ("sale", "sale share", "lead")
    got = evaluate(lambda c: swap_metric(c, c, metrics), "the sale share now")
    assert got["metric"] in ("sale", "lead") and got["question"] == f"the {got['metric']} now"
    assert evaluate(lambda c: swap_metric(c, c, metrics), "nothing")["question"] is None


def test_features_of_common_forms(evaluate):
    f = evaluate(Q.sql_features, "SELECT a.x FROM orders a, customer AS b , nation WHERE a.k = b.k")
    assert sorted(f["tables"]) == ["customer", "nation", "orders"] and sorted(f["columns"]) == ["k", "x"]
    assert "JOIN" in f["keywords"]
    f = evaluate(Q.sql_features, "SELECT EXTRACT(YEAR FROM o_orderdate), trim(BOTH FROM c) FROM orders WHERE t > -1.5e3")
    assert f["tables"] == ["orders"] and "o_orderdate" in f["columns"] and "year" not in f["columns"]
    assert f["literals"] == ["1.5e3"] and "e3" not in f["columns"] and "JOIN" not in f["keywords"]
    f = evaluate(Q.sql_features, "SELECT k FROM orders LEFT SEMI JOIN customer USING (k)")
    assert sorted(f["tables"]) == ["customer", "orders"] and f["columns"] == ["k"]


SCOPED = [
    ("SELECT a.x FROM a JOIN b ON a.x = b.x, c WHERE c.z > 1", "a b c", "x z"),
    ("SELECT s.k FROM (SELECT k, max(v) m FROM t GROUP BY k) s, orders o WHERE o.k = s.k", "orders t", "k v"),
    ("SELECT x FROM t TABLESAMPLE (5 PERCENT), u", "t u", "x"),
    ("SELECT substring(a FROM 2 FOR 3), trim(both 'x' FROM b), trim(leading FROM e), extract(day FROM d) FROM t", "t", "a b d e"),
    ("WITH m AS (SELECT p FROM q), n (c1, c2) AS (SELECT r, s FROM t) SELECT c1 FROM m JOIN n USING (k)", "m n q t", "c1 k p r s"),
    ("SELECT CASE WHEN a IS DISTINCT FROM b THEN 1 END AS c, CAST(d AS decimal(9,2)) e, f::int FROM g.h AS i", "h", "a b d f"),
    ("SELECT x FROM a WHERE y IN (SELECT z FROM b, c) AND EXISTS (SELECT 1 FROM d WHERE d.w = a.w) ORDER BY v", "a b c d", "v w x y z"),
    ("SELECT row_number() OVER (PARTITION BY p, q ORDER BY r) AS n FROM (a JOIN b ON a.k = b.k), `S`.`Tab` z", "a b tab", "k p q r"),
    ("SELECT a FROM t UNION ALL (SELECT b FROM u) LIMIT 3", "t u", "a b"),
    ("SELECT count(*) n, date '2024-01-01' d FROM range(3) r, t x JOIN u ON (x.i = u.i) WHERE j > interval 3 day", "t u", "i j"),
]


@pytest.mark.parametrize("sql, tables, columns", SCOPED)
def test_names_are_told_by_where_they_stand(evaluate, sql, tables, columns):
    f = evaluate(Q.sql_features, sql)
    assert sorted(f["tables"]) == tables.split() and sorted(f["columns"]) == columns.split()
    assert ("JOIN" in f["keywords"]) == (" JOIN " in sql or len(tables.split()) > 1 and "UNION" not in sql)
