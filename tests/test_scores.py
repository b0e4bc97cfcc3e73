"""Hand-derived cases of the scalar scores."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import scores as C
from sqlgauge.functions.sqltext import near_names, with_table_score
from sqlgauge.plans import reward as W

lit = F.lit


@pytest.mark.parametrize("a, b, want", [
    ("1", "1.0009", True), ("1", "1.0011", False), ("0", "1e-7", True), ("NaN", "NaN", True), ("NaN", "nan", False), ("NaN", "1", False),
    ("100", "100.0", True), (None, None, True), ("None", None, False), ("1d", "1", False), (" 7 ", "7", True)])
def test_cells_close(evaluate, a, b, want):
    assert evaluate(C.cells_close, a, b) is want


@pytest.mark.parametrize("n, want", [(1000, 0), (1639, 0), (1700, -0.149144), (2048, -1), (2457, -2)])
def test_length_reward(evaluate, n, want):
    assert evaluate(lambda _: C.length_reward(lit(n)), "x") == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("sim, want", [(0.97, 0.97), (0.96, 0.96), (0.95, 0.76), (0.90, 0.72), (0.8999, 0)])
def test_similarity_reward(evaluate, sim, want):
    assert evaluate(lambda _: C.similarity_reward(lit(sim)), "x") == pytest.approx(want)


def _set(*xs):
    return F.array(*[lit(x) for x in xs]).cast("array<string>")


@pytest.mark.parametrize("pred, gold, mode, want", [
    ("bc", "ab", "recall", 0.5), ("bc", "ab", "jaccard", 1 / 3), ("x", "", "recall", 1), ("", "x", "recall", 0)])
def test_set_score(evaluate, pred, gold, mode, want):
    assert evaluate(lambda _: C.set_score(_set(*pred), _set(*gold), mode), "x") == pytest.approx(want)


def test_table_scores(spark):
    """Exact names count 1, near ones a fixed credit; the same as the plain definition over odd and hot names."""
    rng = random.Random(6)
    base = ["dim_ai_brand_series_df", "dim_ai_brand_series_hf", "orders", "orders_hf", "t", "ab", "ba", "x" * 230,
            "x" * 229 + "y", "customer_1", "customer_2", "1_remotsuc", ""]
    rows = [(i, rng.sample(base, rng.randint(0, 4)), rng.sample(base, rng.randint(0, 4))) for i in range(200)]
    rows += [(1000 + i, ["customer_1", "t"], ["customer_2"]) for i in range(50)]

    def credit(g, preds):
        return g in preds or 0.8 * any(SequenceMatcher(None, g, p).ratio() > 0.85 for p in preds)

    df = spark.createDataFrame(rows, "k int, gold array<string>, pred array<string>")
    got = {r["k"]: r["score"] for r in with_table_score(df, "gold", "pred", "score").collect()}
    assert len(got) == len(rows)
    for k, gold, pred in rows:
        want = 1 if not gold else 0 if not pred else sum(credit(g, pred) for g in gold) / len(gold)
        assert got[k] == pytest.approx(want), (gold, pred)
    pairs = [(r["gold_name"], r["pred_name"]) for r in near_names(df, "gold", "pred").collect()]
    assert len(pairs) == len(set(pairs)) and ("customer_1", "customer_2") in pairs and ("ab", "ba") not in pairs


def test_rule_score(evaluate):
    got = evaluate(lambda _: C.rule_score(lit(0.8), lit(1.0), lit(0.5), lit(1.0), lit(True)), "x")
    assert got == pytest.approx(0.84)


def test_schema_score(evaluate):
    assert evaluate(lambda _: C.schema_score(lit(3.0), lit(3), lit(5)), "x") == pytest.approx(0.882353, abs=1e-6)


@pytest.mark.parametrize("g, p, want", [(10, 10, 1), (10, 0, 0), (10, 20, 0.827853), (1, 100, 0.419894)])
def test_row_count_score(evaluate, g, p, want):
    assert evaluate(lambda _: C.row_count_score(lit(g), lit(p)), "x") == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("n_true, n_false, want", [(2, 1, True), (1, 1, None), (1, 0, True), (0, 0, None)])
def test_majority(evaluate, n_true, n_false, want):
    assert evaluate(lambda _: C.majority(lit(n_true), lit(n_false)), "x") is want


@pytest.mark.parametrize("answer, gold, task, valid, want", [
    ("text", "text", "clarify", False, 1), ("text", "SELECT 1", "sql", False, 0), ("SELECT 1", "any", "sql", True, 1),
    ("SELECT 1", "any", "degenerate_dim", True, 0), ("SELEC 1", "any", "degenerate_dim", False, 1),
    ("text", "SELECT 1 不支持查询", "sql", False, 1)])
def test_grammar_reward(evaluate, answer, gold, task, valid, want):
    got = evaluate(lambda c, g: C.grammar_reward(c, g, lit(task), lit(valid)), f"<answer>{answer}</answer>", gold)
    assert got == want


def test_dense_of_two_empty_results_is_zero(evaluate):
    assert evaluate(lambda _: C.dense_score(lit(1.0), lit(1.0), lit(1.0), lit(True)), "x") == 0


def test_total_and_dispatch(evaluate):
    parts = {"accuracy": lit(1.0), "format": lit(1.0), "grammar": lit(1.0), "length": lit(0.0)}
    assert evaluate(lambda _: C.total_reward(parts), "x") == pytest.approx(3.4)
    assert evaluate(lambda _: W.sql_reward(lit(False), lit(0.6)), "x") == pytest.approx(0.3)
    assert evaluate(lambda _: W.multi_step_reward(lit(0.8), lit(None).cast("double")), "x") == pytest.approx(0.4)


def test_cosine_of_missing_or_zero_vectors(evaluate):
    v = F.array(lit(1.0), lit(0.0))
    assert evaluate(lambda _: C.cosine(v, F.array(lit(0.0), lit(0.0))), "x") == 0
    assert evaluate(lambda _: C.cosine(v, F.array().cast("array<double>")), "x") == 0
    assert evaluate(lambda _: C.cosine(v, lit(None).cast("array<double>")), "x") == 0
