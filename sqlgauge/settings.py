"""Fixed values and configuration shared by all modules."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: markers, tags and phrases of the corpus text format -------
SCHEMA_MARKER = "--- 2.schema kg"
KNOWLEDGE_MARKER = "--- 3.knowledge graph"
DOMAIN_MARKER = "--- 4.domain kg"
DATA_MARKER = "--- 5.data kg"
FEW_SHOT_MARKER = "--- 6.few shot"
QUESTION_OPEN = "问题："
QUESTION_CLOSE = "，写出对应的SQL语句"
FORMULA_ANCHOR = "计算逻辑："
CONSTRAINT_LABEL = "必备约束："
NO_CONSTRAINT = "无"
YES_WORD = "是"
THOUGHT_TAG = "[思考过程]"
CLARIFY_TAG = "[澄清问题]"
CONCLUSION_TAG = "[结论]"
REFUSAL_SENTENCE = "由于缺少对应的指标定义"
UNSUPPORTED_PHRASE = "不支持查询"
CANNOT_EXTRACT = "无法提取"
CANNOT_REWRITE = "无法改写"
EMPTY_ANSWER_TAGS = ("<think>", "</think>", "<answer>", "</answer>")

# Type strings used by reward rows and evaluation rows, by task.
REWARD_TYPES = {
    "SQL": "sql",
    "反思数据": "reflection",
    "多步推理": "multi_step",
    "维度退化": "degenerate_dim",
    "指标拒识": "metric_reject",
    "追问_必备约束": "constraint_ask",
    "歧义澄清": "clarify",
    "维度拒识": "dim_reject",
}
EVAL_TYPES = {
    "sql": "sql",
    "反思数据": "reflection",
    "多步推理": "multi_step",
    "维度退化": "degenerate_dim",
    "歧义澄清": "clarify",
}
# -----------------------------------------------------------------------------

TASKS = (
    "sql",
    "reflection",
    "multi_step",
    "degenerate_dim",
    "metric_reject",
    "constraint_ask",
    "clarify",
    "dim_reject",
)
SQL_TASKS = ("sql", "reflection", "multi_step", "degenerate_dim")
#: Rewarded for what their statement returns.
EXECUTED_TASKS = ("sql", "reflection", "multi_step")
BOUNDARY_TASKS = ("metric_reject", "constraint_ask", "clarify", "dim_reject")

EVAL_ROUTES = {
    "sql": "exec",
    "reflection": "exec",
    "multi_step": "exec",
    "degenerate_dim": "judge",
    "clarify": "semantic",
}

# What tells a task type from the others, for a reader that must rule them out.
TASK_DEFINITIONS = {
    "clarify": "a word of the question is known but has several readings, so the reply asks for the one meant",
    "constraint_ask": "a metric is only defined under a condition that is missing, so the reply asks for it",
    "dim_reject": "no field of the schema can filter or group as asked, so the reply declines",
    "metric_reject": "nothing given says how to compute the quantity asked for, so the reply declines",
    "sql": "the reply is a statement that can be run",
}


@dataclass(frozen=True)
class FaultType:
    """A way in which a statement fails: the engine's error condition, and how to bring it about."""

    condition: str
    name: str
    category: str
    instruction: str


# By error condition. One condition stands for several faults where only the text tells them apart.
FAULT_TYPES = (
    FaultType("AMBIGUOUS_REFERENCE", "ambiguous_column", "identifier", "Let a name fit columns of two joined relations."),
    FaultType("CAST_INVALID_INPUT", "type_conversion", "runtime", "Add a number to a column that holds words."),
    FaultType("DIVIDE_BY_ZERO", "division_by_zero", "runtime", "Divide by something that is zero in some row."),
    FaultType("MISSING_AGGREGATION", "invalid_group_by", "runtime", "Show a bare column beside groups of another one."),
    FaultType("NUM_COLUMNS_MISMATCH", "union_column_mismatch", "syntax", "Unite it with a query that is wider or narrower."),
    FaultType("PARSE_SYNTAX_ERROR", "illegal_character", "syntax", "Write a sign such as @ before a token."),
    FaultType("PARSE_SYNTAX_ERROR", "keyword_misspelling", "syntax", "Lose or swap letters of a reserved word."),
    FaultType("PARSE_SYNTAX_ERROR", "operator_deletion", "syntax", "Leave out a comma, bracket or comparison sign."),
    FaultType("UNRESOLVED_ROUTINE", "function_misspelling", "syntax", "Call a function by a name that no function has."),
    FaultType("WINDOW_FUNCTION_WITHOUT_OVER_CLAUSE", "window_without_over", "syntax", "Number rows without a window."),
)

# Conditions that only have a category.
FAULT_CATEGORIES = {
    "PARSE_SYNTAX_ERROR": "syntax",
    "TABLE_OR_VIEW_NOT_FOUND": "identifier",
    "UNRESOLVED_COLUMN": "identifier",
    "UNSUPPORTED_TYPED_LITERAL": "syntax",
}

# Parts of required knowledge per stage, by section name.
REQUIRED_SECTIONS = {
    "clarify": ("schema", "question"),
    "metric_reject": ("schema", "question"),
    "constraint_ask": ("schema", "question", "knowledge", "domain"),
    "multi_step": ("schema", "knowledge", "domain"),
    "reflection": ("schema", "question", "knowledge", "domain"),
}

# --- Fixed values: tolerances, weights and bands of the scores ----------------
CELL_REL_TOL = 1e-3
CELL_ABS_TOL = 1e-6
VALUE_REL_TOL = 0.01
VALUE_ZERO_TOL = 1e-6
JUDGE_ROW_GATE = 31
PREVIEW_ROWS = 10
MAJORITY_RUNS = 3
UNANIMOUS_JUDGES = 2
SIMILARITY_FULL = 0.96
SIMILARITY_PARTIAL = 0.9
SIMILARITY_PARTIAL_FACTOR = 0.8
COLUMN_MATCH_SIM = 0.75
TABLE_RATIO = 0.85
TABLE_RATIO_CREDIT = 0.8
SOFT_MAX_LENGTH = 2048
SOFT_CACHE_LENGTH = 409
RULE_PARTS = ("tables", "columns", "keywords", "literals")
RULE_WEIGHTS = {"table": 0.3, "column": 0.3, "keyword": 0.2, "literal": 0.2}
DENSE_WEIGHTS = {"schema": 0.4, "rows": 0.1, "value": 0.5}
REWARD_WEIGHTS = {"accuracy": 1.5, "format": 1.0, "grammar": 0.9, "length": 0.8}
# -----------------------------------------------------------------------------
