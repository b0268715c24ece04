"""Failure types, task domains and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, category, failure, observable, processing stage.
FAILURE_TYPES = (
    ("1.1", "perception", "input_misparse", False, "perception"),
    ("1.2", "perception", "context_blindness", False, "perception"),
    ("1.3", "perception", "selective_attention", False, "perception"),
    ("1.4", "perception", "format_confusion", False, "perception"),
    ("2.1", "memory", "context_loss", True, "attention"),
    ("2.2", "memory", "step_repetition", True, "working_memory"),
    ("2.3", "memory", "state_amnesia", False, "working_memory"),
    ("2.4", "memory", "goal_drift", True, "decision_making"),
    ("3.1", "decision", "wrong_tool_selection", False, "decision_making"),
    ("3.2", "decision", "overconfidence", False, "decision_making"),
    ("3.3", "decision", "confirmation_bias", False, "decision_making"),
    ("3.4", "decision", "analysis_paralysis", True, "decision_making"),
    ("3.5", "decision", "strategic_myopia", True, "decision_making"),
    ("4.1", "execution", "tool_misuse", True, "action"),
    ("4.2", "execution", "error_cascade", True, "feedback"),
    ("4.3", "execution", "recovery_failure", True, "feedback"),
    ("4.4", "execution", "resource_exhaustion", True, "working_memory"),
    ("5.1", "plan_structure", "incomplete_plan", False, "decision_making"),
    ("5.2", "plan_structure", "wrong_ordering", False, "decision_making"),
    ("5.3", "plan_structure", "missing_verification", True, "feedback"),
    ("5.4", "plan_structure", "premature_termination", True, "feedback"),
    ("6.1", "coordination", "subtask_interference", False, "action"),
    ("6.2", "coordination", "delegation_failure", False, "action"),
    ("6.3", "coordination", "scope_creep", False, "action"),
    ("6.4", "coordination", "reasoning_action_mismatch", True, "decision_making"),
    ("7.1", "communication", "incomplete_output", False, "feedback"),
    ("7.2", "communication", "wrong_audience", False, "feedback"),
    ("7.3", "communication", "missing_explanation", False, "feedback"),
    ("7.4", "communication", "hallucinated_status", False, "feedback"),
    ("8.1", "metacognition", "capability_mismatch", False, "decision_making"),
    ("8.2", "metacognition", "incomplete_model", False, "decision_making"),
    ("8.3", "metacognition", "monitoring_failure", False, "decision_making"),
    ("8.4", "metacognition", "strategy_fixation", True, "decision_making"))
CODE_OF_BATCH_FAILURE = {"LOOP": "2.2", "TOOL_THRASH": "4.1", "STALL": "4.4", "DRIFT": "2.4", "CASCADE": "4.2",
                         "TOKEN_EXPLOSION": "4.4", "DEAD_END": "3.4", "RECOVERY_FAILURE": "4.3"}
DOMAIN_OF_TASK = {"rest_api": "web_app", "react_dashboard": "web_app", "chat_app": "web_app", "fullstack_auth": "web_app",
                  "markdown_docs": "docs", "bash_utility": "devops", "ci_cd_setup": "devops", "unit_test_suite": "testing",
                  "api_test_harness": "testing", "cli_data_processor": "cli_tool", "etl_pipeline": "data_pipeline",
                  "ml_pipeline": "data_pipeline", "game_physics": "game"}
VARIANTS = ("loop", "drift", "thrash", "stall", "clean")
SIGNATURE_SEVERITY = {"mechanical_repetition": "red", "stagnation": "red", "context_thrashing": "red",
                      "incoherent_exploration": "red", "distributional_shift": "yellow", "goal_discontinuity": "yellow",
                      "action_cycling": "yellow", "tight_iteration": "yellow", "unclassified_anomaly": "yellow"}


def failure_types(spark: SparkSession) -> DataFrame:
    """The fixed table of failure types."""
    return spark.createDataFrame(FAILURE_TYPES, "code string, category string, failure string, observable boolean, stage string")


def task_of(name: Column) -> Column:
    return F.regexp_replace(name, "_(" + "|".join(VARIANTS) + ")$", "")


def variant_of(name: Column) -> Column:
    found = F.regexp_extract(name, "_(" + "|".join(VARIANTS) + ")$", 1)
    return F.when(found != "", found).otherwise("unknown")


def domain_of(task: Column) -> Column:
    chain = F
    for k, v in DOMAIN_OF_TASK.items():
        chain = chain.when(task == k, v)
    return chain.otherwise("unknown")


def signature_colour(signature: Column) -> Column:
    chain = F
    for k, v in SIGNATURE_SEVERITY.items():
        chain = chain.when(signature == k, v)
    return chain.otherwise("yellow")
