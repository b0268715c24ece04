"""Classification of single events, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and tables below decide results and must stay as they are.
GATHERING_WORDS = ("read_file", "search_docs", "web_search", "search_codebase", "list_files", "glob",
                   "grep", "find", "cat", "head", "tail", "read", "fetch", "get", "list", "ls", "describe")
EXECUTING_WORDS = ("write_file", "edit_file", "edit", "write", "create_file", "run_code", "execute", "bash",
                   "shell", "npm", "pip", "install", "build", "compile", "generate")
VERIFYING_WORDS = ("run_tests", "test", "pytest", "jest", "check", "lint", "validate", "verify", "review",
                   "diff", "compare")
DELIVERING_WORDS = ("commit", "git_commit", "push", "deploy", "publish", "submit", "send", "deliver",
                    "output", "summarize")
STRONG_EXECUTING = ("write", "edit", "write_file", "edit_file", "create_file", "bash")
STRONG_VERIFYING = ("pytest", "jest", "run_tests")
STRONG_DELIVERING = ("commit", "git_commit", "push", "deploy")
PHASES = ("idle", "gathering", "planning", "executing", "verifying", "delivering")

STAGE_OF_TOOL = {
    "read_file": "perception", "read": "perception", "grep": "perception", "glob": "perception",
    "find": "perception", "search": "perception", "cat": "perception", "head": "perception",
    "tail": "perception", "ls": "perception", "list_files": "perception",
    "reasoning": "decision_making", "planning": "decision_making", "thinking": "decision_making",
    "edit": "action", "write": "action", "write_file": "action", "bash": "action", "shell": "action",
    "pytest": "feedback", "test": "feedback", "lint": "feedback", "commit": "feedback", "push": "feedback"}
STAGE_OF_EVENT = {
    "file_read": "perception", "file_write": "action", "shell_command": "action", "tool_call": "action",
    "memory_load": "perception", "memory_store": "action", "memory_evict": "working_memory",
    "memory_tier_escalation": "working_memory", "evaluation_result": "feedback",
    "contract_event": "decision_making"}
STAGE_OF_ROLE = {"planner": "decision_making", "generator": "action", "evaluator": "feedback",
                 "orchestrator": "decision_making"}

FEEDBACK_TOOLS = ("pytest", "test", "lint", "check", "verify")
FEEDBACK_COMMANDS = (
    "pytest", "python -m pytest", "python -m unittest", "python -m doctest", "npm test", "npm run test",
    "jest", "mocha", "vitest", "cargo test", "go test", "make test", "make check", "rspec",
    "bundle exec rspec", "phpunit", "lint", "eslint", "pylint", "flake8", "mypy", "tsc --noemit", "ruff",
    "black --check", "isort --check", "grep -r", "git diff", "git status", "curl ", "wget ")

READ_VERBS = ("open", "goto", "scroll_down", "scroll_up", "search_dir", "search_file", "find_file", "ls",
              "cat", "grep", "head", "tail")
WRITE_VERBS = ("edit", "create", "insert", "append")
TERMINAL_VERBS = ("submit",)
MARKERS = ("phase_boundary", "session_start", "session_end")
MEMORY_EVENTS = ("memory_load", "memory_store", "memory_evict", "memory_tier_escalation")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """True when any of the words occurs in the text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def mapped(key: Column, table: dict[str, str]) -> Column:
    chain = F
    for k, v in table.items():
        chain = chain.when(key == k, v)
    return chain


def truncated_path(path: Column, depth: int = 2) -> Column:
    """The last ``depth`` parts of a path; ``unknown`` when there is none."""
    parts = F.split(F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), "/")
    kept = F.array_join(F.slice(parts, -F.least(F.size(parts), F.lit(depth)), depth), "/")
    return F.when(path.isNull() | (path == ""), "unknown").otherwise(kept)


def namespace_of(uri: Column, scheme: str = "memory://") -> Column:
    """The first three parts of a memory address."""
    bare = F.trim(F.replace(uri, F.lit(scheme), F.lit("")), F.lit("/"))
    return F.array_join(F.slice(F.split(bare, "/"), 1, 3), "/")


def symbol_of(e: dict[str, Column]) -> Column:
    """The categorical symbol of an event; ``e`` maps field names to columns."""
    def named(prefix: str, field: str, default: str = "unknown") -> Column:
        return F.concat(F.lit(prefix), F.coalesce(F.when(e[field] != "", e[field]), F.lit(default)))

    kind = e["event_type"]
    made = (
        F.when(kind == "tool_call", named("tool:", "tool_name"))
        .when(kind == "file_read", F.concat(F.lit("read:"), truncated_path(e["target_path"])))
        .when(kind == "file_write", F.concat(F.lit("write:"), truncated_path(e["target_path"])))
        .when(kind == "shell_command", named("shell:", "tool_name", "cmd"))
        .when(kind == "memory_load", F.concat(named("mem_load:", "memory_tier", "?"), named(":", "namespace")))
        .when(kind == "memory_store", named("mem_store:", "namespace"))
        .when(kind == "memory_evict", named("mem_evict:", "namespace"))
        .when(kind == "memory_tier_escalation",
              F.concat(named("mem_esc:", "previous_tier", "?"), named(">", "memory_tier", "?")))
        .when(kind == "phase_boundary", named("phase:", "phase"))
        .when(kind == "agent_handoff", named("handoff:", "agent_role"))
        .when(kind == "evaluation_result", named("eval:", "evaluation_criterion", "general"))
        .when(kind == "contract_event", named("contract:", "contract_status"))
        .otherwise(kind))
    return F.coalesce(F.when(e["symbol"] != "", e["symbol"]), made)


def observable_type(kind: Column, tool: Column) -> Column:
    """Event type of a trace event, from its type and tool."""
    low = F.lower(F.coalesce(tool, kind))
    return (
        F.when(kind.isin("reasoning", "planning", "thinking"), "tool_call")
        .when(low.isin(*GATHERING_WORDS), "file_read")
        .when(low.isin("write_file", "edit", "write", "edit_file"), "file_write")
        .when(low.isin("bash", "shell", "run_code", "terminal"), "shell_command")
        .otherwise("tool_call"))


def phase_of(kind: Column, tool: Column) -> Column:
    """Rank of the task phase an event points to (1 gathering .. 5 delivering)."""
    low = F.replace(F.replace(F.lower(tool), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    has = tool.isNotNull() & (tool != "")
    return (
        F.when(kind.isin("reasoning", "planning", "thinking"), 2)
        .when(has & any_of(low, DELIVERING_WORDS), 5)
        .when(has & any_of(low, VERIFYING_WORDS), 4)
        .when(has & any_of(low, EXECUTING_WORDS), 3)
        .when(has & any_of(low, GATHERING_WORDS), 1)
        .when(kind == "output", 5).when(kind == "tool_call", 3).otherwise(2))


def is_strong(kind: Column, tool: Column, phase: Column) -> Column:
    """True when the tool settles the phase on its own."""
    low = F.replace(F.replace(F.lower(F.coalesce(tool, F.lit(""))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return (~kind.isin("reasoning", "planning", "thinking")) & (
        ((phase == 5) & any_of(low, STRONG_DELIVERING)) | ((phase == 4) & any_of(low, STRONG_VERIFYING))
        | ((phase == 3) & any_of(low, STRONG_EXECUTING)))


def phase_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHASES]), rank + 1)


def stage_of(role: Column, tool: Column, kind: Column) -> Column:
    """Processing stage: by agent role, then tool, then event type."""
    return F.coalesce(mapped(role, STAGE_OF_ROLE), mapped(F.lower(tool), STAGE_OF_TOOL),
                      mapped(kind, STAGE_OF_EVENT), F.lit("action"))


def is_feedback(tool: Column, kind: Column, path: Column, command: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(path, F.lit("")), F.lit(" "), F.coalesce(command, F.lit(""))))
    return (F.lower(F.coalesce(tool, F.lit(""))).isin(*FEEDBACK_TOOLS) | kind.isin("error", "evaluation_result")
            | any_of(text, FEEDBACK_COMMANDS))


def verb_class(verb: Column) -> Column:
    low = F.lower(verb)
    return (F.when(low.isin(*READ_VERBS), "file_read").when(low.isin(*WRITE_VERBS), "file_write")
            .when(low.isin(*TERMINAL_VERBS), "tool_call").otherwise("shell_command"))


def output_hash(given: Column, tool: Column, tokens_out: Column, success: Column) -> Column:
    """The given output hash, or a digest of tool, tokens and success."""
    flag = F.when(success, "True").otherwise("False")
    raw = F.concat_ws(":", F.coalesce(tool, F.lit("None")), tokens_out.cast("string"), flag)
    return F.coalesce(given, F.md5(raw))


# File categories in the order they are tried.
PATH_CATEGORIES = {
    "test": ("test", "spec", "conftest"),
    "frontend": (".tsx", ".jsx", ".ts", ".js", ".css", ".html", "frontend", "src/component"),
    "backend": (".py", "backend", "routes/", "main.py", "server.py"),
    "config": ("docker", "compose", ".yml", ".yaml", "readme"),
    "database": (".sql", "database", "migration")}


def path_category(path: Column) -> Column:
    low = F.lower(path)
    chain = F.when(path.isNull() | (path == ""), "")
    for name, words in PATH_CATEGORIES.items():
        chain = chain.when(any_of(low, words), name)
    return chain.otherwise("other")
