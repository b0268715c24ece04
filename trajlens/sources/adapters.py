"""Trace formats to the canonical event table.

Every adapter takes raw records ``(session_id, line, raw)``, where ``raw`` is one JSON
object and ``line`` its position, and returns ordered events. Formats are told apart
per session by the first record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlens.sequence import Ordered, number_rows

EVENT_SCHEMA = ("session_id string, step long, type string, tool string, latency_ms double, success boolean, tokens_in long, "
                "tokens_out long, timestamp double, output_hash string, input_hash string, goal_text string, error_message string, "
                "agent_id string, target_path string")
EVENT_COLUMNS = [c.split()[0] for c in EVENT_SCHEMA.split(", ")][2:]
BLOCKS = ("array<struct<type: string, id: string, name: string, input: string, tool_use_id: string, is_error: boolean, "
          "content: string, text: string, thinking: string>>")
CALLS = "array<struct<id: string, function: struct<name: string, arguments: string>>>"

# Tools by what they do, and file names shown with their folder.
READ_TOOLS = ("read_file", "read", "cat", "head", "tail", "search_docs", "web_search", "search_codebase", "list_files", "glob",
              "grep", "find", "ls", "fetch", "get", "list", "describe")
WRITE_TOOLS = ("write_file", "write", "edit", "edit_file")
SHELL_TOOLS = ("bash", "shell", "run_code", "terminal")
GENERIC_FILES = ("__init__.py", "index.js", "index.ts", "mod.rs", "main.py", "main.go", "main.rs", "setup.py", "conftest.py")


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """Records of JSON-lines files: file, position and text.

    The position is the split's start in the file and the running row number of the
    scan, which keeps file order however the file is split.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    placed = lines.select(
        F.col("_metadata.file_path").alias("session_id"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    return number_rows(placed, ["session_id"], ["_block", "_row"], "line").result().select("session_id", "line", "raw")


def read_arrays(spark: SparkSession, root: str) -> DataFrame:
    """Records of files that each hold one JSON array."""
    whole = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
    items = F.from_json("value", "array<string>")
    return whole.select(F.col("_metadata.file_path").alias("session_id"), F.posexplode(items).alias("_at", "raw")).select(
        "session_id", (F.col("_at") + 1).cast("long").alias("line"), "raw")


def _field(name: str) -> Column:
    return F.get_json_object("raw", f"$.{name}")


def words(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def _hash(text: Column) -> Column:
    return F.md5(text)


def _events(rows: DataFrame, order: list[str], **cols: Column) -> Ordered:
    """Canonical columns from the given ones, defaults for the rest, numbered per session."""
    defaults = {"latency_ms": F.lit(0.0), "success": F.lit(True), "tokens_in": F.lit(0), "tokens_out": F.lit(0)}
    types = dict(c.split() for c in EVENT_SCHEMA.split(", "))
    made = [cols.get(c, defaults.get(c, F.lit(None))).cast(types[c]).alias(c) for c in EVENT_COLUMNS]
    numbered = number_rows(rows.select("session_id", *order, *made), ["session_id"], order)
    return numbered.on(numbered.df.select("session_id", "step", *EVENT_COLUMNS))


def native(records: DataFrame) -> Ordered:
    """Event dictionaries that already have the canonical keys; other keys are dropped."""
    fields = ", ".join(c for c in EVENT_SCHEMA.split(", ")[1:])
    parsed = records.select("session_id", "line", F.from_json("raw", fields).alias("e"))
    cols = {c: F.col(f"e.{c}") for c in EVENT_COLUMNS}
    for c, v in (("latency_ms", 0.0), ("success", True), ("tokens_in", 0), ("tokens_out", 0)):
        cols[c] = F.coalesce(cols[c], F.lit(v))
    return _events(parsed, ["line"], **cols)


def block_messages(records: DataFrame) -> Ordered:
    """Chat messages whose content is text or a list of typed blocks."""
    msgs = records.select("session_id", "line", _field("role").alias("role"), _field("content").alias("content"))
    parsed = msgs.withColumn("blocks", F.when(F.startswith("content", F.lit("[")), F.from_json("content", BLOCKS)))
    plain = parsed.where(F.col("blocks").isNull() & F.col("content").isNotNull()).select(
        "session_id", "line", F.lit(0).alias("at"), F.lit("assistant").alias("role"), F.lit("plain").alias("kind"), F.col("content").alias("body"),
        *[F.lit(None).cast("string").alias(c) for c in ("name", "input", "tool_use_id")], F.lit(False).alias("is_error"))
    blocks = parsed.where(F.col("blocks").isNotNull()).select("session_id", "line", "role", F.posexplode("blocks").alias("at", "b")).select(
        "session_id", "line", "at", "role", F.col("b.type").alias("kind"),
        F.coalesce("b.thinking", "b.text", _joined_text(F.col("b.content"))).alias("body"), F.col("b.name").alias("name"),
        F.col("b.input").alias("input"), F.col("b.tool_use_id").alias("tool_use_id"), F.coalesce("b.is_error", F.lit(False)).alias("is_error"))
    kind, role = F.col("kind"), F.col("role")
    rows = plain.unionByName(blocks).where(
        kind.isin("plain", "tool_use", "tool_result", "thinking") | ((kind == "text") & (role == "assistant")))
    use, result = kind == "tool_use", kind == "tool_result"
    return _events(
        rows, ["line", "at"],
        type=F.when(use | result, "tool_call").when(kind == "thinking", "planning").otherwise("reasoning"),
        tool=F.when(use, F.coalesce("name", F.lit("unknown_tool"))).when(result, F.coalesce("tool_use_id", F.lit("tool_result"))),
        success=F.when(result, ~F.col("is_error")).otherwise(True), tokens_in=F.when(use, words(F.col("input"))).otherwise(0),
        tokens_out=F.when(use, 0).otherwise(words(F.col("body"))), output_hash=F.when(use, _hash(F.coalesce("input", F.lit("{}")))),
        error_message=F.when(result & F.col("is_error"), F.col("body")))


def _joined_text(content: Column) -> Column:
    """Content that is text, or the texts of a list joined by blanks."""
    parts = F.from_json(content, "array<struct<text: string>>")
    listed = F.concat_ws(" ", F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))))
    return F.when(F.startswith(content, F.lit("[")), listed).otherwise(content)


def call_messages(records: DataFrame) -> Ordered:
    """Chat messages with ``tool_calls`` and tool answers."""
    msgs = records.select("session_id", "line", _field("role").alias("role"), _field("content").alias("content"),
                          _field("tool_call_id").alias("tool_call_id"), F.from_json(_field("tool_calls"), CALLS).alias("calls"))
    none = F.coalesce(F.size("calls"), F.lit(0)) <= 0
    empty = F.lit(None).cast("string")
    said = msgs.where((F.col("role") == "assistant") & (F.coalesce("content", F.lit("")) != "") & none).select(
        "session_id", "line", F.lit(-1).alias("at"), F.lit("text").alias("kind"), "content", empty.alias("name"), empty.alias("arguments"))
    called = msgs.where(~none).select("session_id", "line", F.posexplode("calls").alias("at", "c")).select(
        "session_id", "line", "at", F.lit("call").alias("kind"), empty.alias("content"), F.coalesce("c.function.name", F.lit("unknown_tool")).alias("name"),
        F.coalesce("c.function.arguments", F.lit("")).alias("arguments"))
    answered = msgs.where(F.col("role") == "tool").select(
        "session_id", "line", F.lit(1 << 30).alias("at"), F.lit("answer").alias("kind"), "content",
        F.coalesce("tool_call_id", F.lit("tool_response")).alias("name"), empty.alias("arguments"))
    call = F.col("kind") == "call"
    return _events(
        said.unionByName(called).unionByName(answered), ["line", "at"],
        type=F.when(F.col("kind") == "text", "reasoning").otherwise("tool_call"), tool=F.col("name"),
        tokens_in=F.when(call, words(F.col("arguments"))).otherwise(0), tokens_out=F.when(call, 0).otherwise(words(F.col("content"))),
        output_hash=F.when(call, _hash(F.col("arguments"))))


def callback_runs(records: DataFrame) -> Ordered:
    """Callback runs of type tool, llm, chain or other."""
    r = records.select("session_id", "line", *[_field(n).alias(n) for n in ("run_type", "name", "inputs", "outputs", "error", "latency_ms", "total_tokens")])
    kind = F.col("run_type")
    tool = F.coalesce("name", F.lit("unknown"))
    return _events(
        r, ["line"], type=F.when(kind == "llm", "reasoning").when(kind == "chain", "planning").otherwise("tool_call"),
        tool=F.when(kind != "llm", tool), latency_ms=F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0)), success=F.col("error").isNull(),
        tokens_in=F.coalesce(F.col("total_tokens").cast("long"), words(F.col("inputs"))), tokens_out=words(F.col("outputs")),
        output_hash=F.when(kind == "tool", _hash(F.coalesce("outputs", F.lit("{}")))), error_message=F.col("error"))


def session_records(records: DataFrame) -> Ordered:
    """Raw session logs: nested messages, tool uses matched with their results.

    A use finds its result by session and id. Its latency is the time between the
    two, its output hash is taken from the result, and it fails if the result says so.
    """
    ts = F.try_to_timestamp(_field("timestamp"))
    content = F.get_json_object("raw", "$.message.content")
    base = records.select("session_id", "line", _field("type").alias("kind"), ts.alias("ts"), content.alias("content"),
                          F.get_json_object("raw", "$.message.usage.input_tokens").cast("long").alias("tin"),
                          F.get_json_object("raw", "$.message.usage.output_tokens").cast("long").alias("tout"))
    started = base.where(F.col("ts").isNotNull()).groupBy("session_id").agg(F.min_by("ts", "line").alias("t0"))
    listed = base.where(F.startswith("content", F.lit("["))).select(
        "session_id", "line", "kind", "ts", "tin", "tout", F.posexplode(F.from_json("content", BLOCKS)).alias("at", "b"))
    block = F.col("b.type")
    said = listed.where((F.col("kind") == "assistant") & (
        block.isin("tool_use", "thinking") | ((block == "text") & (F.trim("b.text") != "")))).select(
        "session_id", "line", "at", "ts", "tin", "tout", block.alias("what"), F.coalesce("b.thinking", "b.text").alias("body"),
        F.coalesce("b.name", F.lit("unknown")).alias("name"), F.col("b.id").alias("use_id"), F.col("b.input").alias("input"))
    typed = base.where((F.col("kind") == "user") & ~F.startswith("content", F.lit("[")) & (F.trim("content") != "")).select(
        "session_id", "line", F.lit(0).alias("at"), "ts", "tin", "tout", F.lit("user").alias("what"), F.col("content").alias("body"),
        *[F.lit(None).cast("string").alias(c) for c in ("name", "use_id", "input")])
    results = listed.where((F.col("kind") == "user") & (block == "tool_result")).select(
        "session_id", F.col("b.tool_use_id").alias("use_id"), "line", F.col("ts").alias("done"),
        F.coalesce("b.is_error", F.lit(False)).alias("failed"), _joined_text(F.col("b.content")).alias("result"))
    last = results.groupBy("session_id", "use_id").agg(F.max_by(F.struct("done", "failed", "result"), "line").alias("r"))
    rows = said.unionByName(typed).join(last, ["session_id", "use_id"], "left").join(started, "session_id", "left")
    use = F.col("what") == "tool_use"
    gap = (F.unix_micros("r.done") - F.unix_micros("ts")) / 1000.0
    given = F.md5("input")
    failed = use & F.coalesce("r.failed", F.lit(False))
    return _events(
        rows, ["line", "at"],
        type=F.when(use, "tool_call").when(F.col("what") == "thinking", "planning").when(F.col("what") == "user", "user_input").otherwise("reasoning"),
        tool=F.when(use, F.col("name")), latency_ms=F.when(use, F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0))).otherwise(0.0), success=~failed,
        tokens_in=F.when(use, F.coalesce("tin", F.lit(0))).otherwise(0), tokens_out=F.when(F.col("what") == "user", 0).otherwise(F.coalesce("tout", F.lit(0))),
        timestamp=F.greatest((F.unix_micros("ts") - F.unix_micros("t0")) / 1e6, F.lit(0.0)),
        output_hash=F.when(use, F.coalesce(F.when(F.col("r.result") != "", F.md5("r.result")), given)),
        input_hash=F.when(use, given),
        goal_text=F.when(use, goal_of_input(F.col("name"), F.col("input"))).when(F.col("what") == "user", F.col("body")).otherwise(
            goal_of_thought(F.col("body"))),
        error_message=F.when(failed, F.col("r.result")))


def first_in_first_out(ev: Ordered, use: Column, result: Column) -> DataFrame:
    """Results without ids, each with the oldest call still open: ``step`` of the result and ``use_step``, null for an orphan.

    A result that finds no open call is an orphan: the difference of calls and
    results so far reaches a new low. The n-th other result belongs to the n-th call.
    """
    marked = ev.with_columns(_use=use, _result=result & ~use)
    balance = marked.running(_open=("sum", F.when(F.col("_use"), 1).when(F.col("_result"), -1).otherwise(0)))
    low = balance.running(exclusive=True, _low=("min", F.col("_open")))
    orphan = F.col("_result") & (F.col("_open") < F.least(F.lit(0), F.coalesce("_low", F.lit(0))))
    told = low.with_columns(_orphan=orphan)
    ranked = told.running(_nth_use=("count", F.when(F.col("_use"), 1)), _nth_result=("count", F.when(F.col("_result") & ~F.col("_orphan"), 1))).df
    keys = list(ev.keys)
    uses = ranked.where("_use").select(*keys, F.col("_nth_use").alias("_nth"), F.col(ev.order).alias("use_step"))
    results = ranked.where("_result").select(*keys, ev.order, F.when(~F.col("_orphan"), F.col("_nth_result")).alias("_nth"))
    return results.join(uses, [*keys, "_nth"], "left").drop("_nth")


def goal_of_thought(text: Column) -> Column:
    """The first sentence or line of 11-199 characters, else the whole text."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    dot, line = F.locate(".", t) - 1, F.locate("\n", t) - 1
    return (F.when((dot > 10) & (dot < 200), F.substring(t, F.lit(1), dot + 1)).when((line > 10) & (line < 200), F.substring(t, F.lit(1), line + 1))
            .when(F.length(t) > 10, t))


def short_path(path: Column) -> Column:
    """The file name, with its folder when the name alone says little."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    name = F.element_at(parts, -1)
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    return F.when(name.isin(*GENERIC_FILES) & (F.coalesce(folder, F.lit("")) != ""), F.concat(folder, F.lit("/"), name)).otherwise(name)


def goal_of_input(tool: Column, data: Column) -> Column:
    """What a tool call is for, read from its input."""
    def get(name: str) -> Column:
        return F.nullif(F.get_json_object(data, f"$.{name}"), F.lit(""))

    path = short_path(F.get_json_object(data, "$.file_path"))

    def lines(name: str) -> Column:
        text = F.coalesce(F.get_json_object(data, f"$.{name}"), F.lit(""))
        return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")))

    edit = F.concat(path, F.lit(" (+"), lines("new_string").cast("string"), F.lit("/-"), lines("old_string").cast("string"), F.lit(" lines)"))
    within = F.concat(F.lit(" in "), short_path(get("path")))
    return (F.when(tool == "Task", F.coalesce(get("description"), get("prompt"))).when(tool.isin("Read", "Write"), F.nullif(path, F.lit("")))
            .when(tool == "Edit", edit).when(tool == "Bash", F.coalesce(get("description"), get("command")))
            .when(tool == "Grep", F.concat(F.lit("/"), get("pattern"), F.lit("/"), F.coalesce(within, F.lit(""))))
            .when(tool == "Glob", F.concat(get("pattern"), F.coalesce(within, F.lit(""))))
            .when(tool == "WebSearch", F.concat(F.lit('"'), get("query"), F.lit('"'))).when(tool == "WebFetch", get("url")))


def formats(records: DataFrame) -> DataFrame:
    """The format of each session, from its first record."""
    first = records.groupBy("session_id").agg(F.min_by("raw", "line").alias("raw"))
    content, role = _field("content"), _field("role")
    kind = (F.when(role.isNotNull() & F.startswith(content, F.lit("[")), "blocks")
            .when(_field("run_type").isNotNull() & _field("name").isNotNull(), "runs")
            .when(role.isNotNull(), "calls").when(F.get_json_object("raw", "$.message").isNotNull(), "session")
            .when(_field("step").isNotNull() & _field("type").isNotNull(), "native"))
    return first.select("session_id", kind.alias("format"))


ADAPTERS = {"native": native, "blocks": block_messages, "calls": call_messages, "runs": callback_runs, "session": session_records}


def auto(records: DataFrame) -> DataFrame:
    """Events of records in any of the formats, each session by its own adapter."""
    known = records.join(formats(records), "session_id")
    out = None
    for name, adapter in ADAPTERS.items():
        part = adapter(known.where(F.col("format") == name).drop("format")).df
        out = part if out is None else out.unionByName(part)
    return out


def observable_kind(kind: Column, tool: Column) -> Column:
    low = F.lower(F.coalesce(tool, kind))
    return (F.when(kind.isin("reasoning", "planning", "thinking"), "tool_call").when(low.isin(*READ_TOOLS), "file_read")
            .when(low.isin(*WRITE_TOOLS), "file_write").when(low.isin(*SHELL_TOOLS), "shell_command").otherwise("tool_call"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines ledger; lines that do not parse are left out, ``bad_ledger_lines`` has them."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def bad_ledger_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of a JSON-lines ledger that do not parse, as they are written."""
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, _corrupt_record string").alias("r"))
    return parsed.where("r._corrupt_record IS NOT NULL").select(F.col("r._corrupt_record").alias("line"))


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Rows (variant, z, tpr, fpr, accuracy, latency) of a threshold-sweep summary."""
    series = "struct<tpr: array<double>, fpr: array<double>, sig_accuracy: array<double>, latency_median: array<double>>"
    s = spark.read.option("multiLine", "true").schema(f"thresholds array<double>, overall {series}, by_failure map<string, {series}>").json(path)
    every = s.select("thresholds", F.explode(F.map_concat(F.create_map(F.lit("overall"), F.col("overall")), "by_failure")).alias("variant", "v"))
    zipped = F.arrays_zip(F.col("thresholds"), F.col("v.tpr").alias("tpr"), F.col("v.fpr").alias("fpr"), F.col("v.sig_accuracy").alias("acc"),
                          F.col("v.latency_median").alias("lat"))
    return every.select("variant", F.explode(zipped).alias("p")).select(
        "variant", F.col("p.thresholds").alias("z"), "p.tpr", "p.fpr", F.col("p.acc").alias("accuracy"), F.col("p.lat").alias("latency"))


def annotation_replies(replies: DataFrame, codes: DataFrame) -> DataFrame:
    """Annotations inside text replies, with what is wrong with each; unknown codes are emptied."""
    bare = F.regexp_replace("reply", r"(?s)^\s*```[a-z]*\s*|\s*```\s*$", "")
    item = "array<struct<session_id: string, has_failure: boolean, code: string, onset_step: int, severity: int, confidence: int>>"
    rows = replies.select(F.inline(F.from_json(bare, item)))
    known = rows.join(codes.select("code", F.lit(True).alias("_known")), "code", "left")
    failed = F.coalesce("has_failure", F.lit(False))
    wrong = F.filter(F.array(
        F.when(F.col("session_id").isNull(), "missing session"), F.when(F.col("has_failure").isNull(), "missing verdict"),
        F.when(failed & F.col("_known").isNull(), "unknown code"), F.when(failed & ~F.coalesce(F.col("severity").between(1, 5), F.lit(False)), "severity out of range"),
        F.when(failed & ~F.coalesce(F.col("confidence").between(1, 5), F.lit(False)), "confidence out of range")), lambda x: x.isNotNull())
    return known.select("session_id", "has_failure", F.when(F.col("_known"), F.col("code")).alias("code"), "onset_step", "severity", "confidence",
                        wrong.alias("issues"))
