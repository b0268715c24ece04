"""Text functions of chat turns, commands and logs, as Column expressions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlens.functions.events import any_of

# Patterns and word lists of the text rules.
FENCE = r"(?s)```[a-zA-Z0-9_]*\n?(.*?)```"
QUOTED = r"""["']([^"']+)["']"""
WORKLOAD_ERROR = r"(?i)error|traceback|no such file|command not found|not found|exception"
EPISODE_ERROR = (r"(?i)error|traceback|no such file|command not found|not found|exception|failed|cannot|"
                 r"invalid syntax|permission denied")
OBSERVE_VERBS = ("open", "cat", "scroll_down", "scroll_up", "goto", "head", "tail")
SEARCH_VERBS = ("search_dir", "search_file", "find_file", "grep", "ls")
MUTATE_VERBS = ("edit", "create", "insert", "append")
VERIFY_VERBS = ("python", "pytest", "tox", "make", "nosetests", "test", "grep", "search_dir", "search_file", "find_file")
RUN_VERBS = ("python", "pytest", "tox", "make", "nosetests", "test", "bash")
LEXICON = {
    "observe": ("look", "read", "open", "view", "inspect", "check", "see", "examine"),
    "search": ("search", "find", "locate", "grep", "where"),
    "mutate": ("edit", "change", "modify", "fix", "add", "create", "write", "update", "replace", "implement"),
    "verify": ("run", "execute", "test", "verify", "confirm", "check"),
    "submit": ("submit", "done", "finish", "complete")}
LOG_NOISE = ("Traceback", "INFO -", "WARNING", "pytorch_env)", "$ ", ">>>", "node0", "tensorflow/", "====")
REACTION_NOISE = ("Traceback", "INFO -", "WARNING", "pytorch_env)", "$ ", ">>>", "node0", "tensorflow/")
ENVIRONMENT_ERRORS = ("cancelled: parallel tool call", "<tool_use_error>", "transport endpoint is not connected",
                      "could not connect", "connection refused", "input/output error",
                      "resource temporarily unavailable", "device not configured")
FRUSTRATION = r"(?i)\b(fuck\w*|shit\w*|damn|damnit|goddamn|wtf|bullshit|crap|ugh+)\b"
CORRECTION = (r"(?i)(that'?s not (?:what|right|correct)|that'?s wrong|not what i (?:asked|wanted|said)|"
              r"\bi (?:said|asked you to)\b|you (?:didn'?t|did not) (?:do|follow)|\bundo (?:that|this|it)\b|"
              r"\brevert (?:that|this|it)\b|why did you|you broke|stop doing that)")
POSITIVE_CLOSE = (r"(?i)\b(thanks|thank you|perfect|great|awesome|works?|working|nice|looks good|lgtm|exactly|"
                  r"that'?s it|solved|fixed it|beautiful)\b")
NEGATIVE_CLOSE = (r"(?i)\b(still (?:wrong|broken|not working|failing|doesn'?t work|won'?t)|"
                  r"that'?s (?:wrong|not (?:it|right|what))|not what i|nope\b|doesn'?t work|didn'?t work|broke(?:n)?\b|"
                  r"undo\b|revert\b|frustrat|give up|forget it)")
GIT_UNDO = r"(?i)git\s+(revert|reset\s+--hard|checkout\s+--|restore\b|clean\s+-[a-z]*f)"
SPLIT_SEED = 20260515


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def action_line(text: Column) -> Column:
    """First line of the last fenced block, or null."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FENCE), F.lit(1))
    body = stripped(F.element_at(F.when(F.size(blocks) > 0, blocks), -1))
    line = stripped(F.element_at(F.split(body, r"\r\n|\n|\r"), 1))
    return F.when(line != "", line)


def command_of(line: Column) -> Column:
    return F.regexp_extract(line, r"^(\S+)", 1)


def arguments_of(line: Column) -> Column:
    return stripped(F.regexp_extract(line, r"(?s)^\S+\s+(.*)$", 1))


def first_path(args: Column) -> Column:
    """A quoted argument or the first token, whole; null when empty."""
    quoted = F.regexp_extract(args, QUOTED, 1)
    token = F.regexp_extract(args, r"^\s*(\S+)", 1)
    chosen = F.when(quoted != "", quoted).otherwise(token)
    return F.when(chosen != "", chosen)


def base_name(path: Column) -> Column:
    """Last part of a path; the whole text when that part is empty."""
    last = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.when(path.isNull(), "").when(last != "", last).otherwise(path)


def thought_of(text: Column) -> Column:
    """The turn without its fenced blocks."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), FENCE, ""))


def target_token(args: Column) -> Column:
    """First word of the argument's base name, lower case; empty when there is no argument."""
    quoted = F.regexp_extract(args, QUOTED, 1)
    raw = F.when(quoted != "", quoted).otherwise(F.regexp_extract(args, r"^\s*(\S+)", 1))
    base = base_name(raw)
    word = F.regexp_extract(base, r"([A-Za-z_][A-Za-z0-9_]+)", 1)
    return F.when(base == "", "").otherwise(F.lower(F.when(word != "", word).otherwise(base)))


def verb_category(verb: Column) -> Column:
    return (F.when(verb.isin(*OBSERVE_VERBS), "observe").when(verb.isin(*SEARCH_VERBS), "search")
            .when(verb.isin(*MUTATE_VERBS), "mutate").when(verb.isin(*RUN_VERBS), "verify")
            .when(verb == "submit", "submit").otherwise("other"))


def verb_aligned(category: Column, thought: Column) -> Column:
    """1 when the thought uses a word of the action's category."""
    words = F.regexp_extract_all(F.lower(thought), F.lit("([a-z_]+)"), F.lit(1))
    hit = F.lit(False)
    for name, lexicon in LEXICON.items():
        hit = hit | ((category == name) & F.arrays_overlap(words, F.array(*[F.lit(w) for w in lexicon])))
    return hit.cast("int")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def letter_share(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return letters / F.greatest(F.length(text), F.lit(1))


def is_prose(text: Column) -> Column:
    t = stripped(text)
    return (t != "") & ~F.startswith(t, F.lit("<")) & ~any_of(t, LOG_NOISE) & (letter_share(t) > 0.65)


def is_reaction(text: Column) -> Column:
    """A short one-line message of prose."""
    t = stripped(text)
    return ((t != "") & (F.length(t) <= 160) & ~F.contains(t, F.lit("\n")) & ~any_of(t, REACTION_NOISE)
            & (letter_share(t) > 0.7))


def error_origin(text: Column) -> Column:
    return F.when(any_of(F.lower(text), ENVIRONMENT_ERRORS), "environmental").otherwise("command")


# Words that mark a result as an error.
RESULT_ERRORS = ("error", "failed", "exception", "traceback")


def is_error_result(flag: Column, text: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | any_of(F.lower(text), RESULT_ERRORS)


def normal_command(command: Column) -> Column:
    """First sub-command of a shell line, spaces collapsed."""
    first = F.element_at(F.split(F.element_at(F.split(command, r"\n"), 1), " && "), 1)
    return stripped(F.regexp_replace(first, r"\s+", " "))


def passed_share(log: Column) -> Column:
    """passed / (passed + failed + error) of a test log; null when it names neither result."""
    def number(word: str) -> Column:
        found = F.regexp_extract(F.coalesce(log, F.lit("")), rf"(?i)(\d+)\s+{word}", 1)
        return F.when(found != "", found.cast("double"))

    p, f, e = number("passed"), number("failed"), number("error")
    total = F.coalesce(p, F.lit(0.0)) + F.coalesce(f, F.lit(0.0)) + F.coalesce(e, F.lit(0.0))
    return F.when((p.isNotNull() | f.isNotNull()) & (total > 0), F.coalesce(p, F.lit(0.0)) / total)


@F.pandas_udf(T.StringType())
def selection_key(instance: pd.Series, model: pd.Series) -> pd.Series:
    """First 16 hex digits of the keyed digest; their text order is the numeric order."""
    return pd.Series([hashlib.blake2b(f"{SPLIT_SEED}|{i}|{m}".encode()).hexdigest()[:16]
                      for i, m in zip(instance, model)])


def selection_key_sha(instance: Column, model: Column) -> Column:
    """The same key over SHA-256, which needs no Python."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(str(SPLIT_SEED)), instance.cast("string"),
                                          model.cast("string")), 256), 1, 16)


def hash_bucket(key: Column) -> Column:
    """0-99 from the first eight hex digits of the SHA-256 of the id."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100


def hash_split(key: Column, bounds: tuple[tuple[str, int], ...] = (("debug", 10), ("val", 30), ("test", 100))) -> Column:
    """Split by hash bucket; each bound is a split name and the bucket it ends before."""
    chain = F
    for name, end in bounds[:-1]:
        chain = chain.when(hash_bucket(key) < end, name)
    return chain.otherwise(bounds[-1][0])


def likert(value: Column, low: float, high: float, inverted: bool = False) -> Column:
    """Bucket a metric into 1-5 between two bounds."""
    share = (high - value) / (high - low) if inverted else (value - low) / (high - low)
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(1 + F.greatest(F.least(
        share, F.lit(1.0)), F.lit(0.0)) * 4).cast("int")))


def kappa_band(k: Column) -> Column:
    return (F.when(k.isNull() | F.isnan(k), "n/a").when(k < 0, "poor").when(k < 0.21, "slight").when(k < 0.41, "fair")
            .when(k < 0.61, "moderate").when(k < 0.81, "substantial").otherwise("almost perfect"))


def effect_band(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def call_signature(tool: Column, data: Column) -> Column:
    """One text for a call's tool and input, so that literal repeats can be told.

    ``data`` is the input as JSON. Commands count by their first line with spaces
    collapsed, file tools by path, searches by pattern and place, other tools by
    their whole input with sorted keys. Texts are kept whole, so long calls that
    differ late stay different.
    """
    name = F.lower(F.coalesce(tool, F.lit("")))

    def get(key: str) -> Column:
        return F.coalesce(F.get_json_object(data, f"$.{key}"), F.lit(""))

    line = stripped(F.regexp_replace(F.element_at(F.split(get("command"), "\n"), 1), r"\s+", " "))
    pairs = F.array_sort(F.map_entries(F.from_json(data, "map<string, string>")))
    other = F.coalesce(F.to_json(F.map_from_entries(pairs)), data, F.lit("{}"))
    body = (F.when(name == "bash", line).when(name.isin("read", "edit", "write", "notebookedit"), get("file_path"))
            .when(name.isin("grep", "glob"), F.concat(get("pattern"), F.lit(":"), get("path"))).otherwise(other))
    return F.concat(name, F.lit(":"), body)
