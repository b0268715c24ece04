"""Licence scan: Aho-Corasick over normalised words, and a shunting-yard reader of licence expressions."""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import worker_memory

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices and their labels.
NOTICE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "proprietary",
}
TAG_PHRASE = "spdx license identifier"
# Beginnings of identifiers that allow any use.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "cc-by-4", "cc-by-3", "0bsd", "bsl")
# How tightly the operators bind.
BINDING = {"or": 1, "and": 2, "with": 3}

_TAG = regex.compile(r"spdx[-_ ]license[-_ ]identifier\s*[:=]?[ \t]*([^\r\n]*)", regex.IGNORECASE)
_TOKEN = regex.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_NAME = regex.compile(r"[A-Za-z0-9.+:-]+")
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: What a notice and a well-formed tag leave of the doubt whether a text states a licence.
NOTICE_DOUBT, TAG_DOUBT = 0.3, 0.05

DDL = ("doc_id long, n_words long, hits array<struct<label: string, kind: string, word: long>>, "
       "expressions array<struct<expression: string, postfix: string, valid: boolean, permissive: boolean>>, score double")
_HIT = pa.struct([("label", pa.string()), ("kind", pa.string()), ("word", pa.int64())])
_EXPRESSION = pa.struct([("expression", pa.string()), ("postfix", pa.string()), ("valid", pa.bool_()), ("permissive", pa.bool_())])


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order by the shunting-yard method; None where it is malformed.

    What follows a complete expression on the same line (a comment's end) is left out.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if operand:
            if token == "(":
                stack.append(token)
            elif _NAME.fullmatch(token) and low not in BINDING:
                out.append(low)
                operand = False
            else:
                return None
        elif low in BINDING:
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def allowed(order: list[str]) -> bool:
    """Whether a choice of the expression's licences allows any use; an exception only adds rights."""
    values: list[bool] = []
    for token in order:
        if token in BINDING:
            right, left = values.pop(), values.pop()
            values.append(left or right if token == "or" else left if token == "with" else left and right)
        else:
            values.append(token.startswith(PERMISSIVE))
    return values[0]


def expressions(text: str) -> list[dict]:
    found = []
    for m in _TAG.finditer(text):
        order = postfix(m[1])
        found.append({"expression": m[1].strip(), "postfix": " ".join(order) if order else None, "valid": order is not None,
                      "permissive": allowed(order) if order else None})
    return found


def names(order: list[str]) -> list[str]:
    """The licences of a postfix expression, without operators and the exceptions after "with"."""
    values: list[list[str]] = []
    for token in order:
        if token in BINDING:
            right, left = values.pop(), values.pop()
            values.append(left if token == "with" else left + right)
        else:
            values.append([token])
    return values[0]


def _automaton(phrases: dict[str, list[tuple[str, str]]]) -> ahocorasick.Automaton:
    memory = worker_memory("licence phrases")
    key = tuple(sorted((p, tuple(v)) for p, v in phrases.items()))
    if key not in memory:
        automaton = ahocorasick.Automaton()
        for phrase, labels in phrases.items():
            automaton.add_word(f" {phrase} ", (len(phrase) + 2, labels))
        automaton.make_automaton()
        memory.clear()
        memory[key] = automaton
    return memory[key]


def scan(text: str, automaton: ahocorasick.Automaton) -> tuple[int, list[dict], list[dict], float]:
    words = text.encode().translate(_TO_WORDS).split()
    line = b" %b " % b" ".join(words)
    hits, tagged, counted, spaces = [], False, 0, 0
    for end, (size, labels) in automaton.iter(line.decode("latin-1")):
        # Hits come by their ends, so every part of the line is counted once.
        spaces, counted = spaces + line.count(b" ", counted, end + 1), end + 1
        word = spaces - line.count(b" ", end - size + 2, end + 1) - 1
        for label, kind in labels:
            tagged |= kind == "tag"
            hits.append({"label": label, "kind": kind, "word": word})
    found = expressions(text) if tagged else []
    for e in found:
        if e["valid"]:
            hits += [{"label": name, "kind": "expression", "word": None} for name in dict.fromkeys(names(e["postfix"].split()))]
    hits = [h for h in hits if h["kind"] != "tag"]
    notices = len({h["label"] for h in hits if h["kind"] != "expression"})
    score = 1.0 - NOTICE_DOUBT ** notices * TAG_DOUBT ** sum(e["valid"] for e in found)
    return len(words), hits, found, score


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICE_PHRASES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices and expressions of whole texts, one row per document, in one pass without a shuffle.

    ``hits`` holds every place of a phrase (kind ``base`` or ``notice``, with
    the word it starts at, from 0) and the licences of well-formed expressions
    after an identifier tag (kind ``expression``). ``expressions`` holds the
    tags' expressions; a malformed one is kept with ``valid`` false. Words are
    runs of digits, a to z and characters beyond ASCII, after lower-casing A-Z.
    A null text counts as empty: no words, no hits, score 0. Equal rows give
    equal result rows, null ids stay null, an empty table gives no rows, and
    other columns are not read. ``score`` is 0 without a hit and nears 1 with
    every further label or tag.
    """
    phrases: dict[str, list[tuple[str, str]]] = {TAG_PHRASE: [("", "tag")]}
    for phrase, label in base.items():
        phrases.setdefault(phrase, []).append((label, "base"))
    for phrase, label in notices.items():
        phrases.setdefault(phrase, []).append((label, "notice"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(phrases)
        for batch in batches:
            found = [scan(t or "", automaton) for t in batch.column(1).to_pylist()]
            n, hits, tags, scores = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.list_(_HIT)), pa.array(tags, pa.list_(_EXPRESSION)),
                 pa.array(scores, pa.float64())], ["doc_id", "n_words", "hits", "expressions", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scanned, DDL)
