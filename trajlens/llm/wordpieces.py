"""Exact token ids and counts of many whole texts by a memo over their pre-tokens.

Both vocabularies first split a text by a fixed pattern and then merge inside
each part, so a part's ids do not depend on its neighbours. Parts the worker
has not seen yet are encoded by the tokenizer in bulk. Texts in which the split
could come out otherwise (special strings, letters whose lower case or
composition is not plain) are encoded whole by the tokenizer.

The word vocabulary's split runs over many texts at once: characters become
classes, parts begin where the class changes, and the distinct parts of a run of
texts are looked up together in a memo of Arrow arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

from trajlens.llm.common import quiet_tokenizers, worker_memory

#: Parts a worker remembers before it starts anew; some 100 MB.
MEMO_PARTS = 500_000
#: Parts of the word vocabulary a worker remembers before it keeps the half last seen; some 50 MB.
MEMO_WORDS = 1_000_000
#: Parts encoded by one call.
BULK = 4096
#: Characters split at a time, and looked up at a time, about: a run without a space stays whole.
SLICE, RUN = 1 << 17, 1 << 22

# How the two vocabularies split a text; the word vocabulary's pattern is
# 's|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+
_CLASS = regex.compile(r"(?![\x1c-\x1f])(\s)|(\p{L})|(\p{N})")
_OTHER, _SPACE, _LETTER, _NUMBER, _UNSEEN = range(5)
_SUFFIXES = {1: [(ord(c),) for c in "stmd"], 2: [tuple(map(ord, c)) for c in ("re", "ve", "ll")]}
_BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BYTE_SPLIT_ASCII = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_NOT_PLAIN = regex.compile("[\\p{M}Σ]")
_SPACES = re.compile("[ \t-\r\u3000]")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _loaded(path: str) -> dict:
    memory = worker_memory(f"tokenizer:{path}")
    if not memory:
        quiet_tokenizers()
        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        memory |= {"tokenizer": tokenizer, "special": special, "parts": {}}
    elif len(memory["parts"]) > MEMO_PARTS:
        memory["parts"].clear()
    return memory


def _packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _bulks(parts: list):
    return (parts[at:at + BULK] for at in range(0, len(parts), BULK))


def _plain(memory: dict, text: str) -> str | None:
    """The text as the word vocabulary splits it, or nothing where only the tokenizer can tell."""
    if any(s in text for s in memory["special"]):
        return None
    low = text.lower()
    if not low.isascii() and (
            "Σ" in text or _SEPARATORS.search(text) or not unicodedata.is_normalized("NFC", text) or _NOT_PLAIN.search(low)):
        return None
    return low


def _classes(memory: dict, chars: np.ndarray) -> np.ndarray:
    if "classes" not in memory:
        memory["classes"] = np.full(0x110000, _UNSEEN, dtype=np.uint8)
    table = memory["classes"]
    found = table[chars]
    unseen = chars[found == _UNSEEN]
    if len(unseen):
        for c in np.unique(unseen).tolist():
            known = _CLASS.match(chr(c))
            table[c] = known.lastindex if known else _OTHER
        found = table[chars]
    return found


def _split_words(memory: dict, text: str) -> tuple[np.ndarray, pa.LargeStringArray]:
    """Where each part of the lower-cased text starts, and the parts."""
    chars = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    kinds = _classes(memory, chars)
    starts = np.ones(len(chars) + 1, dtype=bool)
    starts[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
    quotes = np.flatnonzero((chars == ord("'")) & starts[:-1])
    for n, suffixes in _SUFFIXES.items():
        at = quotes[quotes + n < len(chars)]
        is_suffix = np.zeros(len(at), dtype=bool)
        for suffix in suffixes:
            is_suffix |= np.logical_and.reduce([chars[at + 1 + k] == c for k, c in enumerate(suffix)])
        starts[at[is_suffix] + 1] = False
        starts[at[is_suffix] + 1 + n] = True
    kept = kinds != _SPACE
    starts = starts[:-1] & kept
    chars = chars[kept]
    begins = np.flatnonzero(starts[kept])
    offsets = np.zeros(len(begins) + 1, dtype=np.int64)
    if len(begins):
        width = 1 + (chars > 0x7F).view(np.uint8) + (chars > 0x7FF).view(np.uint8) + (chars > 0xFFFF).view(np.uint8)
        np.cumsum(np.add.reduceat(width, begins, dtype=np.int64), out=offsets[1:])
    data = chars.tobytes().decode("utf-32-le").encode()
    return np.flatnonzero(starts), pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _learn_ids(memory: dict, new: list[str]) -> pa.LargeBinaryArray:
    """Words of letters go as one text, cut after the tokens that end a word; other parts one by one."""
    tokenizer = memory["tokenizer"]
    if "ends" not in memory:
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        memory["ends"] = ends
        # Its words are split and lower-cased already.
        memory["letters"] = bare = Tokenizer.from_str(tokenizer.to_str())
        bare.normalizer = None
        bare.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    learnt, order = [], []
    rest = [i for i, p in enumerate(new) if not p.isalpha()]
    for some in _bulks([i for i, p in enumerate(new) if p.isalpha()]):
        ids = np.asarray(memory["letters"].encode_batch_fast([" ".join([new[i] for i in some])], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(memory["ends"][ids]) + 1
        if len(cuts) == len(some):
            offsets = np.concatenate([[0], cuts * 4]).astype(np.int64)
            learnt.append(pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
            order += some
        else:
            rest += some
    for some in _bulks(rest):
        encoded = tokenizer.encode_batch_fast([new[i] for i in some], add_special_tokens=False)
        learnt.append(pa.array([_packed(e.ids) for e in encoded], pa.large_binary()))
        order += some
    return pa.concat_arrays(learnt).take(pa.array(np.argsort(order)))


def _ids_of(memory: dict, parts: pa.LargeStringArray) -> pa.LargeBinaryArray:
    """The ids of distinct parts."""
    known, ids, seen = memory.get("words") or (pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int64))
    at = pc.index_in(parts, value_set=known).fill_null(-1).to_numpy().copy()
    new = parts.filter(pa.array(at < 0))
    if len(new):
        at[at < 0] = np.arange(len(known), len(known) + len(new))
        known = pa.concat_arrays([known, new])
        ids = pa.concat_arrays([ids, _learn_ids(memory, new.to_numpy(zero_copy_only=False).tolist())])
        seen = np.concatenate([seen, np.zeros(len(new), dtype=np.int64)])
    memory["runs"] = seen[at] = memory.get("runs", 0) + 1
    found = ids.take(pa.array(at))
    if len(known) > MEMO_WORDS:
        keep = np.argpartition(-seen, MEMO_WORDS // 2)[:MEMO_WORDS // 2]
        known, ids, seen = known.take(pa.array(keep)), ids.take(pa.array(keep)), seen[keep]
    memory["words"] = known, ids, seen
    return found


def _slices(text: str, size: int) -> Iterator[tuple[int, str]]:
    """Slices of the text and where they start; each ends at a space, where no part goes on."""
    at = 0
    while at < len(text):
        space = _SPACES.search(text, at + size)
        to = space.start() if space else len(text)
        yield at, text[at:to]
        at = to


def _plain_ids(memory: dict, lows: list[str]) -> list[bytes]:
    text = " ".join(lows)
    bounds = np.cumsum([0, *(len(low) + 1 for low in lows)])
    places, found, done = np.zeros(len(bounds), dtype=np.int64), [], 0
    for first, run in _slices(text, RUN):
        split = [(first + at, *_split_words(memory, some)) for at, some in _slices(run, SLICE)]
        starts = np.concatenate([at + own for at, own, _ in split])
        distinct = pa.concat_arrays([parts for *_, parts in split]).dictionary_encode()
        ids = _ids_of(memory, distinct.dictionary).take(distinct.indices)
        offsets = np.zeros(1, dtype=np.int64)
        if len(ids):
            offsets = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1)
            found.append(memoryview(ids.buffers()[2])[:offsets[-1]])
        inside = slice(*np.searchsorted(bounds, [first, first + len(run)]))
        places[inside] = done + offsets[np.searchsorted(starts, bounds[inside])]
        done += int(offsets[-1])
    places[bounds >= len(text)] = done
    all_ids = b"".join(found)
    return [all_ids[a:b] for a, b in pairwise(places.tolist())]


def runs_of(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``RUN`` bytes of text each, so that many short texts are looked up together."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64)
    cuts = (np.flatnonzero(np.diff(ends // RUN)) + 1).tolist()
    for at, to in pairwise([0, *cuts, batch.num_rows]):
        if to > at:
            yield batch.slice(at, to - at)


def word_ids(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each whole text, for the vocabulary that drops white space."""
    memory = _loaded(path)
    plain = [_plain(memory, t) for t in texts]
    ids = iter(_plain_ids(memory, [low for low in plain if low is not None]))
    return [_packed(memory["tokenizer"].encode(t, add_special_tokens=False).ids) if low is None else next(ids) for t, low in zip(texts, plain)]


def _byte_parts(memory: dict, text: str) -> list[str] | None:
    if any(s in text for s in memory["special"]) or _SEPARATORS.search(text):
        return None
    return (_BYTE_SPLIT_ASCII if text.isascii() else _BYTE_SPLIT).findall(text)


def byte_counts(path: str, texts: list[str]) -> list[int]:
    """Number of tokens of each whole text, for the byte-level vocabulary."""
    memory = _loaded(path)
    split = [_byte_parts(memory, t) for t in texts]
    known, tokenizer = memory["parts"], memory["tokenizer"]
    new = list(set().union(*(w for w in split if w)).difference(known))
    for some in _bulks(new):
        for p, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            known[p] = len(e.ids)
    return [len(tokenizer.encode(t, add_special_tokens=False).ids) if w is None
            else sum(map(known.__getitem__, w)) for t, w in zip(texts, split)]
