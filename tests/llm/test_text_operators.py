"""Token packing, token counts, personal data and licences."""

import random
import re
import tempfile
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, base_spans
from trajlens.llm import licenses, packing, pii, tokens, wordpieces
from trajlens.llm.packing import Limits, Piece, sequences

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a  b", "<|endoftext|> x", "x\x1cy \x1d!!", "İstanbul ΣΑΣ Σ", "éa ́x", "it's don't 'S x'", "\ta b\n", "a.\nb c", "½ ²³ ", "🙂🙂 a",
       "a　b", "ﬁ ǅ", "<|startoftext|>", " lead", "trail ", "’s l’été", "ß ẞ", "ab\x00c", "word " * 20000]


def test_ids_and_counts_equal_the_tokenizers():
    rnd = random.Random(1)
    letters = list(" \n\t'abczAZ,.1²éÉ́ßİΣ中🙂　\x1c") + ["<|endoftext|>"]
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in wordpieces.word_ids(WORD, texts)] == want
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert wordpieces.byte_counts(BYTE, texts) == want


@pytest.mark.parametrize("size,run,memo", [(1, 1, 1), (5, 40, 50), (64, 1000, 300)])
def test_ids_do_not_depend_on_where_texts_are_cut_or_on_the_memo(monkeypatch, size, run, memo):
    rnd = random.Random(8)
    letters = list(" ''\n1stmdrevl.,aAéß中🙂²\x85") + ["'ll", "'re", "''"]
    texts = [*ODD[:-1], *("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(400)), "x" * 3000 + " y", "   ", ""]
    monkeypatch.setattr(wordpieces, "SLICE", size)
    monkeypatch.setattr(wordpieces, "RUN", run)
    monkeypatch.setattr(wordpieces, "MEMO_WORDS", memo)
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in wordpieces.word_ids(WORD, texts)] == want
    assert wordpieces.word_ids(WORD, []) == []


def test_a_full_memo_keeps_the_words_that_go_on_occurring(monkeypatch):
    learnt, learn = defaultdict(int), wordpieces._learn_ids

    def counted(memory, new):
        for part in new:
            learnt[part] += 1
        return learn(memory, new)

    for name in ("MEMO_PARTS", "MEMO_WORDS"):
        monkeypatch.setattr(wordpieces, name, 2000, raising=False)
    monkeypatch.setattr(wordpieces, "_learn_ids", counted)
    word = lambda n: "q" + "".join(chr(97 + n // 26 ** k % 26) for k in range(4))
    often = [word(n) for n in range(300)]
    for at in range(20):
        wordpieces.word_ids(WORD, [" ".join(often + [word(1000 + 500 * at + n) for n in range(500)])])
    assert sum(learnt[w] for w in often) <= len(often) < len(learnt)


def test_known_words_cost_less_than_a_pattern_and_a_look_up_each():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rnd.choices(words, k=500)) + "." for _ in range(1000)]
    pattern, memo = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"), dict.fromkeys([*words, "."], b"1234")

    def seconds(f):
        f()
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    plain = seconds(lambda: [b"".join(map(memo.__getitem__, pattern.findall(t.lower()))) for t in texts])
    assert seconds(lambda: wordpieces.word_ids(WORD, texts)) < 0.9 * plain


def test_runs_of_texts_are_cut_by_their_bytes(monkeypatch):
    monkeypatch.setattr(wordpieces, "RUN", 10)
    texts = ["", None, "abc", "é" * 30, None, "x" * 9, "y", "", "z" * 11, ""]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    runs = [r.column(1).to_pylist() for r in wordpieces.runs_of(batch, 1)]
    assert sum(runs, []) == texts and all(runs) and len(runs) > 3
    assert list(wordpieces.runs_of(batch.slice(0, 0), 1)) == []


@pytest.mark.parametrize("cut", [True, False])
def test_sequences_keep_every_limit_and_every_id_once(cut):
    rnd = random.Random(2)
    limits = Limits(tokens=64, segments=5, loss=40)
    pieces = []
    for i in range(800):
        n = rnd.choice([1, 2, 5, 30, 64, 200])
        pieces.append(Piece(i, 0, np.arange(n, dtype="<u4").tobytes(), n, rnd.randint(0, n)))
    seen = defaultdict(list)
    for chosen, _ in sequences(iter(pieces), limits, cut):
        assert sum(map(len, chosen)) <= 64 and len(chosen) <= 5 and sum(p.loss() for p in chosen) <= 40
        for p in chosen:
            seen[p.doc_id].append((p.start, p.ids))
    for p in pieces:
        assert b"".join(ids for _, ids in sorted(seen[p.doc_id])) == p.ids


def test_sequences_are_full_where_pieces_may_be_cut():
    pieces = [Piece(i, 0, np.zeros(n, "<u4").tobytes(), n) for i, n in enumerate([700, 3000, 5, 90, 2048] * 40)]
    sizes = [sum(map(len, chosen)) for chosen, _ in sequences(iter(pieces), Limits())]
    assert all(n == 2048 for n in sizes[:-1])


def test_a_limit_below_one_is_refused():
    with pytest.raises(ValueError):
        next(sequences(iter([]), Limits(tokens=0)))


def test_packing_of_odd_rows(spark):
    texts = [*ODD, None, "same text", "same text"]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(5, ODD[5], "x", 7), (None, "no id", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, sequence_id int").repartition(5)
    got = packing.pack(docs, WORD).collect()
    tokenizer = Tokenizer.from_file(WORD)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    pieces = defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start:r.start + r.length].tobytes())
        pieces[r.doc_id].append(r)
    for i, own in ids.items():
        covered = sorted(k for r in pieces[i] for k in range(r.start, r.start + r.length))
        assert covered == sorted(list(range(len(own))) * (2 if i == 5 else 1))
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    for rs in by_sequence.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist() and sum(r.length for r in rs) <= 2048


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), WORD).collect() == []


def test_prompt_tokens_bear_no_loss(spark):
    docs = spark.createDataFrame([(1, "one two three", 2), (2, "one two three", None)], DOCS + ", prompt int")
    got = {r.doc_id: r.loss_tokens for r in packing.pack(docs, WORD, loss_from_col="prompt").collect()}
    assert got == {1: 2, 2: 4}


def test_counts_of_odd_rows_and_a_cache_that_is_used(spark):
    folder = f"{tempfile.mkdtemp()}/cache"
    rows = [(i, t, 3) for i, t in enumerate([*ODD, None, "same", "same"])] + [(None, "no id", 3), (3, ODD[3], 3), (3, ODD[3], 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    tokenizer = Tokenizer.from_file(BYTE)
    want = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=repr)
    got = tokens.count_tokens(docs, BYTE, folder)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    stored = tokens.read_cache(spark, folder)
    first = stored.count()
    assert first == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in rows})
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(99, "a new text")], DOCS))
    assert tokens.count_tokens(more, BYTE, folder).count() == len(rows) + 1
    assert tokens.read_cache(spark, folder).count() == first + 1
    assert tokens.count_tokens(docs.where("false"), BYTE, folder).collect() == []


def test_base_spans_equal_the_rules(spark):
    rnd = random.Random(5)
    texts = ["", "1" * 30, "4111 1111 1111 1111", "a@b.c_x@y.z", "a@b..c a@b.c. a@b.c.d-e", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1", "x" * 20000,
             "9" * 20000, "1 " * 9000, "a.b@" + ".c" * 9000, "a@" + "b." * 9000 + "c", "+1 (132) 555-1352" * 300, "10.0.0.1 " * 900, "é" * 100 + " 10.0.0.1 a@b.co",
             "79927398713 4242-4242-4242-4242 4242 4242  4242 4242"]
    for letters in ("ab1234.@+- ()9_%0é", "0123456789 -."):
        texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.spans for r in docs.select("doc_id", pii.listed(pii.base_spans(F.col("text"))).alias("spans")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)), t[:80]


def test_patterns_find_identifiers_that_break_the_rules(spark):
    cards = ["4111111111111111", "4012888888881881", "4222222222222220", "5555555555554444", "5105105105105100", "4242424242424242"]
    texts = [f"Some words {w}. Card number: {c} is on file." for w, c in zip("abcdef", cards)]
    texts += ["Please note my card number: 4111111111111112 thanks.", "The year 2024-2025x was long.", None, ""]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(6, texts[6], "k"), (None, texts[6], "k")],
                                 "doc_id long, text string, kind string")
    found = pii.find_pii(docs).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        want = ["4111111111111112"] if r.doc_id in (6, None) else []
        assert [s.value for s in r.added] == want and all(pii.KINDS[s.kind] == "card" for s in r.added)
    clean = {r.doc_id: r.text for r in pii.without_pii(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert clean[6] == "Please note my card number: [CARD] thanks." and clean[8] is None and clean[7] == texts[7]
    assert pii.find_pii(docs.where("false")).collect() == []


def test_redaction_merges_spans_that_overlap(spark):
    spans = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(k).alias("kind"), F.lit(b).cast("long").alias("stop"), F.lit("").alias("value"))
                      for a, k, b in [(2, 0, 6), (4, 3, 8), (8, 1, 9)]])
    text = spark.range(1).select(pii.redacted(F.lit("éb0123456789"), spans).alias("t")).first().t
    assert text == "éb[EMAIL][IP]789"


def test_licence_words_and_places(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = ["MIT License, mit  license; the Apache-License", "gnu general public license gnu general public license", "cc by-nc", "commit license", None, "",
             "é mit\nlicense", "x " * 5000 + "cc.by"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "mit license", 1)], "doc_id long, text string, hits int")
    for r in licenses.scan_licenses(docs).collect():
        text = "mit license" if r.doc_id is None else texts[r.doc_id] or ""
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        want = sorted((k, label) for phrase, label in licenses.BASE_PHRASES.items() for n in [len(phrase.split())] for k in range(len(words))
                      if words[k:k + n] == phrase.split())
        assert r.n_words == len(words) and sorted((h.word, h.label) for h in r.hits if h.kind == "base") == want
        assert (r.score > 0) == bool(r.hits) and 0 <= r.score <= 1
    assert licenses.scan_licenses(docs.where("false")).collect() == []


@pytest.mark.parametrize("text,order,allowed", [
    ("MIT", ["mit"], True), ("MIT OR GPL-3.0-only", ["mit", "gpl-3.0-only", "or"], True), ("MIT AND GPL-3.0-only", ["mit", "gpl-3.0-only", "and"], False),
    ("A AND B OR C", ["a", "b", "and", "c", "or"], False), ("A AND (MIT OR C)", ["a", "mit", "c", "or", "and"], False),
    ("GPL-2.0-only WITH X-exception OR ISC */", ["gpl-2.0-only", "x-exception", "with", "isc", "or"], True), ("MIT OR", None, None), ("((MIT)", None, None), ("", None, None)])
def test_licence_expressions(text, order, allowed):
    assert licenses.postfix(text) == order
    if order:
        assert licenses.allowed(order) == allowed


def test_tagged_expression_becomes_labels(spark):
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH E) \nint x;"), (2, "SPDX-License-Identifier: MIT AND")], DOCS)
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [h.label for h in got[1].hits] == ["mit", "gpl-2.0-only"] and got[1].expressions[0].permissive
    assert not got[2].expressions[0].valid and got[2].score == 0


def test_places_of_licences_take_time_in_proportion_to_the_text():
    automaton = licenses._automaton({"mit license": [("mit", "base")], "apache license": [("apache", "base")], "license apache license mit": [("x", "notice")]})
    text = "mit license apache license " * 40_000
    begin = time.process_time()
    n, hits, _, _ = licenses.scan(text, automaton)
    assert time.process_time() - begin < 5
    assert n == 160_000 and [h["word"] for h in hits if h["label"] == "mit"] == list(range(0, n, 4))
    assert [h["word"] for h in hits if h["label"] == "apache"] == list(range(2, n, 4))
    assert [h["word"] for h in hits if h["label"] == "x"] == list(range(1, n - 4, 4))
