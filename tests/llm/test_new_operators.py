"""Best-fit packing, ranked search and the conversation trie."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, SF
from trajlens.llm import bestfit, common, ranking, trie
from trajlens.llm.queries import QUERIES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    """Number of sequences of the sequential rule."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def _check_packing(rows, texts, capacity, end_id=0):
    """Every id lies in one piece, pieces are cut as stated, and sequences have no gaps."""
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [end_id]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[i, piece, at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for sequence in places.values():
        at = 0
        for offset, length in sorted(sequence):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_best_fit_query_packs_every_id_as_well_as_the_sequential_rule(spark):
    rows = QUERIES["op13_best_fit_packing"](spark, SF).collect()
    texts = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    used = _check_packing(rows, texts, 2048)
    assert used == best_fit_decreasing([r.length for r in rows], 2048)


@pytest.mark.parametrize("rows_of_a_sweep", [10 ** 6, 12])
def test_best_fit_of_odd_rows(spark, monkeypatch, rows_of_a_sweep):
    monkeypatch.setattr(bestfit, "SWEEP_ROWS", rows_of_a_sweep)
    rnd = random.Random(1)
    words = ["able", "stone", "river", "of", "and", "qzx", "é"]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 90)))) for i in range(400)]
    texts += [(1000, None), (1001, ""), (None, "able"), (5, "able"), (5, "able"), (7, "river " * 900), (8, "stone " * 63), (9, "stone " * 64)] + [(3000, "of and of")] * 200
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], DOCS + ", length int, sequence_id string").repartition(5)
    rows = bestfit.pack_best_fit(docs, TOKENIZER, capacity=64).collect()
    used = _check_packing(rows, texts, 64)
    exact = best_fit_decreasing([r.length for r in rows], 64)
    assert used == exact if rows_of_a_sweep > 1000 else used <= 1.1 * exact
    assert bestfit.pack_best_fit(docs.where("false"), TOKENIZER).collect() == []
    one = bestfit.pack_best_fit(docs.where("doc_id in (5, 1000)"), TOKENIZER, capacity=1).collect()
    assert {r.length for r in one} == {1} and len({r.sequence_id for r in one}) == len(one)


def test_sweeps_are_best_fit_decreasing():
    rnd = random.Random(4)
    for _ in range(60):
        capacity = rnd.choice([10, 64, 100])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 80))]
        runs = [(n, 0, k) for n, k in Counter(lengths).items()]
        rules, left, gaps = bestfit.sweep(runs, [], capacity, 0)
        filled, taken = Counter(), Counter()
        for length, rank, documents, copies, sequence, offset in rules:
            assert rank == taken[length]
            taken[length] += documents
            for k in range(documents):
                b = sequence + k // copies
                assert filled[b] == offset + k % copies * length
                filled[b] += length
        assert not left and taken == Counter(lengths) and max(filled.values()) <= capacity
        assert len(filled) == best_fit_decreasing(lengths, capacity)
        assert sum(g * n for g, _, n in gaps) == len(filled) * capacity - sum(lengths)


_TERMS = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, k):
    """Every item against every document, from the stated rule."""
    docs = [(i, Counter(_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in docs]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        found = []
        for (i, held), size in zip(docs, sizes):
            m = 50 + 50 * size * n // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * held[t] // (1000 * held[t] + 20 * m))
                        for t in set(_terms(text)) if t in held)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_ranking_equals_every_pair(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_DOCS", 40), ("RUN", 8), ("SHIPPED_TERMS", 10), ("QUERIES_A_GROUP", 4), ("FIRST", 3)):
            monkeypatch.setattr(ranking, name, value)
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(60)] + ["É", "Éx", "Zürich", "a", "A", "b1"]
    chance = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: rnd.choice([" ", "-", "\n", "."]).join(rnd.choices(words, chance, k=n))
    docs = [(i, text(rnd.choice([1, 3, 10, 60, 300]))) for i in range(500)]
    docs += [(600, None), (601, ""), (602, " -- "), (None, text(20)), (None, "w3 w3"), (7, "w59 w58"), (7, "w59 w58"), (9, "w3 " * 5000)] + [(1000 + i, "w5 w6 w7") for i in range(90)]
    items = [(i, text(rnd.choice([1, 2, 12]))) for i in range(14)] + [(50, None), (51, ""), (52, "unheard of"), (None, "w3 w4"), (3, "w1 w2"), (53, "w5 w5 W6"), (53, "w5 w5 W6")]
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", score int, item_id string").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, ranking.rank_documents(table, asked, 10).collect()), key=repr)
    assert got == _ranked(docs, items, 10) and len(got) > 100
    assert ranking.rank_documents(table.where("false"), asked).collect() == [] and ranking.rank_documents(table, asked.where("false")).collect() == []


def test_hybrid_search_equals_full_sums():
    rnd = np.random.default_rng(5)
    for _ in range(300):
        size = int(rnd.integers(1, 3000))
        lists, total = [], np.zeros(size, np.int64)
        for _ in range(int(rnd.integers(1, 9))):
            docs = np.flatnonzero(rnd.random(size) < rnd.choice([0.002, 0.03, 0.3, 0.9]))
            add = rnd.integers(0, rnd.choice([2, 50, 10 ** 6]), len(docs))
            total[docs] += add
            lists.append((docs, add))
        order, k = rnd.permutation(size), int(rnd.integers(1, 60))
        want = [d for d in np.lexsort((order, -total)) if total[d] > 0][:k]
        beat = int(total[want[-1]]) if len(want) == k and rnd.random() < 0.5 else 0
        docs, scores = ranking.hybrid_top(lists, order, k, beat)
        assert sorted(docs.tolist()) == sorted(int(d) for d in want) and (scores == total[docs]).all()


def _trie(rows):
    """The nodes of the rebuilt conversations, one prefix at a time."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        children = lambda p: sum(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes)
        ends = sorted(c for c in members if len(built[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children(path), sum(children(p) == 0 for p in below),
                    sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_rows", [None, 3])
def test_trie_equals_every_prefix(spark, monkeypatch, chunk_rows):
    """Shared openings of every length, equal conversations, one text in other roles, and conversations cut into chunks."""
    if chunk_rows:
        monkeypatch.setattr(trie, "IDS_A_PART", 4)
    rnd = random.Random(3)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 7_000_000_000, 7_000_000_003, -3]:
        shared = rnd.choice([0, 1, 3, 4, 5, 8, 9])
        for t in range(rnd.choice([0, 1, 2, 4, 8, 13, 30])):
            rows.append((c, t, "user" if t % 2 else "bot", f"s{t}é" if t < shared else rnd.choice(["a", "b", f"{rnd.random()}"])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(40) for t in range(6)]
    rows += [(300, None, None, None), (300, None, "x", "y"), (300, 2, "user", "late"), (300, 2, "user", "late"), (300, -1, "a", ""), (None, 1, "user", "nobody's"), (301, 0, None, ""), (305, 0, "", None)]
    rnd.shuffle(rows)
    table = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, conv string").repartition(4)
    got = trie.prefix_trie(*trie.with_shared_openings(trie.ordered_turns(table, chunk_rows)), chunk_rows).collect()
    assert sorted(map(tuple, got), key=repr) == _trie(rows)
    assert trie.prefix_trie(*trie.with_shared_openings(trie.ordered_turns(table.where("false")))).collect() == []
