"""Search, toxicity, near-duplicates, archives, quality, decontamination and the pipeline."""

import hashlib
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.compare import difference, duck
from tests.llm.helpers import DOCS, SF, base_spans, least_edits, near_components
from trajlens.llm import common, decontam, neardup, pii, quality, search, toxicity, warc
from trajlens.llm.queries import ORACLES, QUERIES
from trajlens.llm.shingles import MinHash, shingle_set
from trajlens.session import durable


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def _ints(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * x) for x in v]


def test_top_k_of_odd_vectors(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=6).round(2).tolist()) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [9.0] * 6),
             (350, [1.0, 2.0]), (351, [1.0, 2.0]), (352, [-1.0, 2.0]), (400, []), (401, []), (450, [1.0])]
    rows += [(500 + k, [0.5] * 6) for k in range(40)] + [(7, rows[7][1]), (50, rows[50][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(r) for r in search.top_k(table, search.F.col("vec_id") % 50 == 0).collect())
    vectors = {i: _ints(v) for i, v in rows if i is not None and _ints(v) is not None}
    want = []
    for q in sorted(i for i in vectors if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert search.top_k(table.where("false"), search.F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_of_a_best_candidate_repeated(spark):
    """The best candidate six times, once more with another vector: it fills one place."""
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.integers(-8, 9, 6).astype(float).tolist()) for i in range(120)]
    rows += [(200, [40.0] * 6)] * 6 + [(200, [39.0] * 6), (50, rows[50][1]), (201, [40.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in search.top_k(table, search.F.col("vec_id") % 50 == 0).collect())
    want = []
    for q in (0, 50, 100, 200):
        best = {}
        for a, v in rows:
            for b, w in rows:
                if a == q and b != q:
                    best[b] = max(best.get(b, -math.inf), sum(x * y for x, y in zip(_ints(v), _ints(w))))
        want += [(q, k + 1, b, s) for k, (b, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    assert got == sorted(want)


@pytest.mark.parametrize("scale", [1, 2 ** 20])
def test_block_search_prunes_nothing_it_needs(scale):
    rnd = np.random.default_rng(4)
    c = (rnd.normal(size=(1500, 16)) * rnd.choice([1, 10, 200], size=(1500, 1)) * scale).astype(np.int64)
    q = (rnd.normal(size=(20, 16)) * 50 * scale).astype(np.int64)
    axes = np.linalg.eigh((c.T.astype(float) @ c))[1][:, ::-1]
    got = sorted(zip(*(x.tolist() for x in search.block_search(np.arange(20), q, np.full(20, -np.inf), np.arange(100, 1600), c, axes, 5))))
    score = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q] if scale > 1 else (q @ c.T).tolist()
    want = [(i, 100 + j, row[j]) for i, row in enumerate(score) for j in sorted(range(1500), key=lambda j: (-row[j], j))[:5]]
    assert got == sorted(want)


def test_segments_are_the_maximal_ones():
    def brute(score, at=0):
        best = max(((sum(score[a:b + 1]), -a, a, b) for a in range(len(score)) for b in range(a, len(score))), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = best[2:]
        return brute(score[:a], at) + [(at + a, at + b)] + brute(score[b + 1:], at + b + 1)

    rnd = random.Random(3)
    for _ in range(1500):
        ordinary = -rnd.choice([0.37, 0.91])
        score = [rnd.choice([ordinary, ordinary, rnd.random() * 2 + 0.01]) for _ in range(rnd.randint(0, 22))]
        at = [i for i, s in enumerate(score) if s > 0]
        assert [(a, b) for a, b, _ in toxicity.segments(at, [score[i] for i in at], ordinary)] == brute(score)


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    label = np.asarray(label, dtype=bool)
    n = label.sum()
    return (rank[label].sum() - n * (n - 1) / 2) / (n * (len(score) - n))


@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.1"
    return common.table(spark, folder, "documents"), common.table(spark, folder, "labels")


def test_toxicity_on_held_out_labels(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    held = labels.where(common.held_out()).select("doc_id", "toxic")
    rows = toxicity.score(docs, model).join(held, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 500
    assert _auc([r.score for r in rows], [r.toxic for r in rows]) > 0.93
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows]) > 0.97
    worst = max(rows, key=lambda r: r.score)
    text = docs.where(docs.doc_id == worst.doc_id).first().text
    p = worst.passages[0]
    assert re.findall(r"\w+", text[p.start:p.stop].lower()) == re.findall(r"\w+", text.lower())[p.first_word:p.last_word + 1]
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, text, 0.5), (3, text, 0.5), (3, text, 0.5), (4, "İ " + text, 0.5)], DOCS + ", score double")
    got = toxicity.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (3, None)}) == 1
    assert sorted(str(r.doc_id) for r in toxicity.without_toxic(odd, model).collect()) == ["1", "2"]
    assert toxicity.score(odd.where("false"), model).collect() == []
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score < 0.5 for r in toxicity.score(odd, none).collect()} == {True}


def test_quality_on_held_out_labels(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    assert 0.6 < model.prior < 0.95
    rows = quality.score(docs, model).join(labels.where(common.held_out()).select("doc_id", "quality"), "doc_id").collect()
    assert _auc([r.score for r in rows], [r.quality for r in rows]) > 0.94
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in rows]) > 0.96
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "a b", 1), (4, "|" * 100000, 1), (5, " \n ", 1)], DOCS + ", score int")
    got = quality.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd.where("false"), model).collect() == []
    assert {r.score for r in quality.score(odd, quality.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_negative_labels_are_never_used(spark, labelled):
    docs, labels = labelled
    docs, labels = docs.where("doc_id < 1500"), labels.where("doc_id < 1500")
    swapped = labels.selectExpr("doc_id", "CASE WHEN quality = 0 THEN -7 ELSE quality END AS quality")
    want = quality.fit(docs, labels)
    for other in (swapped, labels.where("quality = 1")):
        got = quality.fit(docs, other)
        assert np.array_equal(want.weights, got.weights) and want.prior == got.prior


def test_trusted_and_unlabelled_documents_are_apart(spark, labelled):
    docs, labels = labelled
    rows = quality.samples(docs, labels, 700).select("doc_id", "trusted").collect()
    trusted, unlabelled = ({r.doc_id for r in rows if r.trusted == t} for t in (True, False))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(trusted) == len(unlabelled) == 700 and not trusted & unlabelled and trusted <= good
    assert unlabelled & good and unlabelled & bad and unlabelled - good - bad
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 for i in trusted | unlabelled)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_and_ranks_of_a_known_mixture(share):
    rnd = np.random.default_rng(3)
    n = len(quality.NAMES)
    good = lambda k: rnd.normal(0.6, 0.1, (k, n))
    bad = lambda k: rnd.normal(0.45, 0.1, (k, n))
    k = int(4000 * share)
    model = quality.fit_features(good(2000), np.r_[good(k), bad(4000 - k)])
    assert abs(model.prior - share) < 0.06
    assert (model.score(good(500)) >= 0.5).mean() > 0.93 and (model.score(bad(500)) < 0.5).mean() > 0.93


def test_least_risk_is_that_of_small_steps():
    """Away from the bound the risk is smooth: plain gradient steps end at the same weights."""
    rnd = np.random.default_rng(2)
    p = np.c_[rnd.normal(1, 1, (400, 2)), np.ones(400)]
    u = np.c_[np.r_[rnd.normal(1, 1, (600, 2)), rnd.normal(-1, 1, (600, 2))], np.ones(1200)]
    w = np.zeros(3)
    for _ in range(20000):
        sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
        g = -0.5 * (p * (1 - sp)[:, None]).mean(0) + (u * su[:, None]).mean(0) - 0.5 * (p * sp[:, None]).mean(0)
        w -= 0.5 * (g + np.array([1e-3, 1e-3, 0]) * w)
    assert np.abs(quality.minimise_risk(p, u, 0.5) - w).max() < 0.05


def test_risk_stays_non_negative_with_few_positives():
    rnd = np.random.default_rng(1)
    p, n = rnd.normal(2, 1, (30, 1)), rnd.normal(-2, 1, (500, 1))
    u = np.r_[rnd.normal(2, 1, (500, 1)), n]
    x = lambda z: np.c_[z, np.ones(len(z))]
    w = quality.minimise_risk(x(p), x(u), 0.5)
    assert (x(p) @ w > 0).mean() > 0.9 and (x(n) @ w < 0).mean() > 0.9


def _prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(n))


def _edited(rnd, text, k):
    words = text.split()
    for i in rnd.sample(range(len(words)), k):
        words[i] = "z" + str(rnd.randrange(10 ** 6))
    return " ".join(words)


def test_near_duplicates_equal_all_pairs(spark):
    rnd = random.Random(6)
    texts = {}

    def add(*ts):
        for t in ts:
            texts[rnd.randrange(10 ** 9) if len(texts) % 2 else len(texts)] = t

    base = _prose(rnd, 120)
    add(base, *[_edited(rnd, base, 2) for _ in range(60)])             # linked through the text they come from
    chain = _prose(rnd, 200)
    for _ in range(12):
        add(chain)
        chain = _edited(rnd, chain, 3)
    passage = _prose(rnd, 60)
    add(*[f"{_prose(rnd, rnd.randint(2, 30))} {passage} {_prose(rnd, rnd.randint(2, 12))}" for _ in range(150)])   # long lists
    for _ in range(40):                                                # about the threshold
        t = _prose(rnd, rnd.randint(20, 90))
        add(t, _edited(rnd, t, rnd.randint(1, 4)))
    add("same words here", "Same  words\nhere", "same words", "one two three four five", "one two three four five six", "", None, " ", " \t", "é" * 3000)
    add(*[_prose(rnd, 5000)] * 2)
    want = near_components(texts)
    rows = [(i, t, 1, "c") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, DOCS + ", n int, component string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_of_odd_rows(spark):
    t = "a b c d e f g"
    docs = spark.createDataFrame([(5, t), (5, t), (None, t), (9, t.upper()), (5, "other words under the same id"), (7, None)], DOCS)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 6 and {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 5, True), (9, 5, False), (None, None, True), (7, 7, True)}
    assert sorted((str(r.doc_id), r.text) for r in neardup.without_copies(docs).collect() if r.text) == sorted(
        [("5", "other words under the same id"), ("5", t), ("None", t)])
    assert neardup.near_duplicates(docs.where("false")).collect() == []


def test_a_copy_under_the_id_of_a_kept_text_goes(spark):
    t = "a b c d e f g"
    docs = spark.createDataFrame([(3, t, 1), (5, t.upper(), 2), (5, "other words under the same id", 3), (5, None, 4), (8, t, 5), (9, "alone", 6)], DOCS + ", row int")
    assert sorted(r.row for r in neardup.without_copies(docs).collect()) == [1, 3, 4, 6]


def test_near_duplicates_of_repeated_rows_that_share_a_passage(spark):
    """Each row four times: links that only the search by full sets finds stay the same."""
    rnd = random.Random(2)
    passage = _prose(rnd, 60)
    texts = {i: f"{_prose(rnd, rnd.randint(2, 30))} {passage} {_prose(rnd, rnd.randint(2, 12))}" for i in range(150)}
    docs = spark.createDataFrame([row for row in texts.items() for _ in range(4)], DOCS).repartition(4)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 600
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, n, c, c == i) for i, (n, c) in near_components(texts).items()}


def test_signatures_estimate_similarity():
    rnd = random.Random(8)
    a = _prose(rnd, 400)
    b = _edited(rnd, a, 12)
    x, y = shingle_set(a), shingle_set(b)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    h = MinHash(512)
    assert abs((h.signature(x) == h.signature(y)).mean() - true) < 0.08


def test_archives_give_back_every_payload(spark):
    big = "x€\r\n" * 300000
    rows = [(1, "u\n1", "a" * 2000), (2, None, "a" * 2000), (3, "u", None), (4, "u", big), (5, "u", big), (None, "u", "a" * 2000), (9, "", ""), (10, "u", "b" * 999), (11, "u", "b" * 999),
            (7, "u", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb\n"), (7, "u", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb\n"), (2, "dup", "a" * 2000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(2)
    folder = f"{tempfile.mkdtemp()}/warc"
    got = warc.archive_pages(pages, folder).collect()
    payload = {i: (h or "").encode() for i, _, h in rows}
    assert len(got) == len(rows) and all(r.intact for r in got)
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(payload[r.page_id]), hashlib.sha1(payload[r.page_id]).hexdigest())
        newest = {1: 2, None: 2, 4: 5}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", newest) if newest else ("response", None))
    chunks = sorted(warc.read_chunks(spark, folder, chunk=1000).where("page_id = 5").collect(), key=lambda r: r.chunk_no)
    assert b"".join(r.data for r in chunks) == big.encode() and max(len(r.data) for r in chunks) == 1000
    digest = hashlib.sha1()
    for r in chunks:
        digest.update(r.data)
        assert r.digest_so_far == digest.hexdigest()
    assert warc.archive_pages(pages.where("false"), f"{folder}-none").collect() == []


def test_leaks_equal_all_alignments(spark):
    rnd = random.Random(9)
    items = [(i, _prose(rnd, n)) for i, n in enumerate([8, 9, 15, 15, 20, 33, 60])] + [(90, "too short"), (91, None), (92, ""), (None, _prose(rnd, 9))]
    docs = []
    for i in range(160):
        _, item = items[i % 7]
        words = item.split()
        for _ in range(rnd.randint(0, len(words) // 4)):
            k = rnd.randrange(len(words))
            kind = rnd.random()
            words[k:k + (kind < 0.75)] = [] if kind < 0.25 else ["q" + str(rnd.randrange(99))] if kind < 0.75 else ["q", words[k]][:1]
        docs.append((i, f"{_prose(rnd, rnd.randint(0, 40))}, {' '.join(words).upper() if i % 3 else ' '.join(words)}. {_prose(rnd, rnd.randint(0, 40))}"))
    docs += [(500, None), (501, ""), (502, "too short"), (None, items[4][1]), (503, _prose(rnd, 4000) + " " + items[6][1]), (503, _prose(rnd, 10) + " " + items[6][1])]
    table = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", edits int")
    benchmark = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in decontam.find_leaks(table, benchmark).collect()}
    want = {}
    for d, text in docs:
        words = decontam.words_of(text or "")
        for i, item in items:
            wanted = decontam.words_of(item or "")
            if i is not None and len(wanted) >= 8:
                e = least_edits(wanted, words)
                if e <= int(0.2 * len(wanted)):
                    want[d, i] = min(e, want.get((d, i), 99))
    missed = set(want) - set(found)
    assert set(found) <= set(want) and len(missed) <= 0.02 * len(want)
    assert all(want[k] == 0 or k in found for k in want if k not in missed) and not [k for k in missed if want[k] == 0]
    assert all(found[k] == want[k] for k in found)
    left = {r.doc_id for r in decontam.without_leaks(table, benchmark).collect()}
    assert left == {d for d, _ in docs if not any(k[0] == d for k in found)}
    assert decontam.find_leaks(table, benchmark.where("false")).collect() == [] and decontam.find_leaks(table.where("false"), benchmark).collect() == []


def test_items_in_several_passes_give_the_same_leaks(spark, monkeypatch):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontam.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontam, "PASS_WORDS", 700)
    assert sorted(map(tuple, decontam.find_leaks(docs, items).collect())) == whole and len(whole) > 0


def test_pipeline_equals_its_stages_by_brute_force(spark):
    """Each stage is compared with a plain version of what it has to do to its own input."""
    folder_of_tables = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder_of_tables}/documents.parquet")
    columns = docs.columns
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        folder = f"{tempfile.mkdtemp()}/{name}"
        stage(spark, docs, folder_of_tables).write.parquet(folder)
        outputs.append((docs, spark.read.parquet(folder)))
        docs = outputs[-1][1]
    assert all(after.columns == columns for _, after in outputs[:-1])
    texts = [{r.doc_id: r.text for r in before.collect()} for before, _ in outputs]
    model = toxicity.fit(outputs[0][0], common.table(spark, folder_of_tables, "labels"))
    rejected = {r.doc_id for r in toxicity.score(outputs[0][0], model).where("score >= 0.5").collect()}
    assert set(texts[1]) == set(texts[0]) - rejected and rejected
    assert set(texts[2]) == {i for i, (_, c) in near_components(texts[1]).items() if c == i}
    items = [decontam.words_of(r.text) for r in common.table(spark, folder_of_tables, "benchmark").collect()]
    leaks = set()
    for i, t in texts[2].items():
        words = decontam.words_of(t)
        held = set(words)
        for item in items:
            # Aligned only where the words alone do not rule it out.
            if len(item) >= 8 and len(set(item) & held) >= len(set(item)) - int(0.2 * len(item)) and least_edits(item, words) <= int(0.2 * len(item)):
                leaks.add(i)
    assert set(texts[3]) == set(texts[2]) - leaks and leaks
    added = {r.doc_id: r.added for r in pii.find_pii(outputs[3][0]).collect()}
    for i, t in texts[3].items():
        spans = sorted([(a, b, k) for k, a, b in base_spans(t)] + [(s.start, s.stop, pii.KINDS[s.kind]) for s in added[i]])
        out, at = "", 0
        for a, b, k in spans:
            if b > at:
                out += t[at:a] + (f"[{k.upper()}]" if a >= at else "")
                at = b
        assert texts[4][i] == out + t[at:]
    pieces = outputs[4][1].collect()
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
    assert whole == {r.doc_id: r.doc_tokens for r in pieces} and set(whole) == set(texts[4])


def test_postings_are_dealt_once_by_token_and_once_by_node(spark, monkeypatch):
    """Counts, weights and leaders of the posting lists come from windows: each dealing is one shuffle of the postings."""
    plans = []

    def recorded(df):
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return durable(df)

    monkeypatch.setattr(neardup, "durable", recorded)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(words[k % 7:] + ["x"] * (k % 3))) for k in range(30)], "doc_id long, text string")
    assert len(neardup.near_duplicates(docs).collect()) == 30
    lists = next(plan for columns, plan in plans if "df" in columns)
    assert lists.count("Exchange hashpartitioning(token") == lists.count("Exchange hashpartitioning(node") == 1
    stars = next(plan for columns, plan in plans if columns == ["a", "b"])
    assert stars.count("Join") == 0
