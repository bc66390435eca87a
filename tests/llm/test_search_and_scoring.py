"""Scoring, ranked search and resampling against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, rank int, item string, id int, n long, row string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(("ba", "ce", "dio", "fu", "Ga", "hé", "ly", "7")) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    out = [(k, prose(k, 5 + 9 * (k % 9))) for k in range(60)]
    out += [(60, None), (61, ""), (62, " \t.!"), (None, prose(1, 30)), (None, None), (63, "x" * 100_000), (64, "Ba ce ba\nÉté " * 9_000)]
    out += [(65, prose(3, 32))] * 4 + [(k, prose(5, 50)) for k in range(70, 95)] + [(3, prose(3, 32))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, text, 0.5, 1, "i", 2, 3, "r") for k, text in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ITEMS = [("a", prose(3, 12)), ("b", prose(5, 20)), ("b", "ZEBRA ba"), (None, "été ba"), ("c", None), ("d", "!!"), ("a", prose(3, 12)), ("e", "nowhere-seen")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(item, text, 1) for item, text in ITEMS], "item_id string, text string, score int")


# 11


def test_log_bilinear_against_plain_counts(spark, docs, texts):
    from sessionlake.llm.log_bilinear import crc_rest, scored

    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    tokens = lambda text: [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)), None]
    count = Counter(token for k, text in texts if not held(k) for token in tokens(text))
    total, distinct = sum(count.values()), len(count)

    def row(k, text):
        own = tokens(text)
        return k, held(k), len(own), sum(count[t] > 0 for t in own), total, round(sum(math.log10((count[t] + 1) / (total + distinct + 1)) for t in own), 6)

    out_of = crc_rest(F.col("doc_id"), 7) == 2
    for frequent in (262_144, 40):  # with and without tokens that are joined
        got = scored(docs, out_of, words=20, frequent=frequent)
        assert got.columns == ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        rows = got.collect()
        assert sorted([(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows], key=repr) == sorted((row(*each) for each in texts), key=repr)
        assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert scored(docs.where("false"), out_of).count() == 0
    only = scored(docs.where("doc_id = 61 OR doc_id = 60"), F.lit(True)).collect()  # nothing to learn from
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in only] == [(1, 0, 0, 0.0)] * 2


def test_log_bilinear_is_normalised_and_learns():
    from sessionlake.llm.log_bilinear import END, Model, contexts

    draw = np.random.default_rng(1)
    size, many = 40, 60_000
    follow = draw.permutation(size)  # a token is mostly followed by its partner
    ids = np.empty(many, np.int64)
    ids[0] = 5
    for at in range(1, many):
        ids[at] = follow[ids[at - 1]] if draw.random() < 0.7 else draw.integers(size)
    cut = np.arange(0, many + 1, 500)
    unigrams = np.bincount(ids, minlength=size) / many
    model = Model(unigrams, 12)
    before = model.log10_probabilities(ids, *contexts(ids, cut)).mean()
    for _ in range(3):
        model.train(ids, cut, np.random.default_rng(2), 256)
    after = model.log10_probabilities(ids, *contexts(ids, cut)).mean()
    assert after > before + 0.3
    every = np.arange(size)
    for one, two in ((3, 4), (END, END), (0, 39)):
        assert abs((10 ** model.log10_probabilities(every, np.full(size, one), np.full(size, two))).sum() - 1) < 1e-4
        # One by one, without matrix products.
        h = model.q[one].astype(float) * model.c[0] + model.q[two].astype(float) * model.c[1]
        plain = np.array([h @ model.r[w].astype(float) + model.b[w] for w in every])
        plain -= math.log(np.exp(plain).sum())
        assert np.allclose(plain / math.log(10), model.log10_probabilities(every, np.full(size, one), np.full(size, two)), atol=1e-4)


def test_log_bilinear_scores_held_out_texts_better_than_counts(spark):
    from sessionlake.llm.log_bilinear import op11_log_bilinear

    rows = op11_log_bilinear(spark, SMALL).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count() and len(held) > 10
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_weights_of_tasks_are_averaged_by_tokens():
    import pyarrow as pa

    from sessionlake.llm.log_bilinear import _merge

    parts = [(1, np.full(3, 2.0)), (3, np.full(3, 6.0) * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts]), pa.array([flat.tobytes() for _, flat in parts], pa.binary())], ["seen", "flat"])
    merged = next(iter(_merge([batch])))
    assert merged.column(0)[0].as_py() == 4 and (np.frombuffer(merged.column(1)[0].as_py()) / 4 == 5).all()


# 12


def plain_ranks(docs, items, top):
    counts = [(k, Counter(words(text))) for k, text in docs if words(text)]
    n_docs, n_words = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for k, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, k is None, k or 0))
        for rank, (score, null, k) in enumerate(sorted(scores)[:top], 1):
            out.append((item, rank, None if null else k, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, terms", [(8_192, 50_000), (7, 50_000), (40, 10)])
def test_ranks_against_plain_scores(docs, texts, items, block, terms):
    from sessionlake.llm.ball_tree import ranked

    got = ranked(docs, items, block=block, block_terms=terms)
    assert got.columns == ["item", "rank", "id", "score"]
    assert sorted([tuple(row) for row in got.collect()], key=repr) == plain_ranks(texts, ITEMS, 10)


def test_ranks_of_empty_tables(docs, items):
    from sessionlake.llm.ball_tree import ranked

    assert ranked(docs.where("false"), items).count() == 0 and ranked(docs, items.where("false")).count() == 0


def test_balls_bound_their_rows_and_are_left_out():
    from sessionlake.llm.ball_tree import BallTree, Best, search_tree

    draw = np.random.default_rng(3)
    rows, width = 3_000, 60
    centre = draw.integers(0, 6, rows)  # six kinds of rows with terms of their own
    term = np.sort(np.stack([draw.permutation(10)[:5] for _ in range(rows)]) + 10 * centre[:, None], axis=1).reshape(-1)
    value = draw.integers(1, 1_000_000, rows * 5)
    cut = np.arange(0, rows * 5 + 1, 5)
    tree, ids = BallTree(cut, term, value, width, 32), draw.permutation(rows)
    plain = np.zeros((rows, width), np.int64)
    np.add.at(plain, (np.repeat(np.arange(rows), 5), term), value)
    seen = 0
    for kind in range(6):
        asked, weight = np.arange(10 * kind, 10 * kind + 4), draw.integers(1, 9_000, 4)
        exact = plain[:, asked] @ weight
        for bound, (members, _, _) in zip(tree.bounds(asked, weight), tree.balls):
            assert exact[members].max() <= bound
        best, dense = Best(10), np.zeros(width, np.int64)
        seen += search_tree(tree, ids, asked, weight, dense, best)
        order = np.lexsort((ids, -exact))[:10]
        assert (best.score == exact[order]).all() and (best.id == ids[order]).all() and not dense.any()
    assert seen < 6 * rows / 3


# 13


def plain_importance(docs, items, seed, percent, least):
    bucket = lambda word: zlib.crc32(word.encode()) % 10_000
    s, t = (Counter(bucket(w) for _, text in side for w in words(text)) for side in (docs, items))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for k, text in docs:
        own = words(text)
        weight = sum(gain(bucket(w)) for w in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((row for row in rows if row[1] >= least), key=lambda row: (-row[3], row[0] is None, row[0] or 0, -row[2], -row[1]))
    for rank, row in enumerate(fit[:percent * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(row) for row in rows), key=repr)


@pytest.mark.parametrize("percent, least", [(10, 20), (100, 1), (0, 20), (50, 10**6)])
def test_importance_against_plain_sums(docs, texts, items, percent, least):
    from sessionlake.llm.importance import resample

    got = resample(docs, items, seed=2024, percent=percent, min_words=least)
    assert got.columns == ["id", "n_features", "weight", "score", "rank"]
    assert sorted([tuple(row) for row in got.collect()], key=repr) == plain_importance(texts, ITEMS, 2024, percent, least)


def test_importance_of_empty_tables(docs, texts, items):
    from sessionlake.llm.importance import resample

    assert resample(docs.where("false"), items, seed=1).count() == 0
    assert sorted([tuple(row) for row in resample(docs, items.where("false"), seed=1).collect()], key=repr) == plain_importance(texts, [], 1, 10, 20)


def test_bit_planes_add_up_exactly():
    from sessionlake.llm.importance import crc32s, gain_planes, gain_sums

    draw = np.random.default_rng(7)
    for buckets in (1, 63, 64, 1_000):
        gains = draw.integers(-40_000, 40_000, buckets)
        row, bucket = np.sort(draw.integers(0, 9, 5_000)), draw.integers(0, max(1, buckets // 3), 5_000)  # large counts
        want = np.bincount(row, gains[bucket], 9).astype(np.int64)
        assert (gain_sums(row, bucket, 9, buckets, gain_planes(gains)) == want).all()
    assert (gain_sums(np.zeros(0, int), np.zeros(0, int), 3, 10, gain_planes(np.zeros(10, int))) == 0).all()
    raw = draw.integers(0, 256, 4_000).astype(np.uint8)
    ends = np.sort(draw.integers(0, 4_001, 90))
    starts = np.maximum(ends - draw.integers(0, 90, 90), 0)
    assert crc32s(raw, starts, ends).tolist() == [zlib.crc32(raw[s:e].tobytes()) for s, e in zip(starts, ends)]
