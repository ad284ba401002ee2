"""Language-model scores, importance resampling and hard negatives against plain restatements."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidecrew.llm import markov, negatives, queries, resampling
from tidecrew.llm.pieces import pieces, word_lists
from tidecrew.llm.tables import fold_of, table
from tidecrew.llm.words import NOT_ALPHANUMERIC, SPACES


def documents(spark, rows):
    """Rows of (id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2.0) for i, t in rows], "doc_id long, text string, id string, part int, learn string, score double")


def test_pieces_cut_no_word():
    rnd = random.Random(2)
    for _ in range(50):
        text = bytes(rnd.choice(b"ab \n\x01\xc3") for _ in range(rnd.randrange(200)))
        for size in (1, 7, 1000):
            assert b"".join(pieces(text, SPACES, size)) == text
            assert sum(word_lists(text, SPACES, False, size), []) == text.split()


# --- hidden Markov model


def small_model(rnd, classes, states):
    base = np.array([rnd.random() for _ in range(classes)] + [0.01])
    base /= base.sum()
    model = markov.first_model(base, states)
    start = np.array([rnd.random() + 0.1 for _ in range(states)])
    moves = np.array([[rnd.random() + 0.1 for _ in range(states)] for _ in range(states)])
    return base, markov.Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), model.ratios)


def paths(model, text):
    """Every path through the states with its weight: a silent first state, then one move per token."""
    k = len(model.start)
    for path in itertools.product(range(k), repeat=len(text) + 1):
        weight = model.start[path[0]]
        for a, b, token in zip(path[:-1], path[1:], text, strict=True):
            weight *= model.moves[a, b] * model.ratios[token, b]
        yield path, weight


@pytest.mark.parametrize("segment", [2, 3, 100])
def test_recursions_equal_all_paths(segment):
    rnd = random.Random(segment)
    base, model = small_model(rnd, 5, 3)
    texts = [[rnd.randrange(6) for _ in range(n)] for n in (1, 2, 5, 6, 1, 4)]
    tokens, lengths = np.concatenate(texts).astype("<i4"), np.array([len(t) for t in texts])
    got = markov.likelihoods(model, tokens, lengths, segment)
    counts = markov.expected(model, tokens, lengths, segment)
    start, moves, classes = np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))
    for text, value in zip(texts, got, strict=True):
        total = sum(w for _, w in paths(model, text))
        assert value == pytest.approx(math.log(total))
        for path, weight in paths(model, text):
            start[path[0]] += weight / total
            for a, b, token in zip(path[:-1], path[1:], text, strict=True):
                moves[a, b] += weight / total
                classes[token, b] += weight / total
    assert np.allclose(counts.start, start) and np.allclose(counts.moves, moves) and np.allclose(counts.classes, classes)
    assert counts.log == pytest.approx(got.sum())


def test_long_texts_do_not_underflow_and_models_add_up():
    rnd = random.Random(5)
    base, model = small_model(rnd, 40, 8)
    tokens = np.array([rnd.randrange(41) for _ in range(30_000)], dtype="<i4")
    whole = markov.likelihoods(model, tokens, np.array([30_000]), 30_000)
    assert np.allclose(markov.likelihoods(model, tokens, np.array([30_000]), 512), whole)
    better = markov.improved(base, markov.expected(model, tokens, np.array([30_000])))
    assert np.allclose(base @ better.ratios, 1.0) and np.allclose(better.moves.sum(axis=1), 1.0)
    assert markov.likelihoods(better, tokens, np.array([30_000]))[0] > whole[0]


def plain_tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [b""]


def plain_base(rows, held):
    counts = collections.Counter(t for i, text in rows if not held(i) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    return counts, n, lambda t: math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1)))


def test_blocks_hold_every_document_once():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["Aé", "b", "cc"], k=rnd.randrange(40))) for _ in range(100)] + [None, ""]
    batches = pa.table({"id": list(range(102)), "text": texts}).to_batches(max_chunksize=17)
    for size in (1, 200, 1 << 20):
        found = list(markov.blocks(iter(batches), size))
        assert sum((b.rows.column("id").to_pylist() for b in found), []) == list(range(102))
        assert (len(found) == 1) == (size == 1 << 20)
        tokens = sum((b.words.take(pa.array(b.tokens)).to_pylist() for b in found), [])
        assert tokens == sum((plain_tokens(t) for t in texts), [])
        assert sum((b.lengths.tolist() for b in found), []) == [len(plain_tokens(t)) for t in texts]
    assert list(markov.blocks(iter([]))) == []


@pytest.mark.parametrize("share", [markov.SHARE, 4])
def test_base_scores_and_partitioning(spark, monkeypatch, share):
    monkeypatch.setattr(markov.vocabulary, "__defaults__", (share,))
    rnd = random.Random(9)
    words = [f"W{k}é" for k in range(30)] + ["x", "yy", "\x01"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(30))) + rnd.choice([" ", "\n\t", ""])) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "  \n"), (None, "only\x1cone w1é"), (5, rows[5][1]), (63, "w1é " * 5000 + "never")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts, n, log = plain_base(rows, held)
    docs = documents(spark, rows)
    results = []
    for parts in (1, 7):
        found = markov.scored(docs.repartition(parts), fold_of("doc_id", 5) != 1, rounds=2).collect()
        assert len(found) == len(rows) and {r.train_tokens for r in found} == {n}
        texts = collections.defaultdict(list)
        for i, text in rows:
            tokens = plain_tokens(text)
            texts[i].append((len(tokens), sum(counts[t] > 0 for t in tokens), round(sum(map(log, tokens)), 6)))
        got = collections.defaultdict(list)
        for r in found:
            got[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6)))
            assert r.learn is not held(r.doc_id) and r.score < 0
        assert got == texts
        results.append(sorted((r.doc_id or -1, round(r.score, 6)) for r in found))
    assert results[0] == results[1]
    assert markov.scored(docs.limit(0), F.lit(True)).collect() == []
    nothing = markov.scored(docs, F.lit(False), rounds=1).collect()
    assert all(r.n_known == r.train_tokens == 0 and r.score == pytest.approx(r.base_score) == 0.0 for r in nothing)


def test_scores_beat_the_base_on_held_out_texts(spark):
    rows = queries.op11_hidden_markov(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    counts, n, log = plain_base(docs.items(), lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.base_score == pytest.approx(sum(map(log, plain_tokens(docs[r.doc_id]))))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


# --- importance resampling


def test_runs_from_prefixes_equal_direct_checksums():
    texts = [b"", b"  ", b"One", b"Hello,  World x", " Éa zß 12 bb — q".encode(), b"a" * 3000 + b" b" * 500, b"x y"]
    scan = resampling.scanned(texts)
    split = [re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for t in texts]
    for n in (1, 2, 3, 5):
        got, counts = resampling.runs_of(scan, n)
        assert counts.tolist() == [max(0, len(w) - n + 1) for w in split]
        assert got.tolist() == [zlib.crc32(b" ".join(w[i : i + n])) for w in split for i in range(len(w) - n + 1)]


def plain_draw(docs, target, longest, buckets):
    def runs(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        return [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)

    source = collections.Counter(b for _, text in docs for b in runs(text)[0])
    aims = collections.Counter(b for text in target for b in runs(text)[0])
    all_source, all_target = sum(source.values()), sum(aims.values())
    gain = [math.floor(1000 * math.log((aims[b] + 1) * (all_source + buckets) / ((source[b] + 1) * (all_target + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        found, n = runs(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        draw = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((draw + 0.5) / 4294967296))), n])
    enough = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = [tuple(r[:4]) + (k + 1,) for k, r in enumerate(enough[: len(enough) // 10])]
    return drawn + [tuple(r[:4]) + (None,) for r in enough[len(enough) // 10 :]] + [tuple(r[:4]) + (None,) for r in out if r[4] < 20]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 10_000), (2, 70_000)])
def test_resampling_equals_plain_version(spark, longest, buckets):
    rnd = random.Random(longest)
    words = ["The", "a", "été", "x1", "zz", *[f"w{k}" for k in range(50)]]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " -- "), (None, "q " * 30), (7, rows[7][1]), (203, "w1 " * 20_000)]
    target = [" ".join(rnd.choices(words[:10], k=20)) for _ in range(5)] + [None]
    docs = documents(spark, rows).repartition(5)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(docs, aims, longest=longest, buckets=buckets).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(plain_draw(rows, target, longest, buckets), key=order)
    assert resampling.resampled(docs.limit(0), aims).collect() == []
    assert len(resampling.resampled(docs, aims.limit(0)).collect()) == len(rows)


def test_runs_across_pieces(monkeypatch):
    monkeypatch.setattr(word_lists, "__defaults__", (64,))
    text = " ".join(f"w{k}é" for k in range(500)).encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    scan = resampling.scanned([text, text])
    for n in (1, 4):
        want = [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
        assert resampling.runs_of(scan, n)[0].tolist() == want * 2
    assert sum(word_lists(text, NOT_ALPHANUMERIC, True, 64), []) == words


# --- hard negatives


@pytest.mark.parametrize("size", [1, 300, 10**6, 2**26])
def test_products_are_exact(size):
    rnd = random.Random(size)
    a, b = ([[rnd.randrange(-size, size + 1) for _ in range(70)] for _ in range(9)] for _ in range(2))
    bound = max(sum(x * x for x in row) for row in a + b)
    primes = negatives.primes_for(bound)
    got = negatives.products(*[negatives.residues(np.array(m, dtype=np.float64), primes) for m in (a, b)])
    assert got.tolist() == [[sum(x * y for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    # The signs at the very ends of the range.
    one = np.full((1, 4), float(size))
    ends = negatives.residues(one, negatives.primes_for(4 * size * size)), negatives.residues(-one, negatives.primes_for(4 * size * size))
    assert negatives.products(*ends).tolist() == [[-4 * size * size]]


def plain_negatives(rows):
    known = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        known[i] = max(known.get(i, (label, vector)), (label, vector))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in known.items()}
    out = []
    for a in (i for i in whole if i % 100 == 0):
        scores = {i: sum(x * y for x, y in zip(whole[a][1], v, strict=False)) for i, (_, v) in whole.items() if i != a}
        best = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in best if whole[i][0] == whole[a][0]][:5]:
            near = [i for i in best if whole[i][0] != whole[a][0] and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]][:5]
            out += [(a, p, k + 1, i, scores[p], scores[i]) for k, i in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"ROWS": 40, "ANCHORS": 2, "ROWS_AT_ONCE": 16, "ANCHORS_AT_ONCE": 2}])
def test_negatives_equal_brute_force(spark, monkeypatch, tmp_path, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(negatives, name, value)
    rnd = random.Random(8)
    rows = [(i * 5, rnd.randrange(3), [rnd.choice([0.1, 0.2, -0.1, rnd.random()]) for _ in range(6)]) for i in range(300)]
    rows += [(i, 1, [0.25] * 6) for i in range(1, 60, 2)]  # ties
    rows += [(10_000, None, [0.1] * 6), (10_100, 1, None), (10_200, 1, [0.1, None]), (10_300, 2, [float("nan")] * 6), (10_400, 2, [float("inf")])]
    rows += [(None, 1, [0.5] * 6), (10_500, 1, []), (10_600, 0, [0.5] * 4), (200, 2, [0.9] * 6), (200, 2, [0.9] * 6)]
    schema = "vec_id long, label int, embedding array<float>"
    spark.createDataFrame([(i, label, v) for i, label, v in rows], schema).withColumns({"id": F.lit("x"), "task": F.lit(0)}).write.parquet(f"{tmp_path}/embeddings.parquet")
    exact = [(i, label, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    got = queries.op13_residue_negatives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == plain_negatives(exact)
    empty = spark.createDataFrame([], schema)
    assert negatives.hard_negatives(empty, F.col("id") % 100 == 0).collect() == []


def test_products_that_do_not_fit_are_refused(spark):
    rows = spark.createDataFrame([(0, 1, [1e9]), (1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(ValueError, match="bits"):
        negatives.hard_negatives(rows, F.col("id") % 100 == 0)
