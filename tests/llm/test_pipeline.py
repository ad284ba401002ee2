"""The corpus pipeline on planted documents: every stage against a plain restatement of it."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from tidecrew.llm import bpe

SPACES = r"[^\x20\x09-\x0D]+"
ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def planted():
    """Documents by id with, for some, what is planted in them; labels and benchmark items."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(3, 9)))
    line = lambda n=10: " ".join(word() for _ in range(n))
    text = lambda lines=6: "\n".join(line() for _ in range(lines))
    docs = {i: text() for i in range(1, 161)}
    insults = ["scumbag", "vermin", "filthy", "moron"]
    toxic = [*range(200, 280)]
    for i in toxic:
        docs[i] = "\n".join(f"{line(6)} {rnd.choice(insults)} {rnd.choice(insults)}" for _ in range(5))
    labels = [(i, 1, 0) for i in range(1, 121)] + [(i, 0, 1) for i in toxic[:60]]
    passage = text(7)
    docs[300], docs[301], docs[302] = f"{line()}\n{passage}\n{line()}", f"{text(3)}\n{passage}\n{text(2)}", f"{passage}\n{line(12)}"
    # One long line each, so that line dedup leaves them; a word at the end more is a near copy.
    long = " ".join(word() for _ in range(600))
    docs[310], docs[311] = long, f"{long} {word()}"
    items = {"q1": line(14), "q2": line(6), "q3": "", "q4": line(30)}
    docs[320] = f"{text(2)}\n{items['q1'].upper()}\n{text(1)}"
    docs[321] = f"{line(5)} {items['q2']}, {line(5)}\n{text(2)}"
    docs[322] = f"{text(1)}\n{' '.join(items['q4'].split()[:9])}\n{text(2)}"
    docs[330], docs[331], docs[332] = "", None, "  \n "
    return docs, toxic, labels, items, passage


def plain_fingerprint(text):
    words = re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Name and rows of the input and of every stage."""
    root = tmp_path_factory.mktemp("planted")
    docs, _, labels, items, _ = planted()
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    held = corpus_pipeline.table(spark, str(root), "documents")
    found = [("documents", held.collect(), held.columns)]
    for name, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.stored(stage(spark, held, str(root)), name)
        found.append((name, held.collect(), held.columns))
    whole = corpus_pipeline.run(spark, str(root)).collect()
    assert sorted(whole) == sorted(found[-1][1])
    return {name: rows for name, rows, _ in found}, {name: columns for name, _, columns in found}


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_stages_keep_the_columns(stages):
    rows, columns = stages
    assert all(columns[name] == columns["documents"] for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows["line_dedup"])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    docs, toxic, *_ = planted()
    assert set(texts(stages[0]["toxicity"])) == set(docs) - set(toxic)
    assert texts(stages[0]["toxicity"]) == {i: t for i, t in docs.items() if i not in toxic}


def test_later_copies_of_a_passage_go(stages):
    before, after = texts(stages[0]["toxicity"]), texts(stages[0]["line_dedup"])
    passage = planted()[-1].split("\n")
    want = dict(before)
    for i in (301, 302):
        want[i] = "\n".join(line for line in before[i].split("\n") if line not in passage)
    assert {i: t or "" for i, t in after.items()} == {i: t or "" for i, t in want.items()}


def test_one_of_each_group_of_near_copies_stays(stages):
    before, after = texts(stages[0]["line_dedup"]), texts(stages[0]["near_dedup"])
    prints = {i: plain_fingerprint(t) for i, t in before.items()}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                root[max(top(a), top(b))] = min(top(a), top(b))
    assert set(after) == {top(i) for i in prints} and all(after[i] == before[i] for i in after)
    assert len({330, 331, 332} & set(after)) == 1


def test_documents_with_benchmark_windows_go(stages):
    before, after = texts(stages[0]["near_dedup"]), texts(stages[0]["decontamination"])
    words = lambda t: re.findall(ITEM_WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for item in planted()[3].values():
        own = words(item)
        size = min(10, len(own))
        windows |= {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()

    def hit(text):
        own = words(text)
        return any(tuple(own[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(own) - n + 1))

    assert set(after) == {i for i, t in before.items() if not hit(t)}
    assert 320 not in after and 321 not in after and 322 in after


def test_tokens_are_those_of_the_library(stages):
    before = texts(stages[0]["decontamination"])
    tokens = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rows = stages[0]["tokens"]
    assert {r.doc_id for r in rows} == set(before)
    for r in rows:
        ids = np.array(known.encode_ordinary(before[r.doc_id] or ""), dtype="<u4").tobytes()
        assert r.ids_sha256 == sha256(ids).hexdigest() and r.n_tokens == len(ids) // 4
        assert r.decoded_sha256 == sha256((before[r.doc_id] or "").encode()).hexdigest()
