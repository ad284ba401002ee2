"""Operators with one right answer, against plain restatements of it."""

from __future__ import annotations

import collections
import gzip
import random
import re
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidecrew.llm import bpe, linededup, simhash, warc, wumanber

ITEM_WORDS = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def documents(spark, rows):
    """Rows of (id, text), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, row string, key int, fp string")


@pytest.fixture(scope="module")
def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_equals_the_reference_tokenizer(spark, ranks):
    tokens = bpe.read_ranks(ranks)
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}
    )
    rnd = random.Random(3)
    odd = " \n\t'sa1é\x1c\x85　.,!xyz  ▁ßñ漢😀<|endoftext|>"
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(40))) for _ in range(500)]
    texts += ["", None, "x" * 50_000, " " * 5_000, *[f"{chr(c)}'s" for c in (0x558, 0x32474, 0x1C, 0x3000, 0x250)]]
    docs = documents(spark, [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])])
    got = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        text = texts[row.doc_id] or ""
        want = np.array(known.encode_ordinary(text), dtype="<u4").tobytes()
        assert row.ids == want and row.n_tokens == len(want) // 4
        assert row.decoded_sha256 == sha256(text.encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), ranks, public_tokenizers.PATTERN).collect() == []
    back = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert {bytes(r.bytes).decode() for r in back.collect()} == {t or "" for t in texts}


@pytest.mark.parametrize("segment,chunk", [(300, 64), (32_768, 4_096)])
def test_archives_give_back_every_payload(spark, tmp_path, segment, chunk):
    rnd = random.Random(1)
    bodies = ["", None, "short", "é" * 99, "\r\n\r\nWARC/1.1\r\n" * 40, *["".join(rnd.choices("abé\n", k=rnd.randrange(3000))) for _ in range(20)]]
    rows = [(i, f"http://h/{i} x", bodies[i % len(bodies)]) for i in range(60)] + [(None, None, "z" * 200), (7, None, bodies[7])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "a")
    warc.write_archives(pages, path, segment_bytes=segment, chunk_bytes=chunk, records_per_archive=7)
    got = warc.resolved(warc.read_archives(spark, path)).collect()
    first: dict[bytes, int] = {}
    for i, _, body in rows:
        data = (body or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    want = []
    for i, _, body in rows:
        data = (body or "").encode()
        again = data in first and first[data] != i
        want.append((i, len(data), sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None, None))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_a_missing_segment_is_told(spark):
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    parts = [{"segment": k, "kind": "response", "page_id": 1, "digest": None, "total": 40, "block": block} for k in (1, 3)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"origin_id": "<a>", "parts": parts}])
    (out,) = warc._join_segments(iter([batch]))
    assert out.to_pylist()[0]["problem"] == "a segment is missing"


def record(i, body=None, **fields):
    body = f"HTTP/1.1 200 OK\r\n\r\nbody {i} \r\n\r\nWARC".encode() if body is None else body
    lines = {"WARC-Type": "response", "WARC-Record-ID": f"<{i}>", "X-Page-ID": i, "Content-Length": len(body), **fields}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None)
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def read_back(archive, piece=1 << 18):
    old, warc.READ_BYTES = warc.READ_BYTES, piece
    try:
        return [(f.get("x-page-id"), problem) for f, _, problem in warc.parse(warc.inflated(archive))]
    finally:
        warc.READ_BYTES = old


@pytest.mark.parametrize("piece", [7, 100, 1 << 18])
def test_members_damage_and_wrong_lengths(piece):
    whole = [record(i) for i in range(5)]
    wanted = [(str(i), None) for i in range(5)]
    one = gzip.compress(b"".join(whole))
    each = [gzip.compress(r) for r in whole]
    assert read_back(one, piece) == read_back(b"".join(each), piece) == read_back(b"".join(each) + b"\0" * 20, piece) == wanted
    assert read_back(gzip.compress(b"".join(whole[:2])) + gzip.compress(b"".join(whole[2:])), piece) == wanted
    assert read_back(b"", piece) == []
    # Cut short: what is whole is kept, and the loss is told.
    cut = read_back(b"".join(each)[: -len(each[-1]) // 2 - len(each[-1]) // 4], piece)
    assert cut[:3] == wanted[:3] and any(problem for _, problem in cut)
    raw = b"".join(whole)
    assert read_back(gzip.compress(raw[: raw.rindex(b"body 4")]), piece) == [*wanted[:4], (None, "the archive is cut short")]
    # A damaged member costs its own records only.
    bad = bytearray(each[2])
    bad[15] ^= 0xFF
    bad[20] ^= 0xFF
    got = read_back(b"".join([*each[:2], bytes(bad), *each[3:]]), piece)
    assert [g for g in got if g[1] is None and g[0] != "2"] == [w for w in wanted if w[0] != "2"]
    assert sum(problem is not None for _, problem in got) == 1
    # Wrong or missing lengths, and what is no record.
    for wrong in (record(9, **{"Content-Length": "x"}), record(9, **{"Content-Length": None}), b"hello\r\n\r\nyou\r\n\r\n", record(9, **{"WARC-Type": None})):
        got = read_back(gzip.compress(whole[0] + wrong + whole[1]), piece)
        assert got[0] == wanted[0] and got[-1] == wanted[1] and sum(problem is not None for _, problem in got) == 1


def test_damaged_archives_do_not_end_the_job(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(3)))
    (tmp_path / "a" / "2.warc.gz").write_bytes(gzip.compress(record(7) + record(8))[:-30])
    (tmp_path / "a" / "3.warc.gz").write_bytes(b"no archive at all")
    rows = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert {0, 1, 2} <= {r.page_id for r in rows if r.problem is None}
    assert sum(r.kind == "damaged" for r in rows) >= 2


def test_empty_pages_give_no_records(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"))
    assert warc.resolved(warc.read_archives(spark, str(tmp_path / "a"))).collect() == []


@pytest.mark.parametrize("block_words", [40, 400_000])
def test_benchmark_search_equals_brute_force(spark, block_words):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "b", "É", "c1", "dd"])
    items = [" ".join(word() for _ in range(rnd.choice([1, 3, 6, 9, 10, 12, 60]))) for _ in range(12)]
    items += [None, "", "...", items[6]]
    texts = [rnd.choice([" ", "-", "\n"]).join(word().upper() for _ in range(rnd.randrange(120))) for _ in range(60)]
    texts += ["x " + (items[6] or "") + " y", None, "", "q " * 70_000]
    docs = documents(spark, list(enumerate(texts)) + [(3, texts[3])])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = wumanber.contaminated_words(docs, bench, block_words=block_words).collect()
    words = lambda t: re.findall(ITEM_WORDS, (t or "").encode().lower())
    needles: dict[tuple, set] = {}
    for i, t in enumerate(items):
        w = words(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            needles.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    assert len(found) == len(texts) + 1
    for row in found:
        w, hit, own = words(texts[row.doc_id]), set(), set()
        for size in {len(n) for n in needles}:
            for k in range(len(w) - size + 1):
                if ids := needles.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    own |= ids
        assert (row.n_words, row.n_hit, list(row.items)) == (len(w), len(hit), sorted(own))
    none = wumanber.contaminated_words(docs, bench.limit(0)).collect()
    assert all(r.n_hit == 0 and r.items == [] for r in none)


def plain_fingerprint(text: str, size: int) -> int:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints_follow_their_definition():
    for text in ("", "A", "a É\x1cb c", "x y z w " * 40, "  a"):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("rows", [simhash.ROWS, 10])
def test_links_and_groups_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "ROWS", rows)
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
    values = {0, *[int(b) for b in base]}
    for b in base[:20]:
        for _ in range(40):
            bits = rnd.choice(64, rnd.integers(1, 5), replace=False)
            values.add(int(b) ^ sum(1 << int(k) for k in bits))
    values = np.unique(np.array(sorted(values), dtype=np.uint64))
    classes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(classes, 2, sample=300, shard=25)).collect()}
    up = list(range(len(values)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            up[root(i)] = root(int(j))
    signed = values.view(np.int64).tolist()
    groups = collections.defaultdict(list)
    for i, v in enumerate(signed):
        groups[root(i)].append(v)
    want = {v: min(g) for g in groups.values() for v in g if v != min(g)}
    assert roots == want and len(groups) < len(signed)


def test_one_document_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long), (9, long + " end"), (1, "other text altogether here"), (None, None), (2, ""), (1, "other text altogether here")]
    kept = simhash.one_of_each(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "row", "key", "fp"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids) == [1, 2, 3] or sorted(ids) == [1, 2, 3, 9]
    assert simhash.grouped(documents(spark, rows).limit(0)).collect() == []


def test_repeated_runs_go_and_their_first_occurrence_stays(spark):
    rnd = random.Random(4)
    line = lambda n: " ".join(f"t{rnd.randrange(10**6)}" for _ in range(n))
    passage, one = [line(12) for _ in range(5)], line(55)
    rows = [
        (1, "\n".join([line(9), *passage, line(9)])),
        (2, "\n".join([line(30), *passage[:2], "", *passage[2:], line(8)])),
        (3, "\n".join([one, line(20)])),
        (4, f"{line(10)}\n{one}"),
        (5, "\n".join([line(10), passage[0], line(10)])),
        (6, one),
        (7, None),
        (8, ""),
        (9, "\n".join([one, line(5), one])),
        (10, "short\n\n  \nshort\n"),
    ]
    got = {r.doc_id: r.text for r in linededup.deduplicated(documents(spark, rows)).collect()}
    texts = dict(rows)
    for same in (1, 3, 5, 7, 8, 10):
        assert got[same] == texts[same]
    assert got[2] == "\n".join([texts[2].split("\n")[0], texts[2].split("\n")[-1]])
    assert got[4] == texts[4].split("\n")[0] and got[6] == "" and got[9] == texts[9].split("\n")[1]
    assert linededup.deduplicated(documents(spark, rows).limit(0)).collect() == []


def test_repeated_rows_are_one_document(spark):
    rnd = random.Random(7)
    line = lambda n: " ".join(f"t{rnd.randrange(10**6)}" for _ in range(n))
    passage = [line(10) for _ in range(8)]
    texts = ["\n".join([*[line(10) for _ in range(4)], *passage, line(10)]) for _ in range(4)]
    # The first document and the third are given twice, the last one without an id.
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[2]), (None, texts[3]), (None, texts[3])]
    got = linededup.deduplicated(documents(spark, rows)).collect()
    own = lambda text: "\n".join([*text.split("\n")[:4], text.split("\n")[-1]])
    want = [(1, texts[0])] * 2 + [(2, own(texts[1]))] + [(3, own(texts[2]))] * 2 + [(None, own(texts[3]))] * 2
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)


def test_no_run_is_left_twice(spark):
    rnd = random.Random(8)
    pool = [" ".join(f"p{k}_{i}" for i in range(rnd.randrange(1, 30))) for k in range(60)]
    rows = []
    for d in range(80):
        at = rnd.randrange(50)
        rows.append((d, "\n".join([f"own {d} a", *pool[at : at + rnd.randrange(9)], f"own {d} b"])))
    got = {r.doc_id: r.text for r in linededup.deduplicated(documents(spark, rows)).collect()}
    size = lambda run: sum(len(x.split()) for x in run)

    def runs(lines):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if size(lines[i:j]) >= linededup.GRAM + linededup.WINDOW - 1:
                    yield tuple(lines[i:j])
                    break

    seen, lines_seen = set(), set()
    for d, text in rows:
        left = got[d].split("\n")
        assert not seen & set(runs(left))
        assert set(text.split("\n")) - set(left) <= lines_seen
        seen |= set(runs(text.split("\n")))
        lines_seen |= set(text.split("\n"))


def test_extra_columns_are_carried(spark):
    docs = documents(spark, [(1, "a")]).withColumn("n_lines", F.lit(3))
    assert linededup.deduplicated(docs).columns == docs.columns
