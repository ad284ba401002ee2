"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled documents, as many of either class where there are enough.  Their vectors hold all
their terms: term frequency, times the inverse document frequency counted over the whole corpus, times a weight that grows with
the term's chi-square over the examples, so that words that tell the classes apart count most and none is left out.  A text's norm
is over all its words; those that no example has count as if one document had them.  The inverted index has a posting list per term,
cut into blocks of examples with each block's largest weight; the lists of common terms are written out as
a matrix, and their part of the similarities is exact from the start.  A query adds up an upper bound per block, visits the blocks of the
highest bounds, and then only those whose bound reaches the nearest examples found there, so the neighbours are exact.  Their votes, weighted by
similarity and class share, are mapped to probabilities by an isotonic fit on further labelled rows, and are returned as evidence.

Defined cases: NULL and empty texts, and those without an indexed term, have no neighbours and the vote of the class
share; equal similarities are ordered by example id; equal votes have equal scores; repeated rows get equal results; without labels
of both classes every vote is the share of toxic labels, 0 if there are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidecrew.llm.docstats import texts_of
from tidecrew.llm.samples import sample_of
from tidecrew.llm.tables import fold_of, stored
from tidecrew.llm.words import NOT_ALPHANUMERIC, chunks, words_of

# Labelled rows of either class among the examples, and rows of the isotonic fit, at most.
EXAMPLES = 2_048
CALIBRATION = 8_192
# The weight of a term that tells nothing, and the chi-square at which a term has about half the full weight.
LEAST_WEIGHT = 0.02
HALF_CHI = 24.0
BLOCK = 64
# Blocks visited first.
VISITED = 8
# A term that one in so many examples has is common; texts whose common terms are looked at together.
COMMON = 16
TOGETHER = 64
NEIGHBOURS = 15
# A neighbour's worth of prior votes.
PRIOR_WEIGHT = 0.2


class Index(NamedTuple):
    terms: np.ndarray  # sorted word hashes
    value: np.ndarray  # weight of one occurrence of a term
    strange: float  # and of a word that no example has
    row: np.ndarray  # of a common term in ``dense``, -1 of any other
    dense: np.ndarray  # weights of common terms in all examples
    entries: np.ndarray  # first entry of every term, an entry being a block of its posting list
    block: np.ndarray  # of every entry
    peak: np.ndarray  # largest weight in it
    postings: np.ndarray  # first posting of every entry
    example: np.ndarray  # of every posting
    weight: np.ndarray
    ids: list
    turn: np.ndarray  # places of the examples in order of their ids
    labels: np.ndarray
    votes: np.ndarray  # weight of an example's vote
    share: float  # of toxic rows
    steps: np.ndarray  # isotonic map: votes
    levels: np.ndarray  # and probabilities


def word_counts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes in order, occurrences) of every text."""
    for part in chunks(texts):
        words = words_of(part, NOT_ALPHANUMERIC, True)
        order = np.lexsort((words.hash, words.text))
        text, value = words.text[order], words.hash[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
        begin = np.flatnonzero(new)
        counts = np.diff(np.append(begin, len(order)))
        edges = np.searchsorted(text[begin], np.arange(len(part) + 1))
        for k in range(len(part)):
            own = slice(edges[k], edges[k + 1])
            yield value[begin[own]], counts[own]


def vector(terms: np.ndarray, value: np.ndarray, strange: float, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, weights) of a text, scaled to the norm of all its words."""
    place = np.minimum(np.searchsorted(terms, words), max(0, len(terms) - 1))
    known = terms[place] == words if len(terms) else np.zeros(len(words), dtype=bool)
    often = 1 + np.log(counts)
    weight = often[known] * value[place[known]]
    norm = np.sqrt((weight**2).sum() + strange**2 * (often[~known] ** 2).sum())
    return place[known], weight / norm if norm else weight


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1, end to end."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


def common_parts(index: Index, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """What the common terms of some queries add to the similarity of every example: one matrix product."""
    asked = np.zeros((len(queries), len(index.dense)))
    for k, (term, query) in enumerate(queries):
        row = index.row[term]
        asked[k, row[row >= 0]] = query[row >= 0]
    return asked @ index.dense


def nearest(index: Index, term: np.ndarray, query: np.ndarray, k: int = NEIGHBOURS, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(examples, similarities) of the ``k`` nearest examples with a positive similarity, nearest first.

    ``part`` is the query's row of :func:`common_parts`.
    """
    found, values = np.zeros(0, dtype=np.int64), np.zeros(0)
    if not len(term) or not len(index.labels):
        return found, values
    part = common_parts(index, [(term, query)])[0] if part is None else part
    rare = index.row[term] < 0
    term, query = term[rare], query[rare]
    sizes = index.entries[term + 1] - index.entries[term]
    entry, strength = _spans(index.entries[term], sizes), np.repeat(query, sizes)
    block, blocks = index.block[entry], len(part) // BLOCK
    bounds = part.reshape(blocks, BLOCK).max(axis=1) + np.bincount(block, weights=strength * index.peak[entry], minlength=blocks)
    # First the blocks of the highest bounds; then, in one go, all that can still hold one of the nearest.
    first = np.zeros(blocks, dtype=bool)
    first[np.argsort(-bounds, kind="stable")[:VISITED]] = True
    for visited in (first, ~first):
        worst = values[k - 1] if len(values) >= k else 0.0
        visited &= (bounds > 0) & (bounds >= worst - 1e-12)
        if not visited.any():
            continue
        here = visited[block]
        own = entry[here]
        many = index.postings[own + 1] - index.postings[own]
        at = _spans(index.postings[own], many)
        near = part + np.bincount(index.example[at], weights=np.repeat(strength[here], many) * index.weight[at], minlength=len(part))
        keep = np.flatnonzero(np.repeat(visited, BLOCK) & (near > 0) & (near >= worst - 1e-12))
        if len(keep) > 4 * k:
            keep = keep[near[keep] >= np.partition(near[keep], -k)[-k] - 1e-12]
        found, values = np.concatenate([found, keep]), np.concatenate([values, near[keep]])
        best = np.lexsort((index.turn[found], -values))[:k]
        found, values = found[best], values[best]
    return found, values


def all_nearest(index: Index, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`nearest` of every text, the common terms of some texts at a time."""
    vectors: list[tuple[np.ndarray, np.ndarray]] = []

    def some() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts = common_parts(index, vectors)
        for own, part in zip(vectors, parts, strict=True):
            yield nearest(index, *own, part=part)
        vectors.clear()

    for one in word_counts(texts):
        vectors.append(vector(index.terms, index.value, index.strange, *one))
        if len(vectors) == TOGETHER:
            yield from some()
    yield from some()


def _vote(index: Index, found: np.ndarray, values: np.ndarray) -> float:
    weight = values * index.votes[found]
    return float(((weight * index.labels[found]).sum() + PRIOR_WEIGHT * index.share) / (weight.sum() + PRIOR_WEIGHT))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of ``y`` on ``x``, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, size, lowest x, highest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    steps = [edge for pool in pools for edge in (pool[2], pool[3])]
    return np.array(steps), np.repeat([(s + 0.5 * 0.1) / (n + 0.1) for s, n, *_ in pools], 2)


def _chosen(labels: DataFrame, allowed: Column, examples: int, calibration: int) -> DataFrame:
    """Ids of examples and of rows for the isotonic fit (role 'fit'): a quarter of the allowed ids is for the fit."""
    one = labels.filter(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("role")), F.lit(4)) == 0
    parts = [sample_of(one.filter(~apart & (F.col("label") == value)), examples).withColumn("role", F.lit("example")) for value in (0, 1)]
    return parts[0].unionByName(parts[1]).unionByName(sample_of(one.filter(apart), calibration).withColumn("role", F.lit("fit")))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, label) for every different word of each text."""
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), dtype=np.int32)
        at = 0
        for part in chunks(texts_of(batch.column(0))):
            words = words_of(part, NOT_ALPHANUMERIC, True)
            pairs = np.unique(np.stack([words.text.astype(np.uint64), words.hash], axis=1), axis=0)
            owner = pairs[:, 0].astype(np.int64) + at
            at += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64)), pa.array(labels[owner])], ["term", "label"])


def term_chances(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, chi-square) of all terms of the examples."""
    sizes = {row["label"]: row["n"] for row in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counted = (
        examples.select("text", "label")
        .mapInArrow(_terms_of, "term long, label int")
        .groupBy("term")
        .agg(F.sum(F.col("label")).cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
        .toArrow()
    )
    term = counted.column("term").to_numpy().astype(np.int64).view(np.uint64)
    a, b = counted.column("a").to_numpy(), counted.column("b").to_numpy()
    total = float(n0 + n1)
    chi = np.zeros(len(term))
    if n0 and n1:
        chi = total * (a * (n0 - b) - b * (n1 - a)) ** 2 / (float(n0) * n1 * (a + b) * np.maximum(total - a - b, 1.0))
    order = np.argsort(term)
    return term[order], chi[order]


def document_frequencies(docs: DataFrame, terms: np.ndarray, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        counts = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            for part in chunks(texts_of(batch.column(0))):
                words = words_of(part, NOT_ALPHANUMERIC, True)
                place = np.minimum(np.searchsorted(known, words.hash), max(0, len(known) - 1))
                hit = known[place] == words.hash if len(known) else np.zeros(len(words.hash), dtype=bool)
                pairs = np.unique(words.text[hit] * np.int64(max(1, len(known))) + place[hit])
                counts[:-1] += np.bincount(pairs % max(1, len(known)), minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "n"])

    found = docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, dtype=np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _vectors(rows: DataFrame, terms: np.ndarray, value: np.ndarray, strange: float) -> list[tuple]:
    """(doc_id, label, term numbers, weights) of the examples, in order of their ids."""
    sent = rows.sparkSession.sparkContext.broadcast((terms, value, strange))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [vector(*sent.value, words, counts) for words, counts in word_counts(texts_of(batch.column(0)))]
            arrays = [pa.array([p[k].astype(t).tobytes() for p in pairs], pa.binary()) for k, t in ((0, "<i4"), (1, "<f8"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *arrays], ["doc_id", "label", "term", "weight"])

    made = rows.select("text", "doc_id", "label").mapInArrow(run, f"doc_id {kind}, label int, term binary, weight binary").toArrow()
    packed = sorted(zip(*[made.column(c).to_pylist() for c in made.column_names], strict=True))
    return [(i, y, np.frombuffer(t, dtype="<i4"), np.frombuffer(w, dtype="<f8")) for i, y, t, w in packed]


def _votes(rows: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(vote, label) of the rows of the isotonic fit."""
    held = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [_vote(held.value, *one) for one in all_nearest(held.value, texts_of(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(1)], ["vote", "label"])

    found = rows.select("text", "label").mapInArrow(run, "vote double, label int").toArrow()
    return found.column("vote").to_numpy(), found.column("label").to_numpy().astype(float)


def inverted(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> dict[str, np.ndarray]:
    """The examples' vectors by term: common terms as a matrix, the others as posting lists cut into blocks of examples."""
    term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
    weight = np.concatenate([w for _, w in vectors]) if vectors else np.zeros(0)
    example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
    # At most ``COMMON`` times the mean number of terms of an example are common.
    common = np.flatnonzero(np.bincount(term, minlength=terms) * COMMON >= max(1, len(vectors)))
    row = np.full(terms, -1, dtype=np.int32)
    row[common] = np.arange(len(common))
    dense = np.zeros((len(common), -(-len(vectors) // BLOCK) * BLOCK))
    own = row[term] >= 0
    dense[row[term[own]], example[own]] = weight[own]
    term, weight, example = term[~own], weight[~own], example[~own]
    order = np.lexsort((example, term))
    term, weight, example = term[order], weight[order], example[order]
    block = example // BLOCK
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    return {
        "row": row,
        "dense": dense,
        "entries": np.searchsorted(term[first], np.arange(terms + 1)),
        "block": block[first],
        "peak": np.maximum.reduceat(weight, first) if len(first) else np.zeros(0),
        "postings": np.append(first, len(term)),
        "example": example.astype(np.int32),
        "weight": weight,
    }


def build(docs: DataFrame, labels: DataFrame, allowed: Column, examples: int = EXAMPLES, calibration: int = CALIBRATION) -> Index:
    """The index, from labels of rows that are ``allowed``.  What reaches the driver are the terms and vectors of the chosen rows."""
    chosen = F.broadcast(_chosen(labels, allowed, examples, calibration))
    rows = stored(docs.select("doc_id", "text").join(chosen, "doc_id"), "labelled-texts")
    terms, chi = term_chances(rows.filter("role = 'example'"))
    frequency, n = document_frequencies(docs, terms)
    value = (np.log((1 + n) / (1 + frequency)) + 1) * (LEAST_WEIGHT + chi / (chi + HALF_CHI))
    strange = (np.log((1 + n) / 2) + 1) * LEAST_WEIGHT
    kept = _vectors(rows.filter("role = 'example'"), terms, value, strange)
    y = np.array([label for _, label, _, _ in kept], dtype=float)
    fits = rows.filter("role = 'fit'").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    share = float(fits["share"]) if fits["n"] else float(y.mean()) if len(y) else 0.0
    # Examples of one class and one most frequent word, as a rule of one language, stand together, so that the bounds of most
    # blocks are low for other texts.
    often = np.array([t[np.argmax(w / value[t])] if len(t) else -1 for _, _, t, w in kept], dtype=np.int64)
    order = np.lexsort((often, -y))
    kept, y = [kept[i] for i in order], y[order]
    toxic = y.mean() if len(y) else 0.0
    votes = np.where(y == 1, share / max(toxic, 1e-9), (1 - share) / max(1 - toxic, 1e-9))
    plain = np.array([0.0, 1.0])
    index = Index(
        terms, value, strange, **inverted([(t, w) for _, _, t, w in kept], len(terms)), ids=[i for i, _, _, _ in kept], turn=order,
        labels=y, votes=votes, share=share, steps=plain, levels=plain,
    )
    if fits["n"] and terms.size:
        steps, levels = isotonic(*_votes(rows.filter("role = 'fit'"), index))
        index = index._replace(steps=steps, levels=levels)
    return index


def _judge(index: Index, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple]]]:
    """Calibrated scores of texts, and their three nearest examples as (id, similarity, label)."""
    votes, proofs = [], []
    for found, values in all_nearest(index, texts):
        votes.append(_vote(index, found, values))
        near = zip([index.ids[i] for i in found[:3].tolist()], values[:3].tolist(), index.labels[found[:3]].tolist(), strict=True)
        proofs.append([{"doc_id": i, "similarity": v, "label": int(y)} for i, v, y in near])
    return np.interp(np.array(votes), index.steps, index.levels), proofs


def scored(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence): the calibrated probability, and the nearest examples with similarity and label.

    The index is broadcast; it holds the texts of at most 2 * ``EXAMPLES`` labelled rows, word by word.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType
    evidence = pa.list_(pa.struct([("doc_id", to_arrow_type(kind)), ("similarity", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, proofs = _judge(held.value, texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(proofs, evidence)], ["id", "score", "evidence"])

    name = kind.simpleString()
    schema = f"id {name}, score double, evidence array<struct<doc_id:{name},similarity:double,label:int>>"
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def below(docs: DataFrame, index: Index, toxic_from: float, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score is below ``toxic_from``."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = _judge(held.value, texts_of(batch.column(at)))
            yield batch.filter(pa.array(scores < toxic_from))

    return docs.mapInArrow(run, docs.schema)


def allowed_labels(folds: int = 4, held_out: int = 2) -> Column:
    """Label rows that may be learnt from."""
    return fold_of("doc_id", folds) != held_out
