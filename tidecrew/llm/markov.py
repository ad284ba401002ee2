"""Log probabilities of whole texts under a hidden Markov model of their words.

The words of a text, lower-cased, are followed by one end.  A state emits classes of words: a word with at least one in 2 **
``SHARE`` of all training tokens is a class of its own, so there are at most 2 ** ``SHARE`` of those; all others are classed
by a hash of their last three bytes, and share a state's mass of that class in proportion to their smoothed counts.  With the
base probability p(w) = (c + 0.5) / (N + 0.5 (V + 1)), a state k gives a word p(w) times the ratio P(class | k) / P(class); the ratio of a
word never seen is 1.  That adds up to 1 over all V words and the unknown one, and the score of a text is its base score plus
the logarithm of the forward recursion over ratios.

Counts of words come from one shuffle of partial counts.  Every Baum-Welch round reads the encoded texts of the training
documents once, adds up expected counts per task, then per class and state; only those sums, of bounded size, come back.
Texts are cut into segments that are worked on side by side: the products of a segment's matrices give the exact
messages at its borders, so neither the counts nor the likelihood are those of shorter texts.

Words that are no class of their own are looked up by a join: every block of documents sends its different ones once, and
gets their counts back.

Defined cases: a NULL or empty text is the end alone; a NULL id is learned from; repeated rows count, and are
scored, each; an empty table gives no rows; without any training document all words are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecrew.llm.docstats import texts_of
from tidecrew.llm.pieces import word_lists
from tidecrew.llm.tables import stored
from tidecrew.llm.words import SPACES, mixed

STATES = 8
ROUNDS = 4
SHARE = 18
# Classes of the words that have none of their own.
ENDINGS = 4_096
# Tokens of the prior that pulls a state's classes to the base.
PRIOR = 1_000.0
# Bytes of text in a block, about; tokens worked on at a time; tokens of a segment.
BLOCK = 1 << 24
BATCH = 1 << 18
SEGMENT = 1_024
END = b""


class Block(NamedTuple):
    """Documents with their tokens: positions in ``words``, laid end to end."""

    rows: pa.Table
    tokens: np.ndarray
    lengths: np.ndarray
    words: pa.Array


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[Block]:
    """Runs of documents of about ``size`` bytes; the text is the last column and not part of ``rows``."""
    rows, lengths, coded, held = [], [], [], 0

    def block() -> Block:
        together = pa.chunked_array(coded).unify_dictionaries()
        tokens = np.concatenate([c.indices.to_numpy() for c in together.chunks])
        return Block(pa.Table.from_batches(rows), tokens, np.array(lengths), together.chunk(0).dictionary)

    for batch in batches:
        waiting: list[bytes] = []
        begun = weight = 0
        for at, text in enumerate(texts_of(batch.column(batch.num_columns - 1))):
            n = 1
            for words in word_lists(text, SPACES, True):
                waiting += words
                n += len(words)
                if len(waiting) > BATCH:
                    coded.append(pa.array(waiting, pa.binary()).dictionary_encode())
                    waiting = []
            waiting.append(END)
            lengths.append(n)
            weight += len(text) + 1
            if held + weight >= size:
                rows.append(batch.slice(begun, at + 1 - begun).select(range(batch.num_columns - 1)))
                coded.append(pa.array(waiting, pa.binary()).dictionary_encode())
                yield block()
                rows, lengths, coded, held = [], [], [], 0
                waiting, begun, weight = [], at + 1, 0
        if begun < batch.num_rows:
            rows.append(batch.slice(begun).select(range(batch.num_columns - 1)))
            coded.append(pa.array(waiting, pa.binary()).dictionary_encode())
            held += weight
    if lengths:
        yield block()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c): how often every word is in ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n = np.bincount(block.tokens, minlength=len(block.words))
            found = pa.table({"word": block.words, "n": pa.array(n, pa.int64())})
            yield from found.to_batches(max_chunksize=1 << 16)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def endings(words: pa.Array) -> np.ndarray:
    """The class of every word by its last three bytes."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    last = b"".join(x[-3:].rjust(3, b"\0") for x in words.to_pylist())
    tail = np.frombuffer(last, dtype=np.uint8).reshape(-1, 3).astype(np.uint64)
    key = (tail[:, 0] << np.uint64(16)) | (tail[:, 1] << np.uint64(8)) | tail[:, 2]
    return (mixed(key + (np.minimum(lengths, 3).astype(np.uint64) << np.uint64(24))) % np.uint64(ENDINGS)).astype(np.int64)


class Vocabulary(NamedTuple):
    """Base probabilities: the words that are classes of their own, sorted, and the base mass of every class."""

    words: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    base: np.ndarray

    @property
    def weight(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    @property
    def unknown(self) -> int:
        """The class of words never seen; those of endings are just before it."""
        return len(self.words) + ENDINGS

    def bare(self) -> Vocabulary:
        """The sums alone."""
        return self._replace(words=None, counts=None, base=None)

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / self.weight)


def vocabulary(counts: DataFrame, share: int = SHARE) -> Vocabulary:
    """From ``counts`` (word, c).  The words brought back are at most 2 ** share, the sums one per class."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    own = F.col("c") >= max(1, -(-total >> share))
    found = counts.filter(own).toArrow()
    words, n = pa.array(found.column("word").to_pylist(), pa.binary()), found.column("c").to_numpy()
    order = pc.sort_indices(words).to_numpy()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k = np.zeros(ENDINGS, dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                ending = endings(batch.column(0))
                np.add.at(c, ending, batch.column(1).to_numpy())
                k += np.bincount(ending, minlength=ENDINGS)
        some = np.flatnonzero(k)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(c[some]), pa.array(k[some])], ["ending", "c", "k"])

    rest = counts.filter(~own).mapInArrow(sums, "ending long, c long, k long").groupBy("ending")
    mass = np.zeros(ENDINGS)
    for row in rest.agg(F.sum("c").alias("c"), F.sum("k").alias("k")).collect():
        mass[row["ending"]] = row["c"] + 0.5 * row["k"]
    n = n[order].astype(np.int64)
    base = np.concatenate([n + 0.5, mass, [0.5]]) / (total + 0.5 * (distinct + 1))
    return Vocabulary(words.take(pa.array(order)), n, int(total), int(distinct), base)


def encoded(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """``docs`` (id, learn, text) as classes, in parts of about a block.

    (part, id, learn, n_tokens, n_known, base_score, classes, rare): the counts and the base score are those of words that are
    classes of their own; ``rare`` are the others, as positions in ``words``, which stands in one row of the part, with a
    NULL in ``classes``.
    """
    kind = docs.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((known.words.to_pylist(), known.counts))
    schema = (
        f"part long, id {kind}, learn boolean, n_tokens long, n_known long, base_score double, classes binary, "
        "rare binary, words array<binary>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = pa.array(sent.value[0], pa.binary()), sent.value[1]
        log = known_log(counts)
        part = TaskContext.get().partitionId() << 32
        for block in blocks(batches):
            own = pc.fill_null(pc.index_in(block.words, value_set=words), -1).to_numpy().astype(np.int64)
            others = np.flatnonzero(own < 0)
            rare = np.full(len(own), -1, dtype="<i4")
            rare[others] = np.arange(len(others))
            strange = block.words.take(pa.array(others))
            of = own.copy()
            of[others] = len(words) + endings(strange)
            ends = np.concatenate([[0], np.cumsum(block.lengths)])
            for begin in range(0, len(block.lengths), 1024):
                end = min(begin + 1024, len(block.lengths))
                tokens, lengths = block.tokens[ends[begin] : ends[end]], block.lengths[begin:end]
                rows = np.repeat(np.arange(end - begin), lengths)
                classes, place = of[tokens].astype(wide), rare[tokens]
                common = place < 0
                value = log[own[tokens[common]]]
                cuts = list(zip((ends[begin:end] - ends[begin]).tolist(), (ends[begin + 1 : end + 1] - ends[begin]).tolist(), strict=True))
                columns = [
                    pa.array([part] * (end - begin), pa.int64()),
                    block.rows.column(0).slice(begin, end - begin).combine_chunks(),
                    block.rows.column(1).slice(begin, end - begin).combine_chunks(),
                    pa.array(lengths, pa.int64()),
                    pa.array(np.bincount(rows[common], minlength=end - begin).astype(np.int64)),
                    pa.array(np.bincount(rows[common], weights=value, minlength=end - begin), pa.float64()),
                    pa.array([classes[a:b].tobytes() for a, b in cuts], pa.binary()),
                    pa.array([x[x >= 0].tobytes() for x in (place[a:b] for a, b in cuts)], pa.binary()),
                    pa.array([None] * (end - begin), pa.list_(pa.binary())),
                ]
                yield pa.RecordBatch.from_arrays(columns, COLUMNS)
            head = [pa.array([part]), *[pa.nulls(1, block.rows.column(i).type) for i in (0, 1)], *[pa.nulls(1, t) for t in KINDS]]
            yield pa.RecordBatch.from_arrays([*head, pa.ListArray.from_arrays(pa.array([0, len(strange)], pa.int32()), strange)], COLUMNS)
            part += 1

    known_log, wide = known.bare().log_base, width_of(known.unknown)
    return docs.select("id", "learn", "text").mapInArrow(run, schema)


def width_of(largest: int) -> str:
    """The kind of number that classes are stored as."""
    return "<u2" if largest < 1 << 16 else "<i4"


COLUMNS = ["part", "id", "learn", "n_tokens", "n_known", "base_score", "classes", "rare", "words"]
KINDS = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]


class Model(NamedTuple):
    """Silent first state, moves between states, and the ratio of every class in every state; each token follows a move."""

    start: np.ndarray
    moves: np.ndarray
    ratios: np.ndarray


def first_model(base: np.ndarray, states: int = STATES) -> Model:
    """States that mostly stay, with ratios drawn by hash."""
    n = len(base)
    with np.errstate(over="ignore"):
        draw = mixed(np.arange(1, n * states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(n, states)
    ratios = np.exp(2.0 * (draw.astype(np.float64) / 2.0**64 - 0.5))
    moves = np.full((states, states), 0.02 / max(1, states - 1))
    np.fill_diagonal(moves, 0.98 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), moves, _scaled_to_base(ratios, base))


def _scaled_to_base(ratios: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Every state's classes add up to what the base gives to known words; the unknown word, last, keeps its own."""
    ratios = ratios * ((1.0 - base[-1]) / np.maximum(base[:-1] @ ratios[:-1], 1e-300))
    ratios[-1] = 1.0
    return ratios


class Segments(NamedTuple):
    """Texts cut into segments, longest first; at step t the first ``active[t]`` of them have a token."""

    start: np.ndarray
    length: np.ndarray
    text: np.ndarray
    place: np.ndarray
    active: np.ndarray


def segments_of(lengths: np.ndarray, size: int = SEGMENT) -> Segments:
    pieces = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(lengths) - lengths, pieces) + place * size
    length = np.minimum(size, np.repeat(lengths, pieces) - place * size)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max(initial=0))
    active = len(length) - np.cumsum(np.bincount(length, minlength=longest + 1))[:longest]
    return Segments(start[order], length[order], text[order], place[order], active)


def transfer(model: Model, classes: np.ndarray, cut: Segments, some: np.ndarray) -> np.ndarray:
    """The product of the matrices of each of the segments ``some``, up to a factor."""
    k = len(model.start)
    product, ones = np.broadcast_to(np.eye(k), (len(some), k, k)).copy(), np.ones(k)
    length = cut.length[some]
    for t in range(int(length.max(initial=0))):
        m = int(np.searchsorted(-length, -t, "left"))
        now = (product[:m].reshape(m * k, k) @ model.moves).reshape(m, k, k)
        np.multiply(now, model.ratios.take(classes[cut.start[some[:m]] + t], axis=0)[:, None, :], out=product[:m])
        if t % 8 == 7:
            product[:m] /= (product[:m].reshape(m * k, k) @ ones).reshape(m, k).max(axis=1)[:, None, None]
    return product


def borders(model: Model, classes: np.ndarray, cut: Segments) -> tuple[np.ndarray, np.ndarray]:
    """For every segment, what comes in (scaled to sum 1) and what the rest of the text after it gives (up to a factor)."""
    k = len(model.start)
    ahead, behind = np.tile(model.start, (len(cut.start), 1)), np.ones((len(cut.start), k))
    long_texts = np.unique(cut.text[cut.place > 0])
    some = np.flatnonzero(np.isin(cut.text, long_texts))
    if not len(some):
        return ahead, behind
    product = transfer(model, classes, cut, some)
    text, place = cut.text[some], cut.place[some]
    order = np.lexsort((place, text))
    for a, b in zip(order[:-1], order[1:], strict=True):
        if text[a] == text[b]:
            now = ahead[some[a]] @ product[a]
            ahead[some[b]] = now / now.sum()
    for a, b in zip(order[-2::-1], order[:0:-1], strict=True):
        if text[a] == text[b]:
            now = product[b] @ behind[some[b]]
            behind[some[a]] = now / now.sum()
    return ahead, behind


def likelihoods(model: Model, classes: np.ndarray, lengths: np.ndarray, size: int = SEGMENT) -> np.ndarray:
    """The natural logarithm of the scaled forward recursion over every text."""
    cut = segments_of(lengths, size)
    ahead, _ = borders(model, classes, cut)
    log, ones = np.zeros(len(cut.start)), np.ones(len(model.start))
    for t, m in enumerate(cut.active.tolist()):
        now = ahead[:m] @ model.moves
        now *= model.ratios.take(classes[cut.start[:m] + t], axis=0)
        scale = now @ ones
        np.multiply(now, (1.0 / scale)[:, None], out=ahead[:m])
        log[:m] += np.log(scale)
    return np.bincount(cut.text, weights=log, minlength=len(lengths))


class Expected(NamedTuple):
    """Expected counts: of first states, moves, and classes in states; and the log likelihood they come from."""

    start: np.ndarray
    moves: np.ndarray
    classes: np.ndarray
    log: float


def expected(model: Model, classes: np.ndarray, lengths: np.ndarray, size: int = SEGMENT) -> Expected:
    """One forward and one backward recursion over all texts of a batch."""
    k = len(model.start)
    cut = segments_of(lengths, size)
    ahead, behind = borders(model, classes, cut)
    offsets = np.concatenate([[0], np.cumsum(cut.active)])
    forward, scales, seen = np.empty((offsets[-1], k)), np.empty(offsets[-1]), np.empty(offsets[-1], dtype=np.int64)
    given, now, ones = np.empty((offsets[-1], k)), ahead.copy(), np.ones(k)
    for t, m in enumerate(cut.active.tolist()):
        own = slice(offsets[t], offsets[t] + m)
        seen[own] = classes[cut.start[:m] + t]
        model.ratios.take(seen[own], axis=0, out=given[own], mode="clip")
        np.matmul(now[:m], model.moves, out=forward[own])
        forward[own] *= given[own]
        scales[own] = 1.0 / (forward[own] @ ones)
        forward[own] *= scales[own][:, None]
        now[:m] = forward[own]
    back = behind / (now * behind).sum(axis=1)[:, None]
    share, moves = np.empty_like(forward), np.zeros((k, k))
    given *= scales[:, None]
    for t in range(len(cut.active) - 1, -1, -1):
        m = int(cut.active[t])
        own = slice(offsets[t], offsets[t] + m)
        np.multiply(forward[own], back[:m], out=share[own])
        given[own] *= back[:m]
        moves += (forward[offsets[t - 1] : offsets[t - 1] + m] if t else ahead[:m]).T @ given[own]
        np.matmul(given[own], model.moves.T, out=back[:m])
    first = cut.place == 0
    counts = np.stack([np.bincount(seen, weights=share[:, i], minlength=len(model.ratios)) for i in range(k)], axis=1)
    return Expected((ahead * back)[first].sum(axis=0), moves * model.moves, counts, -float(np.log(scales).sum()))


def improved(base: np.ndarray, counts: Expected) -> Model:
    """The model of the expected counts, smoothed towards the base."""
    start = counts.start + 1.0
    moves = counts.moves + 1.0
    pulled = counts.classes + PRIOR * base[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = np.where(base[:, None] > 0, pulled / base[:, None], 1.0)
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), _scaled_to_base(ratios, base))


def batched(classes: list[bytes], wide: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in runs of about ``BATCH`` tokens: the first one's place, the tokens and the lengths."""
    at, size = 0, np.dtype(wide).itemsize
    while at < len(classes):
        end, held = at, 0
        while end < len(classes) and (held == 0 or held + len(classes[end]) <= size * BATCH):
            held += len(classes[end])
            end += 1
        run = classes[at:end]
        yield at, np.frombuffer(b"".join(run), dtype=wide).astype(np.int32), np.array([len(x) // size for x in run])
        at = end


def expected_counts(texts: DataFrame, model: Model) -> Expected:
    """Expected counts over ``texts`` (classes): added up per task, then per class and state."""
    k, n, wide = len(model.start), len(model.ratios), width_of(len(model.ratios) - 1)
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, classes, log = np.zeros(k), np.zeros((k, k)), np.zeros((n, k)), 0.0
        for batch in batches:
            for _, tokens, lengths in batched(batch.column(0).to_pylist(), wide):
                found = expected(sent.value, tokens, lengths)
                start, moves, classes, log = start + found.start, moves + found.moves, classes + found.classes, log + found.log
        some = np.flatnonzero(classes.any(axis=1))
        keys = np.concatenate([some, n + np.arange(k + 2)])
        values = np.concatenate([classes[some], moves, start[None], np.full((1, k), log / k)])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(values[:, i]) for i in range(k)]], ["key", *[f"s{i}" for i in range(k)]])

    columns = [f"s{i}" for i in range(k)]
    partial = texts.select("classes").mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in columns))
    found = partial.groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    sums = np.zeros((n + k + 2, k))
    sums[found.column("key").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    return Expected(sums[n + k], sums[n : n + k], sums[:n], float(sums[n + k + 1].sum()))


def trained(texts: DataFrame, base: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch rounds over ``texts`` (classes)."""
    model = first_model(base, states)
    for _ in range(rounds):
        model = improved(base, expected_counts(texts, model))
    return model


def scored(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score) of every document, learning from those ``learn`` names."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(True)).alias("learn"), F.col(text_col).alias("text"))
    counts = stored(word_counts(rows.filter("learn").select("text")), "counts")
    known = vocabulary(counts)
    texts = stored(encoded(rows, known), "encoded")
    model = trained(texts.filter("learn").select("classes"), known.base, states, rounds)
    kind = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # Only sums are needed of the vocabulary from here on.
    facts, own, log_base, unknown = known.total, len(known.words), known.bare().log_base, known.unknown
    wide = width_of(unknown)

    words = texts.filter("classes is null").select(F.col("part").alias("of"), F.posexplode("words").alias("place", "word"))
    looked_up = words.join(counts, "word", "left").select("of", "place", F.coalesce("c", F.lit(0)).alias("c"))

    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        c = np.zeros(found.num_rows, dtype=np.int64)
        c[found.column("place").to_numpy()] = found.column("c").to_numpy()
        classes, rare = group.column("classes").to_pylist(), group.column("rare").to_pylist()
        n_known, base = group.column("n_known").to_numpy().copy(), group.column("base_score").to_numpy().copy()
        score = np.empty(len(classes))
        for at, tokens, lengths in batched(classes, wide):
            end = at + len(lengths)
            others = c[np.frombuffer(b"".join(rare[at:end]), dtype="<i4")]
            places = np.flatnonzero(tokens >= own)
            owner = np.repeat(np.arange(len(lengths)), lengths)[places]
            n_known[at:end] += np.bincount(owner[others > 0], minlength=len(lengths))
            base[at:end] += np.bincount(owner, weights=log_base(others), minlength=len(lengths))
            tokens[places[others == 0]] = unknown
            score[at:end] = base[at:end] + likelihoods(sent.value, tokens, lengths) / np.log(10.0)
        out = group.select(["id", "learn", "n_tokens"]).append_column("n_known", pa.array(n_known))
        out = out.append_column("train_tokens", pa.array(np.full(len(classes), facts, dtype=np.int64)))
        return out.append_column("base_score", pa.array(base)).append_column("score", pa.array(score))

    schema = f"id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    whole = texts.filter("classes is not null").drop("words")
    scores = whole.groupBy("part").cogroup(looked_up.groupBy("of")).applyInArrow(run, schema)
    return scores.withColumnRenamed("id", id_col)
