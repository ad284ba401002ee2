"""Byte-level BPE encoding and decoding with a sentencepiece model written straight from a rank file.

Every token of the rank file becomes a piece: its bytes mapped one to one to printable characters, its score the
negative rank, so sentencepiece merges in rank order.  Normalisation is the identity.  A text is cut by the
vocabulary's pattern first, and each match is encoded on its own.  Token ids are the ranks.

Defined cases: a NULL text is the empty text, which has no tokens; lone pieces of any length are encoded whole;
repeated rows give repeated results; columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Pre-tokens remembered per worker process; beyond that the memory is emptied and refilled.
REMEMBERED = 300_000
# Texts whose new pre-tokens are encoded together.
GROUP = 64

# White space as Unicode defines it (fixed values); ``\s`` of some libraries also takes U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0  -     　"
# Letters and numbers newer than the Unicode version of the tokenizer library (fixed values).
NEWER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
# Texts of Latin letters only, up to this code point, are cut by the plain ``re`` module, which is twice as fast.
LATIN = 0x250


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def byte_letters() -> list[str]:
    """A printable, non-space character for each of the 256 bytes."""
    return [chr(b) if 0x21 <= b <= 0x7E else chr(0x100 + b) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose id for a token is its rank; the unknown piece comes after the last."""
    letters = byte_letters()
    pieces = [
        _field(1, _field(1, "".join([letters[b] for b in token])) + _field(2, float(-rank)) + _field(3, 1))
        for rank, token in enumerate(tokens)
    ]
    unknown = _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(2, _field(3, 2) + _field(40, len(tokens)))  # model type BPE, id of the unknown piece
    plain = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no prefix, nothing removed or escaped
    return b"".join(pieces) + unknown + trainer + _field(3, plain)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that cuts a text into pre-tokens, with the pattern's classes spelled out exactly."""

    def spelled(letter: str, number: str, neither: str, white: str) -> str:
        classes = (
            (r"[^\s\p{L}\p{N}]", neither),
            (r"\p{L}", letter),
            (r"\p{N}", number),
            (r"\S", f"[^{white}]"),
            (r"\s", f"[{white}]"),
        )
        out = pattern
        for name, value in classes:
            out = out.replace(name, value)
        return out

    any_script = regex.compile(
        spelled(
            rf"[\p{{L}}--[{NEWER}]]", rf"[\p{{N}}--[{NEWER}]]", rf"[[^{WHITE}\p{{L}}\p{{N}}]||[{NEWER}]]", WHITE
        ),
        regex.V1,
    ).findall
    own = {
        kind: "".join([re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind])
        for kind in "LN"
    }
    white = WHITE[: WHITE.index(r" ")]
    latin = re.compile(spelled(f"[{own['L']}]", f"[{own['N']}]", f"[^{white}{own['L']}{own['N']}]", white)).findall
    beyond = re.compile(rf"[^\x00-\u{LATIN - 1:04x}]").search
    return lambda text: any_script(text) if beyond(text) else latin(text)


class Codec(dict):
    """Encoder and decoder of one task; as a dict it maps a pre-token to its ids, packed as little-endian uint32."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        import sentencepiece

        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = tokens
        self.split = splitter(pattern)
        self.letters = byte_letters()

    def learn(self, pieces: set[str]) -> None:
        """Encode pre-tokens that are not known yet."""
        if len(self) + len(pieces) > REMEMBERED:
            self.clear()
        new = [piece for piece in pieces if piece not in self]
        mapped = ["".join([self.letters[b] for b in piece.encode()]) for piece in new]
        for piece, ids in zip(new, self.processor.encode(mapped, out_type=int, num_threads=1), strict=True):
            self[piece] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text, packed."""
        cut = [self.split(text) for text in texts]
        self.learn(set().union(*cut))
        return [b"".join(map(self.__getitem__, pieces)) for pieces in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(vocabulary, pattern: str) -> Codec:
    """The codec of this worker process; tasks that follow one another share what it has learnt."""
    model, tokens = vocabulary.value
    key = (sha256(model).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, tokens, pattern)
    return _codecs[key]


def _vocabulary(spark, path: str):
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast((model_bytes(tokens), tokens))


def _each(df: DataFrame, id_col: str, value_col: str, schema: str, work) -> DataFrame:
    """``work`` maps a list of values to a list of result tuples; small groups of rows keep memory bounded."""
    names = ["id", *[part.split()[0] for part in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = work()
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                columns = zip(*done(part.column(1).to_pylist()), strict=True)
                arrays = [pa.array(values) for values in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, value_col).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text, as little-endian uint32.

    The vocabulary is broadcast: a rank file of 50 thousand tokens is about a megabyte, however large ``docs`` is.
    """
    vocabulary = _vocabulary(docs.sparkSession, path)

    def work():
        codec = _codec(vocabulary, pattern)
        return lambda texts: [(ids,) for ids in codec.encode([text or "" for text in texts])]

    return _each(docs, id_col, text_col, "ids binary", work)


def decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes): the text that packed ids stand for."""
    vocabulary = _vocabulary(ids.sparkSession, path)

    def work():
        codec = _codec(vocabulary, pattern)
        return lambda packed: [(codec.decode(ids or b""),) for ids in packed]

    return _each(ids, id_col, "ids", "bytes binary", work)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, ids) of every text: encoded, then decoded from the ids, in one pass."""
    vocabulary = _vocabulary(docs.sparkSession, path)

    def work():
        codec = _codec(vocabulary, pattern)
        return lambda texts: [
            (len(ids) // 4, sha256(ids).hexdigest(), sha256(codec.decode(ids)).hexdigest(), ids)
            for ids in codec.encode([text or "" for text in texts])
        ]

    return _each(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary", work)
