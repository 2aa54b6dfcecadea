"""Byte-level BPE over a rank file, run by a sentencepiece model that is written here and never trained.

The rank file lists byte strings in merge order. Every byte is mapped to one printable character, each
ranked string becomes a piece scored by its negated rank, and the resulting BPE model normalises nothing.
Texts are cut into pre-tokens first; each is encoded on its own, and ids decode by the inverse mapping.

Null texts count as empty: no ids, no bytes. Repeated rows keep their own results; other columns are kept.
"""

from __future__ import annotations

import base64
import struct
from array import array

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType

from .arrow import fields, map_columns

#: Distinct pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 200_000
#: Characters of the alphabet that stands for bytes: one for each, none of them white space.
ALPHABET = [chr(0x100 + b) for b in range(256)]
TO_ALPHABET = dict(enumerate(ALPHABET))


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file by rank. Ranks must run from 0 without a gap."""
    found = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                piece, rank = line.split()
                found[int(rank)] = base64.b64decode(piece)
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks are not consecutive")
    return [found[i] for i in range(len(found))]


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, kind: int, payload: bytes) -> bytes:
    return varint(number << 3 | kind) + (varint(len(payload)) if kind == 2 else b"") + payload


def model_bytes(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the pieces in rank order, then the unknown piece that the format asks for."""
    out = []
    for rank, piece in enumerate(vocabulary):
        text = "".join(ALPHABET[b] for b in piece).encode()
        out.append(field(1, 2, field(1, 2, text) + field(2, 5, struct.pack("<f", -float(rank))) + field(3, 0, varint(1))))
    out.append(field(1, 2, field(1, 2, b"<unk>") + field(2, 5, struct.pack("<f", 0.0)) + field(3, 0, varint(2))))
    trainer = field(3, 0, varint(2)) + field(40, 0, varint(len(vocabulary)))
    normal = field(1, 2, b"identity") + b"".join(field(k, 0, varint(0)) for k in (3, 4, 5))
    return b"".join(out) + field(2, 2, trainer) + field(3, 2, normal)


class Encoder:
    """One for each worker."""

    def __init__(self, path: str, pattern: str):
        vocabulary = read_ranks(path)
        self.whole = {piece: rank for rank, piece in enumerate(vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(vocabulary))
        self.pattern = regex.compile(pattern)
        #: Pre-token -> its ids, four bytes each, so that a text's ids are these bytes joined.
        self.known: dict[str, bytes] = {}

    def learn(self, tokens: list[str]) -> None:
        raw = [t.encode() for t in tokens]
        mapped = [b.decode("latin-1").translate(TO_ALPHABET) for b in raw]
        for token, data, ids in zip(tokens, raw, self.model.encode(mapped, num_threads=1), strict=True):
            # A ranked string stands for itself even where no merge leads to it.
            exact = self.whole.get(data)
            self.known[token] = array("i", ids if exact is None else [exact]).tobytes()

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        out = []
        for text in texts:
            tokens = self.pattern.findall(text or "")
            distinct = set(tokens)
            if missing := distinct.difference(self.known):
                if len(self.known) + len(missing) > REMEMBERED:
                    self.known.clear()
                    missing = distinct
                missing = list(missing)
                for at in range(0, len(missing), 10_000):
                    self.learn(missing[at : at + 10_000])
            out.append(b"".join(map(self.known.__getitem__, tokens)))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text])[0], np.int32).tolist()


class Decoder:
    def __init__(self, path: str):
        self.vocabulary = read_ranks(path)

    def decode(self, ids: list[int] | None) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids or ()))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column. ``path`` is the rank file, which every executor must have there."""

    def f(encoder: Encoder, texts: pa.Array) -> list[pa.Array]:
        packed = encoder.packed(texts.to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))]

    return map_columns(df, [text], fields(**{ids: ArrayType(IntegerType(), False)}), f, lambda: Encoder(path, pattern), arrow_out=True)


def encode_checked(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", same: str = "round_trips") -> DataFrame:
    """Adds the token ids, and whether they decode to the text's bytes; both in one pass."""

    def f(codec: tuple[Encoder, Decoder], texts: pa.Array) -> list[pa.Array]:
        values = texts.to_pylist()
        packed = codec[0].packed(values)
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
        equal = [codec[1].decode(np.frombuffer(p, np.int32).tolist()) == (x or "").encode() for p, x in zip(packed, values, strict=True)]
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))), pa.array(equal)]

    made = fields(**{ids: ArrayType(IntegerType(), False), same: BooleanType()})
    return map_columns(df, [text], made, f, lambda: (Encoder(path, pattern), Decoder(path)), arrow_out=True)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that a column of token ids stands for; null for null."""

    def f(decoder: Decoder, rows: pa.Array) -> list[pa.Array]:
        ends, flat = rows.offsets.to_pylist(), rows.values
        made = [decoder.decode(flat.slice(a, b - a).to_numpy().tolist()) for a, b in zip(ends, ends[1:], strict=False)]
        return [pa.array(made, pa.binary(), mask=rows.is_null().to_numpy(zero_copy_only=False) if rows.null_count else None)]

    return map_columns(df, [ids], fields(**{out: BinaryType()}), f, lambda: Decoder(path), arrow_out=True)


def with_digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replaces ids and decoded bytes by their count and digests."""
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return df.select(
        *[c for c in df.columns if c not in (ids, decoded)],
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
