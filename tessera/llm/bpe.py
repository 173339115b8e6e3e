"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Bytes map to printable characters by the usual byte table, merges run in the library, and decoding reverses the table.
A text is cut at spaces and around line ends where the split pattern cuts too, and the ids of each piece are remembered,
so a word is merged once a worker and not once an occurrence. A cut before a space, and cuts before and after a line
end, are safe where no other white space is next to it; a text with any such cut in doubt is encoded whole.

Memory is bounded: the pieces remembered come in two generations of a fixed number, and Arrow batches have a byte limit.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessera.llm.common import prepare


@lru_cache
def byte_table() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that encodes as a rank file says: of all neighbours, join those whose union has the lowest
    rank. Every way to split a token into two is a merge, in the order of the tokens' ranks."""
    from tokenizers import Regex, Tokenizer
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

    ranks, table = read_ranks(path), byte_table()
    name = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 for i in range(1, len(t)) if t[:i] in name and t[i:] in name]
    out = Tokenizer(BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = Sequence([Split(Regex(pattern), "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


@lru_cache(4)
def from_json(path: str):
    """A tokenizer file; the strings of its special tokens are ordinary text."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


class Encoder:
    """Encodes texts to little-endian uint32 bytes, remembering pieces."""

    def __init__(self, tokenizer, remember: int = 400_000):
        self.tokenizer, self.remember = tokenizer, remember
        self.young: dict[str, bytes | None] = {"": None}  # "": a line end with white space next to it
        self.old: dict[str, bytes | None] = {}
        (self.line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, pieces: set[str]) -> None:
        old, young, todo, ended = self.old, self.young, [], []
        for p in list(pieces):
            if p in old:
                young[p] = old[p]
            elif len(p) > 2 and p[-1] in ".,;:!?" and p[-2].isalpha() and p[-2] < "\u2000":  # the pattern cuts before the mark
                ended.append(p)
                pieces |= {p[:-1], p[-1]}
        for p in pieces.difference(young).difference(ended):
            if p in old:
                young[p] = old[p]
            elif p != "\n" and (p[-1].isspace() or p[0] == " " and p[1].isspace() or p[0] != " " and p[0].isspace()):
                young[p] = None  # white space that may belong to a run
            else:
                todo.append(p)
        plain = [p for p in todo if p[0] == " " and len(p.split()) == 1]
        for at in range(0, len(plain), 1000):  # many at once, line ends between them: these cut, and their id is known
            some = plain[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) != len(some) - 1:
                todo = todo + some  # not as plain as they looked
                continue
            raw, cuts = ids.tobytes(), (4 * ends).tolist()
            for p, i, j in zip(some, [0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True):
                young[p] = raw[i:j]
        todo = [p for p in todo if p not in young]
        for at in range(0, len(todo), 1000):
            some = todo[at : at + 1000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                young[p] = array("I", e.ids).tobytes()
        for p in ended:
            start = young[p[:-1]]
            young[p] = None if start is None else start + young[p[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if "\0" in text or not text:
                out.append(self.whole(text))
                continue
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            if not pieces[0]:
                del pieces[0]
            if not pieces[-1]:
                del pieces[-1]
            if new := set(pieces).difference(self.young):
                if len(self.young) + len(new) > self.remember:
                    self.old, self.young = self.young, {"": None}
                    new = set(pieces).difference(self.young)
                self.learn(new)
            try:
                out.append(b"".join(map(self.young.__getitem__, pieces)))
            except TypeError:
                out.append(self.whole(text))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The worker's encoder for a vocabulary file: a tokenizer file, or with a pattern a rank file."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(from_ranks(path, pattern) if pattern else from_json(path))
    return _encoders[path, pattern]


@lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a rank file."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for t, r in ranks.items():
        out[r] = t
    return out


def decode(ids: bytes | np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes that ids stand for. A character split over tokens is whole again once they are joined."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def char_offsets(text: str, ids: bytes, tokens: list[bytes]) -> list[tuple[int, int]]:
    """The span of code points that each token touches; tokens that split a character share it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
    ends = np.cumsum([len(tokens[i]) for i in np.frombuffer(ids, "<u4")])
    starts = np.concatenate([[0], ends[:-1]]).astype(int) if len(ends) else ends
    return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


def encode_documents(docs: DataFrame, ranks: str, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) and, if asked for, offsets (array of start and end code points).

    Null text: empty; an empty text has no ids. Null or repeated doc_id: each row gives a row. Empty table: empty
    result. Other columns are ignored. The vocabulary file must be at the same path on every worker.
    """
    prepare(docs.sparkSession)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())] + [T.StructField("offsets", span)] * offsets)

    def run(batches):
        enc, tokens = encoder(ranks, pattern), token_bytes(ranks)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = enc.encode(texts)
            cols = [b.column(0), pa.array(ids, pa.binary())]
            if offsets:
                spans = [[{"start": a, "end": z} for a, z in char_offsets(t, i, tokens)] for t, i in zip(texts, ids, strict=True)]
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded with `decoded` (binary) from its `ids`; null ids: null."""
    prepare(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        tokens = token_bytes(ranks)
        for b in batches:
            raw = [None if i is None else decode(i, tokens) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)
