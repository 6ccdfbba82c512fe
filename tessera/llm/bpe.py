"""Byte-level BPE encoding and decoding with the `tokenizers` library over Arrow batches.

Every match of the splitting pattern is encoded on its own, each different one once, and a worker
remembers a bounded number of them; a long text's matches are taken in bounded numbers, never its beginning alone and never cut anywhere. The vocabulary is a public rank file; its merges follow from the ranks (the two parts of a token are
what the lower ranks alone make of it). Every byte is written as one printable character, by the
usual byte table of byte-level BPE, so that `tokenizers` can work on characters; decoding reverses
that table byte by byte and only then reads UTF-8, so characters split over tokens come back whole.

Cases: a null text encodes as the empty text (no ids); a null list of ids decodes to the empty text;
ids outside the vocabulary raise an error; bytes that are no UTF-8 (a cut list of ids) read as U+FFFD
in `text` and stay exact in `bytes`. Repeated rows and null ids of documents give a row each. Columns
other than those named take no part.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from .common import named, parts_of, texts_of

#: Texts of up to so many characters have all their matches taken at once, longer ones as many matches at a time as `MATCHES_AT_ONCE`.
SHORT_CHARS, MATCHES_AT_ONCE = 1 << 16, 1 << 14
#: Matches of the pattern whose ids a worker remembers, and how many new ones are encoded at once.
CACHED_PIECES, ENCODED_AT_ONCE = 150_000, 4096


@functools.cache
def byte_characters() -> tuple[str, ...]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(256, 512))
    return tuple(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def parts_below(ranks: dict[bytes, int], token: bytes) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes `token`, found by merging its bytes with lower ranks only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    limit = ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            raise ValueError(f"the ranks don't make {token!r} of two tokens")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@functools.lru_cache(maxsize=4)
def tokenizer_json(path: str) -> str:
    """The tokenizer of a rank file for one match of the pattern, as the JSON text of the `tokenizers` library (a few MB, by the vocabulary)."""
    ranks, characters = read_ranks(path), byte_characters()
    written = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = [tuple(written[p] for p in parts_below(ranks, t)) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


class Coder:
    """A worker's tokenizer with the ids, and bytes, of what it has met."""

    held: Coder | None = None

    def __init__(self, text_json: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.made_of = hash((text_json, pattern))
        self.tokenizer = Tokenizer.from_str(text_json)
        self.split = regex.compile(pattern)
        self.ids: dict[str, bytes] = {}
        self.offsets: dict[str, np.ndarray] = {}
        self.inside: dict[str, int] = {}
        of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.empty(max(vocabulary.values()) + 1, object)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(of[c] for c in token)

    @classmethod
    def of(cls, text_json: str, pattern: str) -> Coder:
        """The worker's coder, made once."""
        if cls.held is None or cls.held.made_of != hash((text_json, pattern)):
            cls.held = cls(text_json, pattern)
        return cls.held

    def _learn(self, pieces: list[str], offsets: bool = False) -> None:
        """Encode what isn't remembered, each match once."""
        if len(self.ids) > CACHED_PIECES:
            for held in (self.ids, self.offsets, self.inside):
                held.clear()
        new = list(set(pieces).difference(self.offsets if offsets else self.ids))
        for start in range(0, len(new), ENCODED_AT_ONCE):
            part = new[start : start + ENCODED_AT_ONCE]
            for piece, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                places = e.offsets
                self.ids[piece] = np.array(e.ids, np.int32).tobytes()
                self.inside[piece] = sum(a[1] > b[0] for a, b in zip(places, places[1:], strict=False))
                if offsets:
                    self.offsets[piece] = np.array(places, np.int32).reshape(-1, 2)

    def pieces(self, text: str, most: int = SHORT_CHARS) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length; what it doesn't match is left out."""
        if len(text) <= most:
            yield self.split.findall(text)
            return
        matches = self.split.finditer(text)
        while part := [m.group() for m in islice(matches, MATCHES_AT_ONCE)]:
            yield part

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        """Ids of a text, and how many tokens begin inside a character, as the offsets say: those of a split character but its first."""
        found, inside = [], 0
        for part in self.pieces(text):
            self._learn(part)
            found.append(b"".join(map(self.ids.__getitem__, part)))
            inside += sum(map(self.inside.__getitem__, part))
        return np.frombuffer(b"".join(found), np.int32), inside

    def encode_with_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and the first and the last but one character of each."""
        found, spans = [], []
        matches = self.split.finditer(text)
        while part := list(islice(matches, MATCHES_AT_ONCE)):
            pieces = [m.group() for m in part]
            self._learn(pieces, offsets=True)
            found.append(b"".join(map(self.ids.__getitem__, pieces)))
            spans += [self.offsets[m.group()] + m.start() for m in part]
        return np.frombuffer(b"".join(found), np.int32), np.concatenate(spans or [np.zeros((0, 2), np.int32)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(self.bytes[ids].tolist())


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values or [np.zeros(0, np.int32)])))


def _encode(coder: Coder, offsets: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch, "text"):
            texts = texts_of(part.column("text"))
            if offsets:
                both = [coder.encode_with_offsets(t) for t in texts]
                columns = {"ids": _lists([ids for ids, _ in both]), "starts": _lists([s[:, 0] for _, s in both]), "ends": _lists([s[:, 1] for _, s in both])}
            else:
                both = [coder.encode(t) for t in texts]
                columns = {"ids": _lists([ids for ids, _ in both]), "n_inside": pa.array([n for _, n in both], pa.int64())}
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns.values()], names=["doc_id", *columns])


def _decode(coder: Coder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        decoded = pa.array([coder.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        rest = [c for c in batch.schema.names if c not in ("doc_id", "ids")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded, *map(batch.column, rest)], names=["doc_id", "ids", "bytes", *rest])


def _sent(df: DataFrame, vocabulary: str, pattern: str):
    """What makes the coder on an executor: the tokenizer is a broadcast whose size the vocabulary bounds."""
    text_json = df.sparkSession.sparkContext.broadcast(tokenizer_json(vocabulary))
    return lambda: Coder.of(text_json.value, pattern)


def encode(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """`doc_id, ids, n_inside` of every whole text, the last how many tokens begin inside a character; with `offsets` instead `starts, ends`, the characters each token covers.

    Every match of the pattern is encoded on its own. A token that holds some bytes of a character
    covers that whole character.
    """
    rows, coder = named(df, doc_id=id_col, text=text_col), _sent(df, vocabulary, pattern)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else ", n_inside bigint")
    return rows.mapInArrow(lambda batches: _encode(coder(), offsets, batches), schema)


def _decoded_schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, bytes binary"


def decode(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`doc_id, ids, bytes, text` of lists of ids: exact bytes, and their text with U+FFFD for what is no UTF-8."""
    rows, coder = named(df, doc_id=id_col, ids=ids_col), _sent(df, vocabulary, pattern)
    found = rows.mapInArrow(lambda batches: _decode(coder(), batches), _decoded_schema(rows))
    return found.withColumn("text", F.make_valid_utf8(F.col("bytes").cast("string")))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, ids, bytes, n_inside` of every whole text, encoded and decoded again in one pass over its batches."""
    rows, coder = named(df, doc_id=id_col, text=text_col), _sent(df, vocabulary, pattern)
    return rows.mapInArrow(lambda batches: _decode(coder(), _encode(coder(), False, batches)), _decoded_schema(rows) + ", n_inside bigint")
