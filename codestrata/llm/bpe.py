"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can be joined by no merge, so the place between the two
is a boundary of the encoding whatever surrounds it. A 256 x 256 table of such pairs, made from the vocabulary alone,
cuts a text into fragments; each is encoded by itself (a repeated one is encoded once), and the ids are concatenated.
Of these places only those are used where the pre-splitting pattern cuts or continues alike on either side: before
white space that follows something else, and between two ASCII letters that do not end a contraction. So the result
is the one of encoding the whole text.

Defined results: null text has null ids, empty text an empty list; a text of any length is encoded whole, also one that is a
single run of white space, letters or marks; rows are
independent, so repeated rows repeat their result; an empty table gives an empty one. Decoding null gives null, and
ids that do not form UTF-8 give U+FFFD in place of the bad bytes; an unknown id is an error.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import list_array, slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-splitting pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_SPACES = b"\t\n\x0b\x0c\r "


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """token -> id, from a file of base64 tokens and ranks, read on the driver."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def boundary_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(256, 256) bool: whether the place between two bytes is a certain cut."""
    inside = np.zeros((256, 256), bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
    space = np.zeros(256, bool)
    space[list(_SPACES)] = True
    letter = np.zeros(256, bool)
    letter[[c for c in range(128) if chr(c).isalpha()]] = True
    inner = np.zeros((256, 256), bool)
    for a in (b"ll", b"ve", b"re"):
        inner[a[0], a[1]] = True
    before_space = ~space[:, None] & space[None, :]
    between = letter[:, None] & letter[None, :] & ~inner
    return ~inside & (before_space | between)


#: White space as the pattern's \\s has it, in UTF-8; runs of ``LONG`` characters and more are split outside the pattern.
_WHITE = rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
LONG = 4096
_RUN = re.compile(_WHITE + rb"{%d,}+" % LONG)
_LAST = re.compile(_WHITE + rb"\Z")


class _Encoded(dict):
    """fragment -> its ids as the bytes of int32, encoded on demand; emptied when it holds ``limit`` bytes.

    Ids are kept as bytes, since lists by the hundred thousand would be walked by every garbage collection. A fragment of
    more than ``LONG`` bytes is encoded each time.
    """

    def __init__(self, bpe, limit: int) -> None:
        super().__init__()
        self.encode, self.piece, self.limit, self.held = bpe.encode_ordinary, bpe._encode_single_piece, limit, 0

    def __missing__(self, piece: bytes) -> bytes:
        if len(piece) > LONG:
            return b"".join(self.parts(piece))
        if self.held >= self.limit:
            self.clear()
            self.held = 0
        self[piece] = ids = array("i", self.encode(piece.decode())).tobytes()
        self.held += len(piece) + len(ids) + 200
        return ids

    def parts(self, data: bytes) -> Iterator[bytes]:
        """As the pattern splits it: of a long run of white space all but the last character is one piece, at the end the whole of it.

        The pattern itself would go back over the run, one call deeper for each character.
        """
        at = 0
        for run in _RUN.finditer(data):
            if run.start() > at:
                yield array("i", self.encode(data[at : run.start()].decode())).tobytes()
            at = run.end() if run.end() == len(data) else run.start() + _LAST.search(run[0][-3:]).start() + max(0, len(run[0]) - 3)
            yield array("i", self.piece(data[run.start() : at])).tobytes()
        if at < len(data):
            yield array("i", self.encode(data[at:].decode())).tobytes()


class Codec:
    """Encodes and decodes with one vocabulary; made once per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, cached: int = 256 << 20) -> None:
        import tiktoken

        bpe = tiktoken.Encoding("fragments", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cuts = boundary_table(ranks)
        self.known = _Encoded(bpe, cached)
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        for i, t in self.tokens.items():
            self.lengths[i] = len(t)

    def fragments(self, data: bytes) -> list[bytes]:
        b = np.frombuffer(data, np.uint8)
        if len(b) < 2:
            return [data] if data else []
        at = np.flatnonzero(self.cuts[b[:-1], b[1:]]) + 1
        # NEL and the other white space beyond ASCII end in these bytes; a cut after them could split a run of white space.
        if len(at) and len(doubtful := at[b[at - 1] >= 128]):
            wide = [i for i in doubtful.tolist() if data[max(0, i - 3) : i].decode("utf-8", "ignore")[-1:].isspace()]
            if wide:
                at = np.setdiff1d(at, wide)
        ends = at.tolist()
        return [data[i:j] for i, j in zip([0, *ends], [*ends, len(data)], strict=True)]

    def encode(self, text: str | bytes) -> np.ndarray:
        data = text.encode() if isinstance(text, str) else text
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.fragments(data))), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, which texts are null)."""
        ids = [self.encode(t or "") for t in texts.to_pylist()]
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return flat, counts, np.asarray(texts.is_null().to_numpy(zero_copy_only=False), bool)


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, decoded_bytes): the ids, and how many UTF-8 bytes they decode to."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts, nulls = codec.encode_batch(part.column(1))
                ends = np.cumsum(counts)
                sizes = np.concatenate([[0], np.cumsum(codec.lengths[flat])])
                size = sizes[ends] - sizes[ends - counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts.astype(np.int32), mask=nulls), list_array(flat, counts, pa.int32(), nulls), pa.array(size, mask=nulls)],
                    ["doc_id", "n_tokens", "tokens", "decoded_bytes"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, decoded_bytes long")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``tokens``."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {i: t for t, i in ranks.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [
                    None if ids is None else b"".join(map(words.__getitem__, ids)).decode("utf-8", "replace")
                    for ids in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, decoded_bytes, decoded, same): the ids, the text decoded from them, whether it is the input.

    A null text has a null text and null for ``same``; ``decoded_bytes`` are counted in what was decoded.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts, nulls = codec.encode_batch(part.column(1))
                ids, ends = flat.tolist(), np.cumsum(counts).tolist()
                raw = [None if null else b"".join(map(codec.tokens.__getitem__, ids[b:e])) for b, e, null in zip([0, *ends], ends, nulls.tolist(), strict=False)]
                texts = [None if r is None else r.decode("utf-8", "replace") for r in raw]
                same = [None if t is None else t == d for t, d in zip(part.column(1).to_pylist(), texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(counts.astype(np.int32), mask=nulls), list_array(flat, counts, pa.int32(), nulls),
                        pa.array([None if r is None else len(r) for r in raw], pa.int64()), pa.array(texts, pa.string()), pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "tokens", "decoded_bytes", "decoded", "same"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens int, tokens array<int>, decoded_bytes long, decoded string, same boolean")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe_encode_decode": op4}
ORACLE_SQL: dict[str, str] = {}
