"""Token counts of the sections or fields of a document, attributed by offsets.

A document is encoded once and whole. Token spans (in characters, from the bytes of the tokens; a token of a part of a
character has that character) are joined with the section spans of the same document by interval: both are sorted, so
one binary search per boundary finds every pair, inside the task that holds the document and without a shuffle. A token
that crosses a boundary goes whole to the section that holds most of its characters, the earlier one if they hold the
same (``rule="most"``), or to the section of its first character (``rule="first"``). The counts of a document's sections
so add up to its number of tokens.

Sections are sentences, the spans of a column, or fields that are joined to one text. A sentence ends after a full stop,
question or exclamation mark followed by white space, or with its line. The white space after the mark belongs to it,
and line feeds end the section they stand in. What lies between given spans is in rows of section -1.

Defined results: null or empty text has no sections and so no rows; a section that no token is given to has 0; null
ids stay null; repeated rows repeat their result; an empty table gives an empty one; extra columns are not read. Given spans
are taken in order of their begin, cut to the text, and where they overlap the earlier one has the characters; null, empty and
reversed ones have no row; a null list is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Codec, load_ranks
from .common import slices, table


def section_ends(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which the sentences of a text (uint8) end, the last one its length."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    line = data == 10
    blank = (data == 32) | (data == 9) | (data == 13) | line
    mark = (data == 46) | (data == 33) | (data == 63)
    end = line.copy()
    end[1:] |= mark[:-1] & blank[1:] & ~line[1:]
    at = np.flatnonzero(end) + 1
    return at if len(at) and at[-1] == n else np.append(at, n)


def attribute(ends: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many of them cross one of its boundaries.

    ends: section ends, the last one the length of the text; start, stop: the spans of the tokens, in order.
    """
    first = np.searchsorted(ends, start, side="right")
    last = np.searchsorted(ends, stop, side="left")
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        if len(crossing):
            n = last[crossing] - first[crossing] + 1
            begin = np.cumsum(n) - n
            s = np.arange(n.sum()) + np.repeat(first[crossing] - begin, n)
            held = np.minimum(ends[s], np.repeat(stop[crossing], n)) - np.maximum(np.append(0, ends)[s], np.repeat(start[crossing], n))
            most = np.flatnonzero(held == np.repeat(np.maximum.reduceat(held, begin), n))
            of = np.repeat(np.arange(len(crossing)), n)[most]
            owner[crossing] = s[most[np.append(True, of[1:] != of[:-1])]]
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    n = len(ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def token_spans(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each token in characters, from its number of bytes."""
    stop = np.cumsum(lengths)
    if data.isascii():
        return stop - lengths, stop
    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # from 1, of each byte
    return character[stop - lengths] - 1, character[stop - 1]


def spans_of(given: list[dict] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, section or -1) of pieces that fill a text of n characters, from the given spans."""
    known = [(max(0, g["begin"]), min(n, g["end"]), i) for i, g in enumerate(given or []) if g and g["begin"] is not None and g["end"] is not None]
    ends, numbers, at = [], [], 0
    for begin, end, i in sorted(known):
        begin = max(begin, at)
        if begin >= end:
            continue
        if begin > at:
            ends.append(begin)
            numbers.append(-1)
        ends.append(end)
        numbers.append(i)
        at = end
    if at < n:
        ends.append(n)
        numbers.append(-1)
    return np.array(ends, np.int64), np.array(numbers, np.int64)


def section_counts(docs: DataFrame, path: str = VOCABULARY, rule: str = "most", sections: str | None = None) -> DataFrame:
    """(doc_id, section, begin, end, n_tokens, n_crossing): sections from 0, offsets in characters.

    sections: a column of arrays of structs with ``begin`` and ``end``, in characters; sentences without one.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value)
        for batch in batches:
            for part in slices(batch, "text"):
                given = part.column(2).to_pylist() if sections else [None] * part.num_rows
                rows, numbers, ends, tokens, crossing = [], [], [], [], []
                for text, wanted in zip(part.column(1).to_pylist(), given, strict=True):
                    data = (text or "").encode()
                    if not data:
                        rows.append(0)
                        continue
                    if sections:
                        end, number = spans_of(wanted, len(text))
                    else:
                        end = section_ends(np.frombuffer(data, np.uint8))
                        number = np.arange(len(end))
                        if not data.isascii():
                            end = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[end - 1]
                    n, c = attribute(end, *token_spans(data, codec.lengths[codec.encode(data)]), rule)
                    for held, one in ((rows, len(end)), (numbers, number), (ends, end), (tokens, n), (crossing, c)):
                        held.append(one)
                if not ends:
                    continue
                rows = np.array(rows)
                of = np.repeat(np.arange(len(rows)), rows)
                place = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
                number, end = np.concatenate(numbers), np.concatenate(ends)
                begin = np.where(place == 0, 0, np.concatenate([[0], end[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(begin), pa.array(end), pa.array(np.concatenate(tokens).astype(np.int32)), pa.array(np.concatenate(crossing).astype(np.int32))],
                    ["doc_id", "section", "begin", "end", "n_tokens", "n_crossing"],
                )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    if sections:
        columns.append(F.transform(sections, lambda s: F.struct(s["begin"].cast("long").alias("begin"), s["end"].cast("long").alias("end"))).alias("spans"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, section int, begin long, end long, n_tokens int, n_crossing int")


def field_counts(rows: DataFrame, fields: list[str], path: str = VOCABULARY, rule: str = "most", between: str = "\n\n") -> DataFrame:
    """(doc_id, field, n_tokens, n_crossing): the columns ``fields`` are joined to one text, which is encoded once.

    What stands between the fields is in the row whose field is null; a null field is an empty one and has 0.
    """
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    at, spans = F.lit(0), []
    for t in texts:
        spans.append(F.struct(at.alias("begin"), (at + F.char_length(t)).alias("end")))
        at = at + F.char_length(t) + len(between)
    joined = rows.select("doc_id", F.concat_ws(between, *texts).alias("text"), F.array(*spans).alias("spans"))
    found = section_counts(joined, path, rule, "spans")
    names = F.array(*[F.lit(f) for f in fields])
    counted = found.groupBy("doc_id", "section").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sum("n_crossing").cast("int").alias("n_crossing"))
    return counted.select("doc_id", F.when(F.col("section") >= 0, F.get(names, F.col("section"))).alias("field"), "n_tokens", "n_crossing")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6}
ORACLE_SQL: dict[str, str] = {}
