"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary, made of a bounded sample of documents labelled with it. A text is
cut into pieces of ``PIECE`` bytes, since over a longer stretch any compressor learns the language from the text itself;
every piece is compressed with every dictionary, and the sizes are added up. The language of the least sum wins if the
next one is larger by ``MARGIN`` of it at least, else the text is rejected (``lang`` is null).

The labelled sample is bounded by documented parameters: of each language the ``SAMPLE`` documents of least hash among
those of ``SHORT`` characters at most; in that order whole texts go into the dictionary if they still fit into its
``SIZE`` bytes. No text is cut. The driver so receives at most ``SAMPLE`` x ``SHORT`` characters a language, and more
than ``LANGUAGES`` labels are an error. Everything else is taken whole: every text is classified, in all of its pieces.

Defined results: null or blank text is rejected with sizes 0, as is every text while no language is known; equal sums
leave no margin and are rejected; null labels and null ids teach nothing, nor does a language all of whose documents are
longer than ``SHORT``; repeated rows repeat their result, and teach once; null ids stay null; extra columns are not read; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table

SAMPLE, SHORT, SIZE, LANGUAGES = 64, 4000, 32_768, 2000
PIECE = 1024
LEVEL = 5
MARGIN = 0.03


def dictionaries(docs: DataFrame, sample: int = SAMPLE, short: int = SHORT) -> dict[str, bytes]:
    """language -> dictionary content.

    The hashes are chosen first: at most ``sample`` of each of ``LANGUAGES`` languages, so they can be sent to every task.
    """
    if docs.select("lang").distinct().limit(LANGUAGES + 2).count() > LANGUAGES + 1:
        raise ValueError(f"more than {LANGUAGES} languages")
    known = docs.filter(f"lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) <= {int(short)} AND trim(text) <> ''")
    rows = known.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").distinct().withColumn("n", nth).filter(F.col("n") <= sample).drop("n")
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    parts: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for lang, _, text in sorted((r.lang, r.h, r.text) for r in texts.collect()):
        data = text.encode()
        if held.get(lang, 0) + len(data) + 1 <= SIZE:
            parts.setdefault(lang, []).append(data)
            held[lang] = held.get(lang, 0) + len(data) + 1
    return {lang: b"\n".join(p) for lang, p in parts.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes]) -> None:
        import zstandard

        self.languages = sorted(content)
        self.encoders = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=SIZE, source_size=SIZE + PIECE, min_match=4, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            d.precompute_compress(compression_params=p)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def sizes(self, text: str) -> list[int]:
        """Bytes of the text under each language's dictionary."""
        data = text.encode()
        count = max(1, -(-len(data) // PIECE))
        step = -(-len(data) // count)
        pieces = [data[i : i + step] for i in range(0, len(data), step)]
        return [sum(map(len, map(encode, pieces))) for encode in self.encoders]

    def classify(self, text: str | None, margin: float = MARGIN) -> tuple[str | None, str | None, int, int]:
        """(language or None, best guess, its size, the next one's size)."""
        if not text or not text.strip() or not self.encoders:
            return None, None, 0, 0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = order[0]
        second = sizes[order[1]] if len(order) > 1 else len(text.encode())
        sure = second - sizes[best] >= max(1, margin * sizes[best])
        return self.languages[best] if sure else None, self.languages[best], sizes[best], second


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang, guess, size, next_size) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [classifier.classify(t, margin) for t in part.column(1).to_pylist()]
                lang, guess, size, following = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(guess, pa.string()), pa.array(size, pa.int64()), pa.array(following, pa.int64())],
                    ["doc_id", "lang", "guess", "size", "next_size"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang string, guess string, size long, next_size long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, dictionaries(docs))


QUERIES = {"op2_language_id": op2}
ORACLE_SQL: dict[str, str] = {}
