"""Language identification by compression.

A text is compressed once per language, with a raw-content dictionary of that language's training
text; the language that leaves it smallest is predicted.  Case, digits and marks say little about a
language: texts are compressed as lower-case letters and single spaces, whole, in blocks, so that
the dictionary keeps its weight in long texts.  The margin between the two smallest sizes is
the score; a narrow one is reported as rejected.

Training takes at most `DOCS` slices of at most `SLICE` characters per language, from the documents
with the smallest hashed ids, until the dictionary has `DICT` bytes.  A language costs one dictionary
in every task and one compression per block, so their number is meant to be a few hundred at most.

Defined results: null texts and texts without a letter are `und` with score 0; equal sizes go to the
language first in code point order; a single learned language has score 1; without training rows
every text is `und`; languages that are null are not learned; rows that repeat are predicted each; an
empty table gives an empty result; columns other than id and text are inputs of training only."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOCS, SLICE, DICT = 300, 1024, 96 * 1024
BLOCK = 4096
LEVEL, MATCH = 3, 3
#: margin (share of the second smallest size) under which a prediction counts as rejected
NARROW = 0.01


_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case letters of a text with one space for all between them, in UTF-8."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        docs: int = DOCS, slice_chars: int = SLICE, size: int = DICT) -> dict[str, bytes]:
    """Dictionary of each language: bounded samples of its texts."""
    base = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .filter("id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = base.select("id", "lang").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= docs)
    at = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1).cast("int") + 1
    slices = base.join(F.broadcast(chosen), ["id", "lang"]).select("lang", "rank", F.substr("text", at, F.lit(slice_chars)).alias("part")) \
        .groupBy("lang", "rank").agg(F.max("part").alias("part")).orderBy("lang", "rank")
    found: dict[str, list[bytes]] = {}
    for lang, _, part in slices.collect():
        own, raw = found.setdefault(lang, []), letters(part)
        if raw not in own and sum(map(len, own)) < size:
            own.append(raw)
    return {lang: b"\n".join(parts)[:size] for lang, parts in sorted(found.items())}


def _sizes(text: bytes, packers) -> list[int]:
    blocks = [text[at:at + BLOCK] for at in range(0, len(text), BLOCK)]
    return [sum(len(p.compress(b)) for b in blocks) for p in packers]


def _packer(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MATCH, source_size=BLOCK, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=settings)


def _predict(shared):
    def run(batches):
        langs = list(shared.value)
        packers = [_packer(shared.value[lang]) for lang in langs]
        for batch in batches:
            names, scores, narrow = [], [], []
            for text in batch.column(1):
                raw = (text.as_py() or b"").decode("utf-8", "replace")
                if not langs or not any(map(str.isalpha, raw)):
                    names.append("und"), scores.append(0.0), narrow.append(True)
                    continue
                sizes = _sizes(letters(raw), packers)
                least = min(sizes)
                rest = sorted(sizes)[1] if len(sizes) > 1 else None
                margin = 1.0 if rest is None else (rest - least) / rest
                names.append(langs[sizes.index(least)]), scores.append(margin), narrow.append(margin < NARROW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(narrow, pa.bool_()), *batch.columns[2:]],
                ["doc_id", "lang_pred", "score", "rejected", *batch.schema.names[2:]])
    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, *keep) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(sorted(dictionaries.items())))
    rest = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *keep) \
        .mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double, rejected boolean" + rest)
