"""Encoding and decoding of a whole corpus with a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.transducer import VOCABULARY, BpeTransducer, StreamDecoder, read_ranks

_MADE: dict[int, BpeTransducer] = {}


def _transducer(vocabulary: Broadcast) -> BpeTransducer:
    """One transducer per Python worker, kept over tasks with all states it has made."""
    data = vocabulary.value
    key = hash(data)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = BpeTransducer(data)
    return _MADE[key]


def _shared_vocabulary(df: DataFrame, path: str) -> Broadcast:
    # the file of a fixed vocabulary, under 1 MB
    return df.sparkSession.sparkContext.broadcast(read_ranks(path))


def encode_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): ids of every text without special tokens; the empty list for an empty or null text.

    Strings of special tokens in a text are ordinary text. Texts are encoded whole, whatever their length.
    No shuffle; rows are as many as in df, repeated ones included, and other columns are not read.
    """
    shared = _shared_vocabulary(df, vocabulary)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _transducer(shared)
        for batch in batches:
            flat, ends = [], [0]
            for text in batch.column(1).to_pylist():
                flat += make.encode(text)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[doc_id, "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, F.col(text).cast("string")).mapInArrow(encode, f"`{doc_id}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens): 0 for an empty or null text. No text leaves its task."""
    shared = _shared_vocabulary(df, vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _transducer(shared)
        for batch in batches:
            n = pa.array(list(map(make.count, batch.column(1).to_pylist())), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[doc_id, "n_tokens"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, F.col(text).cast("string")).mapInArrow(count, f"`{doc_id}` {kind}, n_tokens bigint")


def decode_ids(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the text of every list of ids, by the streaming decoder; null for a null list."""
    shared = _shared_vocabulary(df, vocabulary)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder(_transducer(shared).tokens)
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[doc_id, "text"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, ids).mapInArrow(decode, f"`{doc_id}` {kind}, text string")
