"""Packing by concatenate and cut.

First pass: every document becomes its ids and an end id; a task counts on as it goes, so
each row knows its place within its partition.  The rows are written once to the shared folder.
Then the partitions' totals (one number a partition) get exclusive prefix sums.  Second pass: place
= partition's offset + place within it; fixed windows of ``length`` cut the rows, and what crosses a window's
edge becomes two boundary records.  Nothing is shuffled but the totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settled
from .tokens import Encoder

#: Texts of a batch that a worker holds at once.
ROWS = 256


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """Of each document: part, before (ids of the part's rows before it), n, ids (little-endian, two bytes each if the vocabulary allows)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = Encoder.of(tokenizer), 0
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids = [encoder.ids(t or "") + end for t in rows.column("t").to_pylist()]
                n = np.array([len(x) // width for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("id"), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())], ["part", "id", "before", "n", "ids"])
                before += int(n.sum())

    own = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(encode, "part int, id long, before long, n long, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the ids.

    Null and empty texts are packed as the end id alone.  Repeated rows are packed each; a null id stays
    null; other columns are left out; an empty table gives no rows.  A very long text fills several sequences.
    Sequences are full but for the last; padding it is the reader's part."""
    rows = settled(encoded(docs, id_col, text_col, tokenizer, end_id), "packing-ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each input partition of the first pass: as many as its tasks
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("offset"))
    placed = rows.join(F.broadcast(offsets), "part").select("id", (F.col("offset") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("id", pa.int64()), *((x, pa.int64()) for x in ("start", "length", "crc", "n", "seq", "off")), ("ids", pa.binary())]
        for batch in batches:
            out = []
            for doc, at, n, ids in zip(*(batch.column(x).to_pylist() for x in ("id", "at", "n", "ids")), strict=True):
                codes = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                edges = [0, *range(length - at % length, n, length), n]
                out += [(doc, a, b - a, zlib.crc32(codes[a:b]), n, (at + a) // length, (at + a) % length, codes[a:b].tobytes() if with_ids else None) for a, b in pairwise(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], [name for name, _ in kinds])

    pieces = placed.mapInArrow(cut, "id long, start long, length long, crc long, n long, seq long, off long, ids binary")
    names = {"id": id_col, "start": "start", "length": "length", "crc": "ids_crc32", "n": "doc_tokens", "seq": "sequence_id", "off": "offset"} | ({"ids": "ids"} if with_ids else {})
    return pieces.select(*(F.col(a).alias(b) for a, b in names.items()))
