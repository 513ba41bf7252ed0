"""Language of a text by prediction by partial matching over bytes.

Each language has a tree of byte contexts up to three bytes deep.  A byte seen after its longest context costs
-log2(count / (total + kinds)); one not seen there costs the escape, -log2(kinds / (total + kinds)), and what it costs after
the context one byte shorter; below the empty context all 256 bytes cost the same.  The statistics are frozen, so the cost of
each context with its byte is a constant: costs are worked out once for all that was seen, and a text's code length is a sum of
look-ups.  The shortest code names the language, and the score is its share among 2^-length of all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import held_out

#: Texts of each language that are learned from at most (expected; they are picked by a hash); of all languages together, as long as each keeps so many.
SAMPLE, TOTAL, FEWEST = 1000, 16_000, 20
#: Languages of a model: with more there are several, so that a model's columns stay close to full.  Languages up to which their counts are broadcast (4 MB).
BLOCK, FEW = 8, 100_000
#: Codes that a counting task holds at once.
HELD = 1 << 22
#: Bytes that are scored at once, and texts of a batch.
BUFFER, ROWS = 1 << 19, 128
LEAD = b"   "


@dataclass
class Model:
    """Costs in bits of some languages, a column each; ``gram`` and ``triple`` are sorted codes of four and three bytes, ``context`` of three with the escape from it."""

    languages: list[str]
    gram: np.ndarray
    cost3: np.ndarray
    context: np.ndarray
    escape3: np.ndarray
    triple: np.ndarray
    cost2: np.ndarray
    escape2: np.ndarray
    cost1: np.ndarray


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(codes, return_inverse=True)
    return own, np.bincount(at, counts, len(own))


def build(languages: list[str], grams: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model from each language's codes of four bytes (the last byte lowest) and their counts."""
    width = len(languages)
    gram = np.unique(np.concatenate([g for g, _ in grams])).astype(np.int64)
    triple, context = np.unique(gram & 0xFFFFFF), np.unique(gram >> 8)
    m = Model(languages, gram, np.zeros((len(gram), width), np.float32), context, np.zeros((len(context), width), np.float32), triple, np.zeros((len(triple), width), np.float32), np.zeros((1 << 16, width), np.float32), np.zeros((1 << 16, width), np.float32))

    def order(codes: np.ndarray, counts: np.ndarray, every: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs of ``every`` code, given those one byte shorter; the contexts seen and their escapes."""
        seen, total = _summed(codes >> 8, counts)
        kinds = np.bincount(np.searchsorted(seen, codes >> 8), minlength=len(seen))
        out = -np.log2(kinds / (total + kinds))
        at = np.minimum(np.searchsorted(seen, every >> 8), len(seen) - 1)
        known = seen[at] == every >> 8
        cost = lower + np.where(known, out[at], 0)
        place = np.searchsorted(every, codes)
        mine = np.searchsorted(seen, codes >> 8)
        cost[place] = -np.log2(counts / (total[mine] + kinds[mine]))
        return cost, seen, out

    pairs = np.arange(1 << 16)
    for k, (codes4, counts4) in enumerate(grams):
        codes4 = codes4.astype(np.int64)
        codes3, counts3 = _summed(codes4 & 0xFFFFFF, counts4)
        codes2, counts2 = _summed(codes4 & 0xFFFF, counts4)
        codes1, counts1 = _summed(codes4 & 0xFF, counts4)
        cost0, _, _ = order(codes1, counts1, np.arange(256), np.full(256, 8.0))
        cost1, _, _ = order(codes2, counts2, pairs, cost0[pairs & 0xFF])
        cost2, seen2, out2 = order(codes3, counts3, triple, cost1[triple & 0xFFFF])
        cost3, seen3, out3 = order(codes4, counts4, gram, cost2[np.searchsorted(triple, gram & 0xFFFFFF)])
        m.cost1[:, k], m.cost2[:, k], m.cost3[:, k] = cost1, cost2, cost3
        m.escape2[seen2, k] = out2
        m.escape3[np.searchsorted(context, seen3), k] = out3
    return m


def codes_of(data: bytes) -> np.ndarray:
    """Code of four bytes at each place from the fourth on."""
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def _find(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, codes)
    at[at == len(table)] = 0
    return at, table[at] == codes


def costs(m: Model, codes: np.ndarray) -> np.ndarray:
    """Bits of each place in each language."""
    at, found = _find(m.gram, codes)
    out = m.cost3[at]
    if not found.all():
        new = np.flatnonzero(~found)
        code = codes[new]
        at, seen = _find(m.context, code >> 8)
        extra = np.where(seen[:, None], m.escape3[at], np.float32(0))
        at, seen = _find(m.triple, code & 0xFFFFFF)
        lower = np.where(seen[:, None], m.cost2[at], m.escape2[(code >> 8) & 0xFFFF] + m.cost1[code & 0xFFFF])
        out[new] = extra + lower
    return out


def lengths(m: Model, texts: list[bytes]) -> np.ndarray:
    """Code length of each text in each language; long texts are taken buffer by buffer."""
    total = np.zeros((len(texts), len(m.languages)))
    parts: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        if parts:
            sizes = np.array([len(p) for p in parts])
            codes = codes_of(b"".join(parts))
            ends = np.cumsum(sizes)
            keep = np.ones(len(codes), bool)  # places that reach from one part into the next
            for off in range(3):
                keep[ends[:-1] - 3 + off] = False
            own = costs(m, codes[keep]).astype(np.float64)
            begin = np.concatenate([[0], np.cumsum(sizes - 3)[:-1]])
            np.add.at(total, owners, np.add.reduceat(own, begin, axis=0))
        parts.clear()
        owners.clear()

    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), BUFFER):
            parts.append((text[at - 3 : at] if at else LEAD) + text[at : at + BUFFER])
            owners.append(i)
            held += len(parts[-1])
            if held >= BUFFER:
                flush()
                held = 0
    flush()
    return total


def _letter(text: str) -> bool:
    return any(x[0].isalpha() for x in re.finditer(r"[^\W\d_]", text))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, total: int = TOTAL) -> list[Model]:
    """The trees of every language in ``lang``, in order and in blocks; an empty list without any.

    Each is learned from at most about ``sample`` of its texts that are not held out; with more languages than ``total / sample`` from
    their share of ``total``, but FEWEST at least.  Tasks count, and hold a bounded number of codes; the driver gets one row for each
    language and distinct code of that sample."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where(F.col("lang").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("id")))
    sizes = own.groupBy("lang").count()
    n = sizes.count()
    each = max(FEWEST, min(sample, total // max(n, 1)))
    picked = own.join(F.broadcast(sizes) if n <= FEW else sizes, "lang").where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) * F.col("count") < 1_000_000 * each).select("lang", "t")

    def counted(found: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in found.items():
            codes, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(times.astype(np.int64))], ["lang", "code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strict=True):
                data = LEAD + (text or "").encode("utf-8", "surrogatepass")
                for at in range(0, len(data) - 3, BUFFER):
                    codes = codes_of(data[at : at + BUFFER + 3])
                    found.setdefault(lang, []).append(codes)
                    held += len(codes)
                    if held >= HELD:
                        yield from counted(found)
                        found, held = {}, 0
        yield from counted(found)

    rows = picked.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("code", "ascending")])
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    langs, number = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
    codes, times = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    ends = np.searchsorted(number, np.arange(len(langs) + 1)).tolist()
    spans = list(zip(langs, pairwise(ends), strict=True))
    blocks = [spans[i : i + BLOCK] for i in range(0, len(spans), BLOCK)]
    return [build([x for x, _ in block], [(codes[a:b], times[a:b]) for _, (a, b) in block]) for block in blocks]


def predict(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """Per row: id, held_out, lang_pred, score; with ``whole`` the row itself as a struct (row), lang_pred and score.

    Null texts and texts without a letter: ``und`` with score 0, and so is everything where nothing could be learned.  Ties go to the
    language first in order.  Repeated rows and null ids give a row each; other columns are left out; an empty
    table gives no rows.  The models, bounded by their sample, are broadcast; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        languages = [x for m in blocks for x in m.languages]
        for batch in batches:
            given = batch.column("row").field(text_col) if whole else batch.column("t")
            names, scores = [], []
            for at in range(0, batch.num_rows, ROWS):
                texts = given.slice(at, ROWS).to_pylist()
                known = [bool(languages) and t is not None and _letter(t) for t in texts]
                data = [t.encode("utf-8", "surrogatepass") for t, k in zip(texts, known, strict=True) if k]
                bits = iter(np.concatenate([lengths(m, data) for m in blocks], axis=1) if blocks else ())
                for k in known:
                    if k:
                        own = next(bits)
                        best = int(own.argmin())
                        names.append(languages[best])
                        scores.append(float(1 / np.exp2(own[best] - own).sum()))
                    else:
                        names.append("und")
                        scores.append(0.0)
            found = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            first = "row" if whole else "id"
            yield pa.RecordBatch.from_arrays([batch.column(first), *found], [first, "lang_pred", "score"])

    if whole:
        row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
        return row.mapInArrow(predicted, StructType([row.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(predicted, "id long, lang_pred string, score double")
    return own.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
