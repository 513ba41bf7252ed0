"""Token ids and token counts of whole texts, by a public byte-level BPE vocabulary.

* ``Encoder.ids``: the ids of a text.  Where the vocabulary has a file of ranks
  beside it, tiktoken encodes (the same vocabulary, four times as fast); what
  may hold a special token's string goes to tokenizers, which knows these.
* ``resync_count``: tokens of a text of any length.  Overlapping chunks are encoded with offsets and
  spliced at a place where both encodings have a token boundary and which is a
  proven stable one (no white space | white space); if an overlap has none, it
  is widened, and if a whole chunk has none, the chunk at least doubles and reaches the next one.
  A text of one chunk needs no splice.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 8192, 256
#: Places where a token boundary can't depend on what stands before it.
STABLE = re.compile(r"(?<=\S)[^\S\x1c-\x1f]")

_loaded: dict[str, Encoder] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary file, found on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text as little-endian bytes, two or four for an id by the vocabulary's size."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # array's, on little-endian machines
        self.ranked, self._sizes = None, None
        if os.path.exists(ranks := vocabulary(name).replace(".json", ".tiktoken")):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    @classmethod
    def of(cls, name: str) -> Encoder:
        """One for a worker process."""
        if name not in _loaded:
            _loaded[name] = cls(name)
        return _loaded[name]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        return self.whole(text) if self.ranked is None or "<|" in text else array(self.code, self.ranked(text)).tobytes()

    def ends(self, text: str) -> np.ndarray:
        """Where each token of a text ends, in UTF-8 bytes."""
        if self._sizes is None:  # a byte-level token's string has a character for each byte; that of an added one is itself
            self._sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab().items():
                self._sizes[i] = len(token)
            for i, token in self.tokenizer.get_added_tokens_decoder().items():
                self._sizes[i] = _size(token.content)
        return np.cumsum(self._sizes[np.frombuffer(self.ids(text), self.dtype)])


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def resync_count(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks.

    Each chunk starts inside the one before it.  The splice is the last stable place in
    the overlap, if both encodings have a token boundary there; tokens before it are taken
    from the left chunk, those after it from the right one.  ``begin``: a place up to which tokens are counted."""
    n, total, begin, left_at, end = len(text), 0, 0, 0, min(len(text), chunk)
    left = encoder.ends(text[:end])
    while end < n:
        width, splice = overlap, None
        while splice is None and width < 2 * (end - begin):
            right_at = max(begin, end - width)
            place = max((m.start() for m in STABLE.finditer(text, right_at + 1, end)), default=None)
            if place is not None:
                right_end = min(n, max(right_at, end - overlap) + chunk)
                right = encoder.ends(text[right_at:right_end])
                if _size(text[left_at:place]) in left and _size(text[right_at:place]) in right:
                    splice = place
            width *= 2
        if splice is None:  # nothing to splice at in the whole chunk: it grows
            ahead = STABLE.search(text, end)
            end = min(n, max(2 * end - left_at, ahead.start() + 1)) if ahead else n
            left = encoder.ends(text[left_at:end])
            continue
        total += int(((left > _size(text[left_at:begin])) & (left <= _size(text[left_at:splice]))).sum())
        begin, left_at, left, end = splice, right_at, right, right_end
    return total + int((left > _size(text[left_at:begin])).sum())


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    Null and empty texts: 0 bytes, 0 tokens.  Repeated ids give a row each, a null id stays
    null; other columns are left out.  Strings of special tokens count as the library
    takes them by default.  One pass without a shuffle; a worker holds one batch of
    texts and the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column("t").to_pylist()]
            n = [resync_count(encoder, t, chunk, overlap) for t in texts]
            sizes = [_size(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["i", "b", "n"])

    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return own.mapInArrow(count, "i long, b long, n long").select(F.col("i").alias(id_col), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
