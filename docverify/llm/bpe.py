"""Byte-level BPE by a rank queue: whole texts to ids, and ids to bytes.

A text is cut by the vocabulary's pattern, and each match is merged by itself.  The places
where two tokens could merge wait in buckets, one for each merge rank; three levels (more for
a larger vocabulary) of bitmaps of 64 bits say which buckets hold something, and the lowest
set bit of each level leads to the next rank.  A bucket holds positions of a linked list of
tokens; one whose pair has changed since is stale and skipped.  A match of n bytes thus costs
time in n log n at most and memory in n, however long it is.

The distinct short matches of some texts share one queue and merge bucket by bucket, and what a
match gives is kept for a worker's next texts, up to a bound of entries.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from heapq import heappop, heappush
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import vocabulary

#: Matches of up to SHORT characters are remembered, REMEMBERED of them at most; a text's matches come in lists of MATCHES; CHARS bytes of text are encoded at once; matches of over LONG bytes merge alone.
SHORT, REMEMBERED, MATCHES, CHARS, LONG = 64, 1 << 18, 100_000, 2_000_000, 256
#: Characters that stand for one that the two libraries class differently: a letter, a number, neither.
STAND_INS = {"L": "一", "N": "٠", "": "￾"}


class RankQueue:
    """Buckets by rank; ``first`` is the lowest rank whose bucket isn't empty."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.levels = [[0] * ((max(ranks, 1) + 63) >> 6)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) + 63) >> 6))

    def bucket(self, rank: int) -> list:
        """A rank's bucket, for something to be put in."""
        if found := self.buckets.get(rank):
            return found
        found = self.buckets[rank] = []
        for words in self.levels:
            at = rank >> 6
            before = words[at]
            words[at] = before | 1 << (rank & 63)
            if before:  # the levels above know it
                break
            rank = at
        return found

    def first(self) -> int:
        """-1 if every bucket is empty."""
        at = 0
        for words in reversed(self.levels):
            word = words[at]
            if not word:
                return -1
            at = at << 6 | (word & -word).bit_length() - 1
        return at

    def drained(self, rank: int) -> None:
        """The bucket of a rank is empty now."""
        del self.buckets[rank]
        for words in self.levels:
            at = rank >> 6
            words[at] &= ~(1 << (rank & 63))
            if words[at]:
                return
            rank = at


class Merger:
    """Ids of matches, by a rank for each token's bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a << 32 | b] = rank
        known = sorted(pairs)
        self.keys, self.values = np.array([*known, 1 << 62]), np.array([*(pairs[x] for x in known), -1])

    def paired(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that pairs of ids make, -1 where they make none."""
        keys = a << 32 | b
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)

    def ids(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some matches, none of them empty: the lowest rank merges first, the leftmost of equal ones; a match that is a token itself is that token.

        Short ones share a queue and merge a bucket at once; each long one goes through the queue by itself."""
        out = [np.zeros(0, np.int64)] * len(pieces)
        several = []
        for x, piece in enumerate(pieces):
            if (own := self.ranks.get(piece)) is not None:
                out[x] = np.array([own])
            elif len(piece) > LONG:
                out[x] = self._chained([piece], self._one_by_one)[0]
            else:
                several.append(x)
        for x, got in zip(several, self._chained([pieces[x] for x in several], self._together), strict=True):
            out[x] = got
        return out

    def _chained(self, pieces: list[bytes], merge: Callable) -> list[np.ndarray]:
        """Lays pieces out as linked lists of single bytes, parted by nodes that never merge, and merges them."""
        if not pieces:
            return []
        data = b"\0".join([b"", *pieces, b""])
        codes = np.frombuffer(data, np.uint8)
        edges = np.cumsum([0, *(len(x) + 1 for x in pieces)])
        part = np.zeros(len(data), bool)
        part[edges] = True
        ids = np.where(part, -1, self.single[codes])
        if (ids[~part] < 0).any():
            raise KeyError("the vocabulary lacks a byte of the text")
        rank_at = np.where(part[:-1] | part[1:], -1, self.paired(ids[:-1], ids[1:]))
        merge(data, part, ids, np.append(rank_at, -1))
        kept = np.flatnonzero(ids >= 0)
        cuts = np.searchsorted(kept, edges).tolist()
        ids = ids[kept]
        return [ids[a:b] for a, b in pairwise(cuts)]

    def _put(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Puts places into the buckets of their ranks, an array a bucket; negative ranks have none."""
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        edges = [*np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, len(ranks)]
        for at, end in zip([0, *edges], edges, strict=False):
            if end > at and (rank := int(ranks[at])) >= 0:
                self.queue.bucket(rank).append(places[at:end])

    def _together(self, data: bytes, part: np.ndarray, ids: np.ndarray, rank_at: np.ndarray) -> None:
        """Merges, of each bucket, the leftmost place of every piece at once; its other places wait."""
        queue, piece = self.queue, np.cumsum(part)
        follows, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        self._put(rank_at, np.arange(len(data)))
        while (rank := queue.first()) >= 0:
            i = np.sort(np.concatenate(queue.buckets[rank]))
            i = i[rank_at[i] == rank]  # others are stale: merged away, or part of another pair by now
            own = piece[i]
            head = np.ones(len(i), bool)
            head[1:] = own[1:] != own[:-1]
            queue.buckets[rank][:] = [i[~head]]
            if head.all():
                queue.drained(rank)
            i = i[head]
            j = follows[i]
            k, p = follows[j], before[i]
            ids[i], ids[j], rank_at[j] = rank, -1, -1
            follows[i], before[k] = k, i
            new = np.concatenate([np.where(part[k], -1, self.paired(ids[i], ids[k])), np.where(part[p], -1, self.paired(ids[p], ids[i]))])
            places = np.concatenate([i, p])
            rank_at[places] = new
            self._put(new, places)

    def _one_by_one(self, data: bytes, part: np.ndarray, ids: np.ndarray, rank_at: np.ndarray) -> None:
        """Merges a place at a time; buckets are heaps of places."""
        get, queue = self.ranks.get, self.queue
        n = len(data) - 1
        own, at = array("q", ids.tobytes()), array("q", rank_at.tobytes())
        follows, before = array("q", range(1, n + 2)), array("q", range(-1, n))
        for i, rank in enumerate(at):
            if rank >= 0:
                queue.bucket(rank).append(i)  # ascending, so a heap
        while (rank := queue.first()) >= 0:
            bucket, least = queue.buckets[rank], rank
            while bucket and least == rank:
                i = heappop(bucket)
                if at[i] != rank:  # stale
                    continue
                j = follows[i]
                k, p = follows[j], before[i]
                own[i], own[j], at[j] = rank, -1, -1
                follows[i], before[k] = k, i
                at[i] = new = get(data[i : follows[k]], -1) if k < n else -1
                if new >= 0:
                    heappush(queue.bucket(new), i)
                    least = min(least, new)
                if p:
                    at[p] = new = get(data[p:k], -1)
                    if new >= 0:
                        heappush(queue.bucket(new), p)
                        least = min(least, new)
            if not bucket:
                queue.drained(rank)
        ids[:] = own


def _kinds(pattern: str) -> dict[int, str]:
    """Code points that the pattern's own library takes for a letter, a number or neither otherwise than the one here, with a stand-in of the right kind.

    The two know Unicode in different versions, so only what this Python doesn't know yet can differ; a
    vocabulary of bytes and of pairs that end in ``a`` or ``1`` shows where a code point stops a match."""
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {bytes([b, x]): 256 + 2 * b + (x == 49) for b in range(128, 192) for x in b"a1"}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    unknown = [c for c in map(chr, [*range(128, 0xD800), *range(0xE000, 0x40000)]) if unicodedata.category(c) == "Cn"]

    def joins(x: str) -> np.ndarray:
        ids = np.array(probe("".join(f"{x}{c}{x}\n" for c in unknown)))
        sizes = np.diff(np.flatnonzero(ids == 10), prepend=-1) - 1
        return sizes == np.array([len(c.encode()) + 1 for c in unknown])

    theirs = np.where(joins("a"), "L", np.where(joins("1"), "N", ""))
    every = "".join(unknown)
    letters, numbers = set(regex.findall(r"\p{L}", every)), set(regex.findall(r"\p{N}", every))
    return {ord(c): STAND_INS[str(kind)] for c, kind in zip(unknown, theirs, strict=True) if kind != ("L" if c in letters else "N" if c in numbers else "")}


class Seen(dict):
    """A number for each match; new ones are listed."""

    def __init__(self, *known):
        super().__init__(*known)
        self.new: list[str] = []

    def __missing__(self, match: str) -> int:
        self.new.append(match)
        self[match] = n = len(self)
        return n


class Codec:
    """Encodes and decodes by a file of ranks and the pattern that cuts texts."""

    _loaded: dict[tuple[str, str], Codec] = {}

    def __init__(self, name: str, pattern: str):
        with open(vocabulary(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks, self.regex, self.tokens = ranks, regex.compile(pattern), [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.dtype = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        self.seen, self.table, self.used = Seen(), [], np.zeros(0, np.int32)
        self.calls = 0

    @cached_property
    def merger(self) -> Merger:
        return Merger(self.ranks)

    @cached_property
    def kinds(self) -> dict[int, str]:
        return _kinds(self.regex.pattern)

    @cached_property
    def differs(self) -> re.Pattern:
        """Finds characters that may need a stand-in."""
        beyond = "".join(f"\\U{c:08x}" for c in self.kinds if c < 0x10000)
        return re.compile(f"[{beyond}\U00010000-\U0010ffff]")

    @classmethod
    def of(cls, name: str, pattern: str | None = None) -> Codec:
        """One for a worker process."""
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        if (name, pattern) not in cls._loaded:
            cls._loaded[name, pattern] = cls(name, pattern)
        return cls._loaded[name, pattern]

    def matches(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches, in lists of a bounded length."""
        if not text.isascii() and self.differs.search(text) and (cut := text.translate(self.kinds)) != text:
            found = (text[m.start() : m.end()] for m in self.regex.finditer(cut))
        elif len(text) < MATCHES:
            yield self.regex.findall(text)
            return
        else:
            found = (m.group() for m in self.regex.finditer(text))
        while some := list(islice(found, MATCHES)):
            yield some

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian, two bytes each if the vocabulary allows, else four.

        Matches become numbers first; then the ids of all that are new are worked out together."""
        codes = [[np.fromiter(map(self.seen.__getitem__, some), np.int32, len(some)) for some in self.matches(text)] for text in texts]
        new, self.seen.new = self.seen.new, []
        self.table += [x.astype(self.dtype).tobytes() for x in self.merger.ids([m.encode() for m in new])]
        out = [b"".join([self.table[c] for part in parts for c in part.tolist()]) for parts in codes]
        self._forget(codes, new)
        return out

    def _forget(self, codes: list[list[np.ndarray]], new: list[str]) -> None:
        """Long matches go at once; of too many, those go whose last use is longest ago."""
        self.calls += 1
        self.used = np.append(self.used, np.zeros(len(new), np.int32))
        for parts in codes:
            for part in parts:
                self.used[part] = self.calls
        for m in new:
            if len(m) > SHORT:
                self.used[self.seen[m]] = -1
        if len(self.seen) > REMEMBERED or (self.used < 0).any():
            bound = 0 if len(self.seen) <= REMEMBERED else np.sort(self.used)[-REMEMBERED // 2] + 1
            kept = [(m, c) for m, c in self.seen.items() if self.used[c] >= bound]
            self.table, self.used = [self.table[c] for _, c in kept], self.used[[c for _, c in kept]] if kept else self.used[:0]
            self.seen = Seen((m, i) for i, (m, _) in enumerate(kept))

    def numbers(self, ids: bytes) -> list[int]:
        return np.frombuffer(ids, self.dtype).tolist()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.numbers(ids)))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, up to CHARS bytes of text at once, or one longer text."""
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column("t")), 0))
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHARS)))
        yield batch.slice(at, n)
        at += n


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Id, n_tokens, ids (little-endian, two bytes each if the vocabulary allows) and ids_sha256 (of the decimal ids, joined by commas) of every row.

    Null and empty texts have no ids.  Repeated ids give a row each, a null id stays null; other columns are left out.  Without
    special tokens: their strings are text.  One pass without a shuffle; a worker holds one batch of texts, the ids of one text and what it remembers."""

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        codec = Codec.of(name, pattern)
        digits = [str(i) for i in range(len(codec.tokens))]
        for batch in batches:
            for rows in _slices(batch):
                ids = codec.encode([t or "" for t in rows.column("t").to_pylist()])
                shown = [sha256(",".join([digits[i] for i in codec.numbers(x)]).encode()).hexdigest() for x in ids]
                n = [len(x) // codec.dtype.itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([rows.column("i"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(shown, pa.string())], ["i", "n", "ids", "sha"])

    own = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return own.mapInArrow(ids_of, "i long, n long, ids binary, sha string").select(F.col("i").alias(id_col), F.col("n").alias("n_tokens"), "ids", F.col("sha").alias("ids_sha256"))


def decoded(ids: Column, name: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> Column:
    """The bytes of a column of ids as ``encode`` gives them; no bytes of no ids, null of null."""

    def bytes_of(column: pa.Array) -> pa.Array:
        codec = Codec.of(name, pattern)
        return pa.array([None if x is None else codec.decode(x) for x in column.to_pylist()], pa.binary())

    return F.arrow_udf(bytes_of, "binary")(ids)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Id, n_tokens, ids_sha256 and decoded_sha256 of every row: texts encoded, and their ids decoded again.  Rows as ``encode`` gives them."""
    return encode(docs, id_col, text_col, name).select(id_col, "n_tokens", "ids_sha256", F.sha2(decoded(F.col("ids"), name), 256).alias("decoded_sha256"))
