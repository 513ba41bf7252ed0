"""Personal data: base patterns, and a skip-chain conditional random field over the mentions that could be any.

The field's nodes are mentions: runs of numbers with the marks that join them, and what stands around ``@`` or a written
``(at)``; all other words are no entity by the model's state space.  Neighbours along the text share chain potentials.
Mentions with the same value, however written and however far apart, share a hub of their own, and so do those of the same
form; a mention and its hub share skip potentials, so what one mention's form makes plain reaches all others of its value.
Loopy messages go until they settle; a mention that no base span touches and whose label is all but certain becomes a span
of the method.

Weights are learned here by pseudo-likelihood on a bounded sample: its texts as they are, and a copy of each in which values
that the patterns found are written as the patterns miss them (no plus sign, ``(at)``, ``[.]``, other separators), said again
in such a form elsewhere, and put beside numbers that are no personal data.  The label of a rewritten value is that of the
value it was made of.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents with mentions that are learned from at most (expected; picked by a hash), and characters up to which a text may be picked.
SAMPLE, LONGEST = 3000, 50_000
STEPS, RATE, DECAY = 300, 2.0, 1e-4
#: Rounds of messages at most and the change at which they have settled, share of the old message that stays, and the marginal from which on a label counts.
ROUNDS, SETTLED, DAMP, SURE = 60, 1e-3, 0.3, 0.97
#: Characters up to which two mentions are neighbours, and slots that words before a mention are hashed into.
NEAR, SLOTS = 40, 32
#: Characters of texts that are marked at once, and edges whose messages are worked out at once.
BATCH, EDGES = 1 << 21, 1 << 17
#: The kinds in their order with their patterns (email is found around each ``@``).
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Mentions: the sign of an address, its domain, and a run of numbers.
AT = re.compile(r"\x20?(?:@|[(\[{]\x20?(?:at|AT|At)\x20?[)\]}])\x20?")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
NUMBERS = re.compile(r"(?<![0-9A-Za-z@])(?:\+|\+?\()?[0-9]++(?:(?:\[\.\]|\)\x20?|\x20\(|[\x20._/-])[0-9]++)*(?![0-9A-Za-z@])")
MENTION = r"[0-9@]|[(\[{] ?[aA][tT] ?[)\]}]"
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += (2 * d - 9 * (d > 4)) if i % 2 else d
    return total % 10 == 0


def _octet(part: str) -> bool:
    own = part.lstrip("0")
    return len(own) <= 3 and int(own or "0") <= 255


def _fits(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(map(_octet, text.split(".")))
    digits = re.sub(r"[^0-9]", "", text)
    return 9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``local@label(.label)+``: around each ``@`` in turn, so that long words without one cost one look."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """(kind's number, start, end) of the base patterns, by kind and then start; in time that is linear in the text."""
    out = [(0, a, b) for a, b in _emails(text)]
    for k, kind in list(enumerate(KINDS))[1:]:
        if {"phone": "+", "ip": "."}.get(kind, "") in text:
            out += [(k, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _fits(kind, m[0])]
    return out


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def mentions(text: str) -> list[tuple[int, int]]:
    """Spans that could be personal data, by start; none overlap."""
    mails, done = [], 0
    for m in AT.finditer(text):
        start = done + len(text[done : m.start()].rstrip(LOCAL))
        host = HOST.match(text, m.end())
        if start < m.start() and host:
            mails.append((start, host.end()))
        done = max(m.end(), host.end() if host else 0)
    out, k = list(mails), 0
    for m in NUMBERS.finditer(text):
        while k < len(mails) and mails[k][1] <= m.start():
            k += 1
        if k == len(mails) or m.end() <= mails[k][0]:
            out.append(m.span())
    return sorted(out)


def _value(own: str) -> str:
    """What a mention says, however written: its letters and digits, of long numbers the last nine digits."""
    core = re.sub(r"[^0-9a-z@]", "", AT.sub("@", own).lower())
    return core[-9:] if core.isdigit() else core


def _form(own: str) -> str:
    return re.sub(r"a{2,}", "a", re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", own.lower())))


def _features(own: str, before: str) -> list[float]:
    mark = AT.search(own)
    groups = re.findall(r"[0-9]+", own)
    sizes, digits = [len(g) for g in groups[:24]], "".join(groups)
    n, host = len(digits), own[mark.end() :] if mark else ""
    joined = len(set(re.sub(r"[0-9]", "", own)))
    octets = len(groups) == 4 and all(map(_octet, groups))
    flags = [
        1, bool(mark), "@" in own, "." in host, host.rpartition(".")[2].isalpha(), own.startswith("+"), own.startswith("00"), "(" in own, "[.]" in own, "." in own, "-" in own, "/" in own, "_" in own, " " in own,
        joined == 0, joined == 1, joined == 2, joined > 2, *(len(groups) == k for k in (1, 2, 3, 4, 5)), len(groups) > 5, *(a <= n <= b for a, b in ((1, 4), (5, 8), (9, 12), (13, 15), (16, 16), (17, 19))), n > 19,
        octets, octets and "[.]" in own, 13 <= n <= 19 and luhn(digits), sizes == [4] * 4, sizes == [4] * 4 and luhn(digits), sizes[-2:] == [3, 4] and len(sizes) <= 4, sizes[-3:] == [3, 3, 4] and len(sizes) <= 4, sizes[-3:] == [3, 3, 4] and "(" in own,
        sizes in ([4, 2, 2], [2, 2, 4]), before[-1:] in "=:\"'", before.rstrip()[-1:].isdigit(), max(sizes, default=0) > 4,
    ]
    word = re.search(r"([^\W\d_]+)\W*$", before)
    slots = [0.0] * SLOTS
    if word:
        slots[zlib.crc32(word[1].lower().encode("utf-8", "surrogatepass")) % SLOTS] = 1.0
    return [float(f) for f in flags] + slots


WIDTH = len(_features("0", ""))


@dataclass
class Graph:
    """Mentions of some documents: owner, span, features, label (0 none, else kind + 1).

    Edges: ``chain`` between neighbours, ``same`` and ``alike`` from mentions to hubs of a value and of a form (hub numbers follow the mentions')."""

    owner: np.ndarray
    spans: list[tuple[int, int]]
    x: np.ndarray
    y: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    alike: np.ndarray
    hubs: int = 0


def _pairs(e: list) -> np.ndarray:
    return np.array(e, np.int64).reshape(-1, 2)


def graph(texts: list[str], labelled: list[list[Span]]) -> Graph:
    """The graph of some texts; a mention's label is that of the first given span that it overlaps."""
    owner, spans, x, y, chain = [], [], [], [], []
    hubs: tuple[dict, dict] = ({}, {})
    for d, (text, given) in enumerate(zip(texts, labelled, strict=True)):
        given, k, first = sorted(given, key=lambda s: s[1:]), 0, len(spans)
        for start, stop in mentions(text):
            n, own = len(spans), text[start:stop]
            while k < len(given) and given[k][2] <= start and all(s[2] <= start for s in given[k : k + 2]):
                k += 1
            owner.append(d)
            spans.append((start, stop))
            x.append(_features(own, text[max(0, start - 24) : start]))
            y.append(next((s[0] + 1 for s in given[k : k + 8] if s[1] < stop and start < s[2]), 0))
            if n > first and start - spans[n - 1][1] <= NEAR:
                chain.append((n - 1, n))
            for hub, key in zip(hubs, (_value(own), _form(own)), strict=True):
                hub.setdefault((d, key), []).append(n)
    n, edges = len(spans), ([], [])
    count = n
    for hub, out in zip(hubs, edges, strict=True):
        for members in hub.values():
            if len(members) > 1:
                out += [(i, count) for i in members]
                count += 1
    return Graph(np.array(owner, np.int64), spans, np.array(x, np.float64).reshape(n, WIDTH), np.array(y, np.int64), _pairs(chain), _pairs(edges[0]), _pairs(edges[1]), count - n)


@dataclass
class Field:
    """Weights: features by labels, and symmetric potentials of chain edges and of edges to hubs."""

    unary: np.ndarray
    chain: np.ndarray
    same: np.ndarray
    alike: np.ndarray


def train(g: Graph, steps: int = STEPS, rate: float = RATE) -> Field:
    """Gradient ascent on the pseudo-likelihood: each label given its features, its neighbours' labels, and for each hub the label that most of its other members have."""
    k, n = len(KINDS) + 1, len(g.y)
    f = Field(np.zeros((WIDTH, k)), *(np.zeros((k, k)) for _ in range(3)))
    if not n or not g.y.any():
        f.unary[0, 0] = 10.0  # nothing learned: no label is ever likely
        return f
    hot = np.eye(k)[g.y]
    by_chain = np.zeros((n, k))
    np.add.at(by_chain, g.chain[:, 0], hot[g.chain[:, 1]])
    np.add.at(by_chain, g.chain[:, 1], hot[g.chain[:, 0]])

    def of_hub(edges: np.ndarray) -> np.ndarray:
        total = np.zeros((g.hubs, k))
        np.add.at(total, edges[:, 1] - n, hot[edges[:, 0]])
        out = np.zeros((n, k))
        others = total[edges[:, 1] - n] - hot[edges[:, 0]]
        out[edges[:, 0]] = np.eye(k)[others.argmax(axis=1)]
        return out

    around = [(f.chain, by_chain), (f.same, of_hub(g.same)), (f.alike, of_hub(g.alike))]
    for _ in range(steps):
        logits = g.x @ f.unary + sum(near @ w for w, near in around)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        gap = hot - p / p.sum(axis=1, keepdims=True)
        f.unary += rate * (g.x.T @ gap / n - DECAY * f.unary)
        for w, near in around:
            step = near.T @ gap / n
            w += rate * ((step + step.T) / 2 - DECAY * w)
    return f


def marginals(g: Graph, f: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Each mention's label probabilities by loopy sum-product messages, all edges at once, until they settle."""
    n = len(g.x)
    own = np.concatenate([g.x @ f.unary, np.zeros((g.hubs, len(KINDS) + 1))])
    kinds = (g.chain, g.same, g.alike)
    edges = np.concatenate([*kinds, *(e[:, ::-1] for e in kinds)])
    which = np.repeat([0, 1, 2] * 2, [len(e) for e in kinds] * 2)
    tables = np.stack([f.chain, f.same, f.alike])
    half = len(edges) // 2
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    messages, belief = np.zeros((len(edges), own.shape[1])), own
    for _ in range(rounds if len(edges) else 0):
        new = np.empty_like(messages)
        for at in range(0, len(edges), EDGES):
            part = slice(at, at + EDGES)
            out = belief[edges[part, 0]] - messages[back[part]]
            new[part] = np.logaddexp.reduce(out[:, :, None] + tables[which[part]], axis=1)
        new -= new.max(axis=1, keepdims=True)
        new = DAMP * messages + (1 - DAMP) * new
        change = np.abs(new - messages).max()
        messages, belief = new, own.copy()
        np.add.at(belief, edges[:, 1], messages)
        if change < SETTLED:
            break
    p = np.exp(belief[:n] - belief[:n].max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added(texts: list[str], bases: list[list[Span]], f: Field, sure: float = SURE) -> list[list[Span]]:
    """Spans of the method: mentions all but surely of a kind that no base span touches."""
    out: list[list[Span]] = [[] for _ in texts]
    g = graph(texts, bases)
    if len(g.y):
        p = marginals(g, f)
        for i in np.flatnonzero((g.y == 0) & (p[:, 1:].max(axis=1) >= sure)):
            out[g.owner[i]].append((int(p[i, 1:].argmax()), *g.spans[i]))
    return out


def rewritten(kind: int, own: str, rng: random.Random) -> str:
    """A value as the base pattern of its kind misses it."""
    digits = re.sub(r"[^0-9]", "", own)
    if kind == 0:
        return own.replace("@", rng.choice(["(at)", "[at]", " (at) ", " [at] ", "{at}"]))
    if kind == 1:
        return own.replace(".", rng.choice(["[.]", "[.]", "-"]))
    if kind == 2:
        return rng.choice([".", "_", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, local = digits[-10:-7], f"{digits[-7:-4]}-{digits[-4:]}"
    return rng.choice([f"{digits[:-10]} ({area}) {local}".strip(), f"({area}) {local}", f"00{digits[:-10]} {area} {local}", f"{area}-{local}", f"{area}.{local.replace('-', '.')}"])


def noise(rng: random.Random) -> str:
    """A number that is no personal data."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        lambda: f"20{d(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(10, 28)}.0{rng.randint(1, 9)}.20{d(2)}", lambda: f"{rng.randint(1, 9)}.{d(1)}.{d(1)}", lambda: f"{d(3)}.{d(2)}", lambda: d(rng.randint(1, 12)),
        lambda: f"{d(2)}-{d(2)}-{d(2)}-{d(2)}-{d(2)}", lambda: f"{rng.randint(256, 999)}.{d(3)}.{rng.randint(300, 999)}.{d(1)}", lambda: f"{d(4)}/{d(4)}", lambda: f"{d(4)}-{d(3)}", lambda: " ".join(d(2) for _ in range(rng.randint(2, 7))), lambda: next(x for x in iter(lambda: d(16), "") if not luhn(x)),
        lambda: rng.choice(["-", ".", " ", "/"]).join(x[i : i + 4] for x in [next(x for x in iter(lambda: d(16), "") if not luhn(x))] for i in range(0, 16, 4)), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
    ])()


def varied(text: str, base: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """A copy of a text with values rewritten, said again or joined by noise, and the spans of all values in it."""
    plain, last = [], 0
    for k, a, b in sorted(base, key=lambda s: (s[1], -s[2])):
        if a >= last:
            plain.append((k, a, b))
            last = b
    gaps = [m.start() for m in re.finditer(r"(?<=[^\W\d]) (?=[^\W\d])", text) if not any(a <= m.start() < b for _, a, b in plain)] if len(text) <= LONGEST else []
    puts = [(at, None) for at in rng.choices(gaps, k=rng.randint(0, 4))] if gaps else []
    puts += [(rng.choice(gaps), s) for s in plain if gaps and rng.random() < 0.4]
    events = sorted([(a, 1, s) for s in plain for a in [s[1]]] + [(at, 0, s) for at, s in puts], key=lambda e: e[:2])
    out, spans, size, at = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for place, own, s in events:
        put(text[at:place])
        at = place
        if own:
            k, a, b = s
            piece = rewritten(k, text[a:b], rng) if rng.random() < 0.5 else text[a:b]
            spans.append((k, size, size + len(piece)))
            put(piece)
            at = b
        elif s is None:
            put(f" {noise(rng)}")
        else:
            piece = rewritten(s[0], text[s[1] : s[2]], rng)
            put(" ")
            spans.append((s[0], size, size + len(piece)))
            put(piece)
    put(text[at:])
    return "".join(out), spans


def examples(text: str, seed: int) -> list[tuple[str, list[Span]]]:
    """A text with its base spans, and a varied copy with the spans of all values, those of the base first found there too."""
    base = base_spans(text)
    other, spans = varied(text, base, random.Random(seed))
    return [(text, base), (other, spans + [s for s in base_spans(other) if not any(a < s[2] and s[1] < b for _, a, b in spans)])]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """The field from at most about ``sample`` of the texts of at most ``longest`` characters that have mentions, each whole and with a varied copy.

    The driver gets the sample's features, labels and edges alone."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where((F.length("t") <= longest) & F.col("t").rlike(MENTION))
    n = own.count()
    picked = own.where(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample / max(n, 1)))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist(), strict=True):
                g = graph(*map(list, zip(*examples(text, zlib.crc32(f"{i}:{len(text)}".encode())), strict=True)))
                out.append((g.x.astype(np.uint8).tobytes(), g.y.astype(np.int8).tobytes(), *(e.astype(np.int32).tobytes() for e in (g.chain, g.same, g.alike)), g.hubs))
            kinds = [pa.binary()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["id", "x", "y", "c", "s", "a", "h"])

    rows = picked.mapInArrow(nodes, "id long, x binary, y binary, c binary, s binary, a binary, h long").toArrow().sort_by([("id", "ascending"), ("x", "ascending")]).to_pylist()
    y = [np.frombuffer(r["y"], np.int8).astype(np.int64) for r in rows]
    begin = np.cumsum([0, *map(len, y)])
    hub = begin[-1] + np.cumsum([0, *(r["h"] for r in rows)])

    def edges(name: str, to_hubs: bool) -> np.ndarray:
        parts = [np.frombuffer(r[name], np.int32).reshape(-1, 2) + [begin[i], hub[i] - len(y[i]) if to_hubs else begin[i]] for i, r in enumerate(rows)]
        return np.concatenate(parts).astype(np.int64) if parts else _pairs([])

    x = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(-1, WIDTH) for r in rows]) if rows else np.zeros((0, WIDTH))
    return train(Graph(np.zeros(begin[-1], np.int64), [], x.astype(np.float64), np.concatenate(y) if y else np.zeros(0, np.int64), edges("c", False), edges("s", True), edges("a", True), int(hub[-1] - begin[-1])))


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts that hold about ``most`` characters."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added (spans of the method), n_spans (all).

    Null and empty texts have no spans; repeated rows and null ids give a row each; other columns are left out; an empty table
    gives no rows.  Time and memory are linear in a text, with or without blanks.  The field's weights (a few hundred numbers)
    travel with the task; no shuffle."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [t or "" for t in batch.column("t").to_pylist()]
            for begin, stop in _groups([len(t) for t in every], BATCH):
                texts = every[begin:stop]
                bases = [base_spans(t) for t in texts]
                more = added(texts, bases, field)
                counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(named(b).encode()).hexdigest() for b in bases], pa.string())
                spans = pa.array([named(b + m) for b, m in zip(bases, more, strict=True)], pa.string())
                extra = [pa.array(x, pa.int64()) for x in ([len(m) for m in more], [len(b) + len(m) for b, m in zip(bases, more, strict=True)])]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin, stop - begin), *counts, digest, spans, *extra], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return own.mapInArrow(scanned, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long").withColumnRenamed("id", id_col)
