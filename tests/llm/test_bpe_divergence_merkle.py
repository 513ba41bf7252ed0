"""Byte-level BPE against tiktoken, the divergence audit against its SQL, the Merkle manifest against plain Python."""

import base64
import hashlib
import random
import time
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from docverify.llm import bpe, divergence, merkle

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


# --- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    pool = [c for c in map(chr, (rng.randint(0, 0x2FFFF) for _ in range(400))) if not 0xD800 <= ord(c) < 0xE000]
    pool += list("aaab1  \n\t'sé ß中.!") + [chr(c) for c in (0, 0x1C, 0x85, 0xA0, 0x301, 0x1C89, 0x10EE7, 0x1F600, 0x3000, 0xFFFE)]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_are_those_of_the_library(codec, library):
    texts = [*odd_texts(4000), "", " ", "<|endoftext|>", "don't we'll", "a" * 300, "x" * 63 + " " + "y" * 65, "ab" * 5000, "\n" * 1000]
    found = codec.encode(texts)
    assert [codec.numbers(x) for x in found] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(x).decode() for x in found] == texts


def test_short_and_long_ways_agree_on_any_ranks():
    """Few symbols and ranks in a random order: pairs overlap, go stale and make tokens of lower rank than their own."""
    rng = random.Random(2)
    for _ in range(60):
        tokens = {bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 25))}
        order = [bytes([b]) for b in range(256)] + sorted(tokens, key=lambda _: rng.random())
        ranks = {t: i for i, t in enumerate(order)}
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(40)]
        merger = bpe.Merger(ranks)
        together = [x.tolist() for x in merger._chained(pieces, merger._together)]
        alone = [merger._chained([p], merger._one_by_one)[0].tolist() for p in pieces]
        assert together == alone == [brute_ids(p, ranks) for p in pieces]
        assert merger.queue.first() == -1 and not merger.queue.buckets


def brute_ids(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        rank, i = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=(None, 0))
        if rank is None:
            return [ranks[p] for p in parts]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_a_match_of_a_million_bytes_takes_seconds(codec, library):
    rng = random.Random(3)
    began = time.time()
    text = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    ids = codec.encode([text])[0]
    assert time.time() - began < 60 and codec.decode(ids).decode() == text
    part = text[:3000]
    assert codec.numbers(codec.encode([part])[0]) == library.encode_ordinary(part)


def test_queue_finds_the_lowest_rank():
    rng = random.Random(4)
    queue, held = bpe.RankQueue(300_000), set()
    for _ in range(5000):
        if held and rng.random() < 0.5:
            assert queue.first() == min(held)
            queue.drained(min(held))
            held.discard(min(held))
        else:
            held.add(rank := rng.randrange(300_000))
            queue.bucket(rank).append(0)
    assert queue.first() == min(held, default=-1)


def test_what_is_remembered_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Codec(VOCABULARY, public_tokenizers.PATTERN)
    for k in range(20):
        texts = [" ".join(f"word{k * 7 + i}" for i in range(40)), "z" * 200 + str(k)]
        assert [own.numbers(x) for x in own.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        assert len(own.seen) == len(own.table) == len(own.used) <= 150 and not any(len(m) > bpe.SHORT for m in own.seen)


def test_round_trip_of_rows(spark, library):
    texts = [None, "", *odd_texts(60, 5), "plain words, and again plain words"]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(4, texts[4])]
    found = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    own = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    expected = [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()) for i, ids, t in own]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    kept = bpe.encode(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    assert kept.select(bpe.decoded(F.col("ids"))).first()[0] == b"some text"


# --- divergence


def audited(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return sorted(map(tuple, divergence.audit(df, **more).collect()))


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    return sorted(con.execute(divergence.ORACLE_SQL).fetchall())


def some_rows(n, sources, words, seed=6):
    rng = random.Random(seed)
    vocabulary = ["Ab", "ab", "é", "É", "中文", "x1y", "-", "\U0001f600", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(words))]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "de", "", None]), rng.choice([*(f"s{i}" for i in range(sources)), None, ""])) for i in range(n)]
    rows += [(None, None, "en", "s0"), (7, "", "fr", "s1"), (8, "12 34", "fr", "s2"), (9, "solo", "it", "s0")]
    return rows + rng.choices(rows, k=n // 2)  # copies


@pytest.mark.parametrize(("tile", "shard", "entries"), [(64, 2048, 250_000), (2, 7, 5)])
def test_audit_equals_its_sql_in_blocks_of_any_size(spark, monkeypatch, tile, shard, entries):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rows = some_rows(120, 6, 40)
    assert audited(spark, rows) == by_sql(rows)


def test_audit_of_one_text_copied_over_and_over(spark):
    rows = some_rows(30, 3, 10) + [(100 + i, "the same words of every copy", "en", f"s{i % 3}") for i in range(600)]
    assert audited(spark, rows) == by_sql(rows)
    texts = divergence.collapsed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    copies = texts.where("text = 'the same words of every copy'").collect()
    assert len(copies) == 1 and sorted((x.source, x.n) for x in copies[0]["by"]) == [("s0", 200), ("s1", 200), ("s2", 200)]


def test_audit_of_nothing_and_of_no_terms(spark):
    assert audited(spark, []) == []
    rows = [(1, "a", "en", "x"), (2, "b", "en", "y"), (3, None, "en", None)]
    found = audited(spark, rows)
    assert found == by_sql(rows) and {r[4] for r in found} == {0} and len(found) == 6


def test_shares_stay_exact_where_products_leave_64_bits(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(t), t) for t in (1, 7, 10**6, 10**12, 9 * 10**15) for _ in range(40)]
    found = spark.createDataFrame(pairs, "n long, t long").select("n", "t", divergence.share(F.col("n"), F.col("t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.t for r in found)


def test_terms_of_a_very_long_text(monkeypatch):
    text = " ".join(f"w{chr(97 + i % 26)} W{chr(65 + i % 26)}É{i}" for i in range(3000)) + "é" * 500
    codes = divergence._Codes()
    whole = [codes.terms[i] for i in divergence._coded(text, codes)]
    assert whole == [t.translate(divergence.LOWER) for t in divergence.TERM.findall(text)] and len(codes.terms) == len(set(whole))
    monkeypatch.setattr(divergence, "PIECE", 100)
    again = divergence._Codes()
    assert [again.terms[i] for i in divergence._coded(text, again)] == whole and divergence._coded("", again).tolist() == []


# --- Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def own_leaf(row, add=0):
    doc, text, lang, source, n = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, None if n is None else n + add, text)))


def own_tree(nodes):
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, i in zip(ways, places, strict=True):
            way.append(None if i ^ 1 >= len(nodes) else (i & 1, nodes[i ^ 1]))
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        places = [i >> 1 for i in places]
    return nodes[0], ways


def brute_manifest(rows):
    if not rows:
        return []
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, own_leaf(r)))
    trees = [own_tree([own_leaf(r) for r in groups[lang]]) for lang in langs]
    root, tops = own_tree([t[0] for t in trees])
    out = []
    for lang, (subroot, ways), top in zip(langs, trees, tops, strict=True):
        for r, way in zip(groups[lang], ways, strict=True):
            changes = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = own_leaf(r, int(changes))
            for s in [*way, *top]:
                folded = h(folded) if s is None else h(s[1], folded) if s[0] else h(folded, s[1])
            out.append((r[0], own_leaf(r), subroot, root, h(*(s[1] for s in [*way, *top] if s)), folded, folded == root))
    return out


@pytest.mark.parametrize(("n", "bits"), [(0, 3), (1, 10), (2, 1), (90, 10), (333, 2), (64, 3)])
def test_manifest_equals_brute_force(spark, n, bits):
    rng = random.Random(n)
    langs = [None, "", "en", "de", "fr", "é", "\U0001f600", "￾"]
    rows = [(None if rng.random() < 0.03 else rng.choice([rng.randint(-9, 2 * n), 2**60 + rng.randint(0, 9)]), rng.choice([None, "", "é\U0001f600", "a:b"]), rng.choice(langs) if n != 2 else "en", rng.choice([None, "s"]), rng.choice([None, 3, -4])) for _ in range(n)]
    rows += rows[: n // 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = merkle.manifest(df.withColumns({c: F.lit("x") for c in ("id", "tree", "pos", "digest", "way", "n")}), bits=bits)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, brute_manifest(rows)))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(map(str, con.execute(merkle.ORACLE_SQL).fetchall())) == sorted(map(str, brute_manifest(rows)))


def test_proofs_lead_to_the_root_and_show_changes(spark):
    rows = [(i, f"text {i}", f"l{i % 5}", "s", i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    proven = merkle.manifest(df, bits=2, with_proof=True).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.again == r.root for r in proven) and 0 < sum(not r.verified for r in proven) < 40
    assert {r.doc_id for r in proven if not r.verified} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0}
    other = merkle.manifest(df.withColumn("text", F.when(F.col("doc_id") == 3, "other").otherwise(F.col("text"))), bits=2)
    roots = {r.doc_id: (r.subroot, r.root) for r in other.collect()}
    assert all((roots[r.doc_id][0] == r.subroot) == (r.doc_id % 5 != 3) and roots[r.doc_id][1] != r.root for r in proven)


def test_many_equal_rows_are_dealt_over_blocks(spark):
    rows = [(1, "same", "en", "s", 4)] * 500 + [(i, "other", "de", "s", 5) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    assert sorted(map(str, map(tuple, merkle.manifest(df, bits=4).collect()))) == sorted(map(str, brute_manifest(rows)))
