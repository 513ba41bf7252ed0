"""The operators against brute force, round trips and held-out accuracy, on small rows."""

import gzip
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docverify.llm import bpe, components, decontam, divergence, langid, merkle, neardup, packing, pii, quality, rules, secrets, shingles, tokens, warc
from docverify.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, own int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "123 456", "é", "x" * 3000, "a b", "a b", "\U0001f600 go"]


def docs(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en", f"s{i % 3}", 0, "t", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def low(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- 1


def test_warc_round_trip_and_damage(spark, tmp_path):
    big, small = "<p>é</p>" * 200, "<p>x</p>"
    pages = spark.createDataFrame([(1, "http://a/ b", big), (7, None, big), (3, "u", big), (4, "u", small), (5, "u", small), (6, "u", None), (None, "u", "n" * 2000)], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.pages_through_archives(pages).collect()}
    assert len(found) == 7 and all(r.digest_ok and r.error is None for r in found.values())
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {1: ("revisit", 7), 3: ("revisit", 7), 7: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    assert found[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and found[1].payload_bytes == len(big.encode()) and found[6].payload_bytes == 0
    assert warc.pages_through_archives(pages.limit(0)).count() == 0

    parts = [warc.member(f"urn:page:{i}", "u", b"payload" * 50, None, "2024-01-01T00:00:00Z") for i in range(4)]
    assert gzip.decompress(parts[0]).startswith(b"WARC/1.0\r\n")
    broken = parts[1][:40] + b"\x00\x01\x02" + parts[1][43:]
    wrong = zlib.compressobj(1, zlib.DEFLATED, 31)
    altered = wrong.compress(gzip.decompress(parts[2]).replace(b"payloadpayload", b"payloadpayloaX", 1)) + wrong.flush()
    (tmp_path / "a.warc.gz").write_bytes(parts[0] + broken + altered + parts[3] + parts[0][:60])
    rows = warc.read_warc(spark, spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "file string")).orderBy("position").collect()
    good = [(r.record_id, r.digest_ok) for r in rows if r.error is None]
    assert good == [("urn:page:0", True), ("urn:page:2", False), ("urn:page:3", True)]
    assert sum(r.error is not None for r in rows) >= 2


def brute_pages(rows):
    """page_id -> (payload_bytes, payload_digest, record_type, refers_to)."""
    best = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            best[html] = max(i, best.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        other = best.get(html) if html in best and best[html] != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other is not None else "response", other))
    return sorted(out, key=str)


@pytest.mark.parametrize(("few", "hot"), [(10**6, 10**6), (0, 10**6), (0, 3)])
def test_pages_equal_brute_force(spark, few, hot):
    """Groups by broadcast, by shuffle, and with hot ones dealt over tasks; repeats, ties, nulls, long pages, clashing columns."""
    rng = random.Random(17)
    bodies = ["a" * 999, "a" * 1000, "é" * 500, "é" * 499, "", None, "hot" * 400, "\r\n\r\n" * 300, "WARC/1.0\r\n" * 200, "x" * 3_000_000, "\x1f\u008b\x08" * 400]
    rows = [(i, rng.choice(["http://a/", None, "http://b/\r\nX: y"]), rng.choice([*bodies, bodies[6], bodies[6]])) for i in range(60)] + [(59, "u", bodies[6]), (None, "u", bodies[6]), (None, None, None)]
    pages = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "page_id long, url string, html string, digest string, n int, payload string")
    found = warc.pages_through_archives(pages, few, hot).collect()
    assert all(r.digest_ok and r.error is None for r in found)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute_pages(rows)


def test_reader_checks_framing_and_recovers(spark, tmp_path):
    date, pay = "2024-01-01T00:00:00Z", b"payload" * 50
    plain = gzip.decompress(warc.member("urn:page:9", "u", pay, None, date))
    packed = [warc.member(f"urn:page:{i}", "u", random.Random(i).randbytes(200_000), None, date) for i in range(3)]
    flipped = packed[1][:3000] + bytes(b ^ 0x55 for b in packed[1][3000:3400]) + packed[1][3400:]
    short, long, none = plain.replace(b"Content-Length: 4", b"Content-Length: 3"), plain + b"more", b"no header at all"
    lost = warc.member("urn:page:5", "u", pay, "urn:page:77", date)
    twin = warc.member("urn:page:6", "u", pay, "urn:page:9", date)
    other = warc.member("urn:page:7", "u", b"else", "urn:page:9", date)
    (tmp_path / "b.warc.gz").write_bytes(packed[0] + flipped + packed[2] + b"".join(map(gzip.compress, (short, long, none, plain))) + lost + twin + other + packed[0][:100])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    read = warc.settled(warc.read_warc(spark, spark.createDataFrame([(f"file://{tmp_path}/{x}.warc.gz",) for x in "bc"], "file string")), "test")
    rows = warc.with_responses(read).orderBy("position").collect()
    assert [r.record_id for r in rows if r.error is None] == [f"urn:page:{i}" for i in (0, 2, 9, 5, 6, 7)]
    assert {r.record_id: (r.payload_bytes, r.digest_ok) for r in rows if r.record_type == "revisit"} == {"urn:page:5": (None, False), "urn:page:6": (350, True), "urn:page:7": (None, False)}
    assert sum(r.error is not None for r in rows) >= 5 and next(r for r in rows if r.record_id == "urn:page:9").payload == pay


# --- 2


def test_contained_items_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (3, 6, 20, 20, 60, 9)] + ["", None]
    texts = [" ".join([*rng.choices(vocabulary, k=rng.randint(0, 300)), *(items[i] or "").upper().split()[: rng.choice([99, 99, 17])], *rng.choices(vocabulary, k=30)]) for i in [rng.randrange(6) for _ in range(40)]] + [None, ""]
    sets = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = {}
    for j, item in enumerate(items):
        w = low(item)
        k = min(5, len(w))
        for i, t in enumerate(texts):
            if w and 100 * len(own := sets(w, k) & sets(low(t), k)) >= 80 * len(sets(w, k)):
                want[i, j] = (len(sets(w, k)), len(own))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for bounds in ({}, {"large": 8, "bucket": 4}, {"large": 1, "bucket": 1000}):
        found = decontam.contained(docs(spark, texts), bench, **bounds).collect()
        assert {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in found} == want and len(found) == len(want) > 20
    assert decontam.contained(docs(spark, texts), bench.limit(0)).count() == 0


def test_a_document_of_two_thousand_items(spark):
    """Items that all open alike; the document holds half of each item here and half there, one without its end, one but for three words."""
    rng = random.Random(20)
    items = ["which of these is true about it " + " ".join(f"w{rng.randint(0, 9999)}" for _ in range(20)) for _ in range(2000)]
    whole = " . ".join(" ".join(x.split()[:15]) for x in items[2:]) + " ; " + " . ".join(" ".join(x.split()[11:]) for x in items[2:]) + " / " + " ".join(items[0].split()[:-2]) + " / " + " ".join(items[1].split()[:-8])
    began = time.time()
    found = decontam.contained(docs(spark, [whole, items[7], None, "x" * 1_000_000]), spark.createDataFrame([(i, x, "t") for i, x in enumerate(items)], "item_id long, text string, doc_id string"))
    got = sorted((r.doc_id, r.item_id) for r in found.collect())
    assert time.time() - began < 60
    assert got == [*((0, i) for i in range(2000) if i != 1), (1, 7)]


@pytest.mark.parametrize("tail", [3, 8, 30])
def test_items_of_one_opening_do_not_all_meet(spark, tail):
    """Documents that each hold one of many items with a common opening; the pairs to verify grow with the documents."""
    rng = random.Random(23)
    opening = " ".join(f"o{i}" for i in range(20))
    made = []
    for n in (200, 400):
        items = [opening + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(tail)) for _ in range(n)]
        texts = [f"before {x if i % 2 else ' '.join(x.split()[:-1])} after {i}" for i, x in enumerate(items)]
        found = decontam.contained(docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
        got = sorted((r.doc_id, r.item_id) for r in found.collect())
        sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, items)]
        own = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
        assert got == [(i, j) for i, x in enumerate(own) for j, q in enumerate(sets) if 100 * len(x & q) >= 80 * len(q)]
        made.append(len(got))
    assert made == [200, 400] if tail > 3 else made[0] > 200


def test_contained_of_an_empty_item_table_and_of_items_said_twice(spark):
    df = docs(spark, ["one two three four five six seven", None])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained(df, empty).count() == 0 and decontam.contained(df, spark.createDataFrame([(1, None), (2, "")], empty.schema)).count() == 0
    twice = spark.createDataFrame([(i, "one two three four five six") for i in range(300)], empty.schema)
    assert sorted((r.doc_id, r.item_id) for r in decontam.contained(df, twice).collect()) == [(0, i) for i in range(300)]


def test_contained_of_repeats_and_nulls(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "p q r s t u"), (None, "a b c d e f g"), (4, None)], "item_id long, text string")
    df = spark.createDataFrame([(5, "z a b c d e f g"), (5, "z a b c d e f g"), (None, "p q r s t u"), (7, None)], "doc_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.item_id, r.n_shared) for r in decontam.contained(df, bench).collect()))) == ["(5, 1, 3)", "(5, None, 3)", "(None, 1, 2)"]
    assert decontam.contained(df.limit(0), bench).count() == 0


# --- 3

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]


def base_secrets(t):
    out = []
    for k, (kind, rx) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in rx.finditer(t or "") if len(m[2] if kind == "assign" else m[0]) >= (6, 20, 24)[k]]
    return sorted(out)


def secret_texts():
    rng = random.Random(4)
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    parts = ["password: hunter", 'Token = "abc/def+123"', "api_key=ab", "secret=token:abcdefgh", f"x{hexes} y", "AKIA" + "Q7" * 10, "AKIASHORT", f"é{hexes[:23]}", "passwd : 'q.w.e.r'", "\U0001f600 apikey='zzzzzzz'", "AbCd0123456789EfGhIjKl", "aaaaaaaaaaaaaaaaaaaaaaa1"]
    return [" ".join(rng.sample(parts, rng.randint(0, 6))) for _ in range(40)] + ODD


def test_secrets_equal_brute_force(spark):
    texts = secret_texts()
    found = by_id(secrets.scan(docs(spark, texts)))
    for i, t in enumerate(texts):
        base = base_secrets(t)
        r = found[i]
        names = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert [s for s in r.spans.split(",") if s and not s.startswith("owned:")] == names


def test_ownership_parts_examples_from_live_ones(spark):
    shared, own = "Zx9Qw8Er7Ty6Ui5Op4As3", "Mn1Bv2Cx3Zl4Kj5Hg6Fd7"
    df = docs(spark, [f"key {shared} a", f"key {shared}", f"{shared}", f"live {own} end"])
    found = by_id(secrets.scan(df))
    assert [found[i].spans for i in range(4)] == ["", "", "", "owned:5:26"] and found[0].n_example == 1
    masked = by_id(secrets.redact(df))
    assert masked[3].text == "live [SECRET] end" and masked[0].text == f"key {shared} a" and masked[3].own == 1
    assert secrets.redact(df).columns == df.columns and secrets.scan(df.limit(0)).count() == 0


def test_short_secrets_of_one_owner_are_live(spark):
    df = docs(spark, ["password=hunter2 x", "secret: letmein1", "AKIA" + "Q7" * 10, "token=example1", "token=example1", "token=example1"])
    found, masked = by_id(secrets.scan(df)), by_id(secrets.redact(df))
    assert [(found[i].n_live, found[i].n_example) for i in range(6)] == [(1, 0)] * 3 + [(0, 1)] * 3
    assert [masked[i].text for i in (0, 1, 2, 3)] == ["[SECRET] x", "[SECRET]", "[SECRET]", "token=example1"]


def test_value_copied_widely_within_one_source_is_an_example(spark):
    shared, few = "Zx9Qw8Er7Ty6Ui5Op4As3", "Mn1Bv2Cx3Zl4Kj5Hg6Fd7"
    df = docs(spark, [f"key {shared}"] * 12 + [f"key {few}"] * 2).withColumn("source", F.lit("hot"))
    found, masked = by_id(secrets.scan(df)), by_id(secrets.redact(df))
    assert {(found[i].spans, found[i].n_live, found[i].n_example, found[i].ownership) for i in range(12)} == {("", 0, 1, "owned:4:1:12")}
    assert {(found[i].spans, found[i].n_live, found[i].n_example, found[i].ownership) for i in (12, 13)} == {("owned:4:25", 1, 0, "owned:4:1:2")}
    assert masked[0].text == f"key {shared}" and masked[13].text == "key [SECRET]"


def test_a_repository_of_two_owners_counts_once(spark):
    value = "key Zx9Qw8Er7Ty6Ui5Op4As3"
    df = spark.createDataFrame([(i, value, "en", f"s{i % 2}", 0, f"r{i // 2 % 6}", 1) for i in range(12)], DOCS)
    assert {r.ownership for r in secrets.scan(df, repo_col="t").collect()} == {"owned:4:2:6"}
    nulls = df.withColumns({"source": F.lit(None).cast("string"), "t": F.lit(None).cast("string")})
    assert {r.ownership for r in secrets.scan(nulls, repo_col="t").collect()} == {"owned:4:1:1"}


def test_hot_values_are_judged_like_others(spark):
    df = docs(spark, secret_texts()).withColumn("row_key", F.col("doc_id")).drop("own")
    found = secrets.settled(secrets.candidates(df.drop("row_key")).drop("text"), "test")
    plain, *others = ({r.row_key: r.asDict() for r in secrets.judged(found, "source", "doc_id", few=few, hot=hot).collect()} for few, hot in ((10**9, 2), (0, 10**9), (0, 2)))
    assert others == [plain, plain] and len(plain) > 20


def test_many_secrets_in_one_text(spark):
    """Twenty thousand matches: places and masks as by brute force, in time that doesn't grow with their square."""
    rng = random.Random(19)
    text = " ".join(f"é token=v{rng.randint(0, 10**9)}x{i}" if i % 3 else f"secret: token=q{i:06} \U0001f600" for i in range(20_000))
    df = docs(spark, [text, "no secret", None]).withColumn("source", F.lit("one"))
    began = time.time()
    found, masked = by_id(secrets.scan(df)), by_id(secrets.redact(df))
    assert time.time() - began < 60
    base = base_secrets(text)
    assert found[0].base_sha256 == hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in base).encode()).hexdigest() and found[0].n_live >= 20_000
    out, at = [], 0
    for a, _, b in base:
        out += [text[at:a], "[SECRET]"]
        at = b
    assert masked[0].text == "".join([*out, text[at:]]) and masked[2].text is None


# --- 4


def prose(rng, lang, n):
    words = {"en": ["the", "and", "with", "water", "house", "thing"], "de": ["und", "der", "nicht", "wasser", "haus", "über"], "fr": ["les", "dans", "avec", "être", "maison", "où"]}[lang]
    return " ".join(rng.choices(words, k=n))


def test_language_held_out_and_brute_force(spark):
    rng = random.Random(6)
    langs = [rng.choice(["en", "de", "fr"]) for _ in range(120)]
    df = docs(spark, [prose(rng, x, 20) for x in langs], langs)
    model = langid.learn(df)
    found = by_id(langid.predict(df, model))
    out = [i for i, r in found.items() if r.held_out]
    assert len(out) > 15 and np.mean([found[i].lang_pred == langs[i] for i in out]) == 1 and all(0 <= r.score <= 1 for r in found.values())
    odd = by_id(langid.predict(docs(spark, ODD), model))
    assert [odd[i].lang_pred for i in range(4)] == ["und"] * 4 and odd[4].lang_pred != "und" and odd[8].lang_pred != "und"
    empty = langid.predict(docs(spark, ["text"]), langid.learn(df.limit(0)))
    assert empty.first().lang_pred == "und"


def test_three_hundred_languages(spark):
    """Every given language can be predicted, the rarest too; each has letters and endings of its own."""
    rng = random.Random(7)
    made = []
    for k in range(300):
        own = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñåø", 9)
        made.append(["".join(rng.choice(own) for _ in range(rng.randint(3, 7))) for _ in range(12)])
    langs = [k for k in range(300) for _ in range(6 if k % 3 else 12)]
    df = docs(spark, [" ".join(rng.choices(made[k], k=30)) for k in langs], [f"l{k:03}" for k in langs])
    models = langid.learn(df)
    assert [x for m in models for x in m.languages] == [f"l{k:03}" for k in range(300)] and max(len(m.languages) for m in models) <= langid.BLOCK
    found = by_id(langid.predict(df, models))
    out = [(r.lang_pred, f"l{langs[i]:03}") for i, r in found.items() if r.held_out]
    assert len(out) > 300 and np.mean([a == b for a, b in out]) > 0.97
    assert {r.lang_pred for r in found.values()} == {f"l{k:03}" for k in range(300)}


def test_language_ties_repeats_and_long_texts(spark, monkeypatch):
    learned = [i for i in range(30) if zlib.crc32(str(i).encode()) % 4 != 2][:8]
    df = docs(spark, ["same words here"] * 30, ["b" if i in learned[::2] else "a" for i in range(30)]).where(F.col("doc_id").isin(learned))
    assert {r.lang_pred for r in langid.predict(df, langid.learn(df)).collect()} == {"a"}
    twice = df.unionByName(df)
    assert langid.predict(twice, langid.learn(twice)).count() == 16 and langid.predict(df.limit(0), langid.learn(df)).count() == 0
    nulls = df.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.when(F.col("own") == 1, F.lit(None).cast("string")))
    assert langid.learn(nulls) == []
    whole = langid.learn(df)
    monkeypatch.setattr(langid, "BUFFER", 8)
    monkeypatch.setattr(langid, "HELD", 16)
    parts = langid.learn(df)
    assert (whole[0].gram == parts[0].gram).all() and np.allclose(whole[0].cost3, parts[0].cost3)


def test_code_length_is_that_of_the_trees():
    train, text = b"   abracadabra abba", "   abbazeéab".encode()
    codes, n = np.unique(langid.codes_of(train), return_counts=True)
    model = langid.build(["x"], [(codes, n)])
    grams = [train[i : i + 4] for i in range(len(train) - 3)]

    def cost(context, byte):
        own = [g for g in grams if g[3 - len(context) : 3] == context]
        if own:
            kinds = len({g[3] for g in own})
            hits = sum(g[3] == byte for g in own)
            if hits:
                return -np.log2(hits / (len(own) + kinds))
            return -np.log2(kinds / (len(own) + kinds)) + (cost(context[1:], byte) if context else 8)
        return cost(context[1:], byte)

    want = sum(cost(text[i - 3 : i], text[i]) for i in range(3, len(text)))
    assert langid.lengths(model, [text[3:]])[0, 0] == pytest.approx(want, rel=1e-5)
    assert langid.lengths(model, [text[3:] * 200_000])[0, 0] > 0


# --- 5 and 10


def token_texts():
    rng = random.Random(8)
    return [*ODD, "a <|endoftext|> b", "I'll  go\n\n  now\t!", "".join(rng.choice(["ab", " ", "\n", "é", "1", ".", "  "]) for _ in range(3000)), "word " * 800, "x" * 900 + " y" + "z" * 900]


def test_counts_equal_the_library(spark):
    texts = token_texts()
    library = tokens.Encoder.of("byte_bpe_50k.json").tokenizer
    found = by_id(tokens.count_tokens(docs(spark, texts), chunk=150, overlap=8))
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (n, len((t or "").encode()), n > 1024), repr(t)[:60]
    assert tokens.count_tokens(docs(spark, texts).limit(0)).count() == 0


class Counting:
    """Counts the characters that are encoded."""

    def __init__(self, encoder):
        self.encoder, self.seen, self.calls = encoder, 0, 0

    def ends(self, text):
        self.seen, self.calls = self.seen + len(text), self.calls + 1
        return self.encoder.ends(text)


def test_long_texts_are_spliced_and_encoded_few_times():
    encoder, rng = tokens.Encoder.of("byte_bpe_50k.json"), random.Random(18)
    lots = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    texts = {
        "no blanks": "x" * 400_000, "letters": lots("abcdeé中", 400_000), "digits": lots("0123456789", 100_000), "blanks": " " * 50_000 + "a" + "\n" * 30_000, "rare blanks": (lots("abc", 20_000) + " ") * 8, "one early blank": "a b" + "c" * 200_000,
        "prose": lots(["the ", "über ", "it's ", "\n\n", "  ", "42, ", "\x1c ", "\u3000", "\x85", "naïve. "], 60_000), "special": lots(["word ", "<|endoftext|>", "<|", " \n"], 20_000), "surrounded": (" " * 9000 + "y" * 9000) * 6,
    }
    for name, text in texts.items():
        counted = Counting(encoder)
        assert tokens.resync_count(counted, text) == len(encoder.tokenizer.encode(text, add_special_tokens=False).ids), name
        assert counted.seen <= 4 * len(text), (name, counted.seen / len(text))
        assert counted.calls > 1


def test_packing_is_an_exact_round_trip(spark):
    texts = token_texts()
    library = tokens.Encoder.of("byte_bpe_50k.json").tokenizer
    rows = packing.pack(docs(spark, texts).repartition(3), length=64, with_ids=True).orderBy("sequence_id", "offset").collect()
    fill, pieces = {}, {}
    for r in rows:
        assert r.offset == fill.get(r.sequence_id, 0) and r.offset + r.length <= 64
        fill[r.sequence_id] = r.offset + r.length
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and len(ids) == r.length
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
    assert sorted(fill) == list(range(len(fill))) and all(n == 64 for s, n in fill.items() if s < len(fill) - 1)
    for i, t in enumerate(texts):
        got = np.concatenate([x for _, x, _ in sorted(pieces[i], key=lambda p: p[0])]).tolist()
        assert got == [*library.encode(t or "", add_special_tokens=False).ids, 0] and pieces[i][0][2] == len(got)


# --- 6


def near_texts():
    rng = random.Random(9)
    out = [*ODD]
    for n in (1, 2, 12, 60):
        for _ in range(6):
            base = [f"w{rng.randint(0, 300)}" for _ in range(n)]
            for edits in (0, 0, 1, 2, n // 10, n // 5):
                w = list(base)
                for _ in range(edits):
                    w[rng.randrange(n)] = f"v{rng.randint(0, 999)}"
                out.append(" ".join(w).upper() if edits == 1 else "\t".join(w))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    texts = near_texts()
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if (w := low(t)) else frozenset() for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    found = by_id(neardup.near_duplicates(docs(spark, texts), width=width))
    assert {i: (r.component_id, r.n_shingles, r.kept) for i, r in found.items()} == {i: (root(i), len(sets[i]), root(i) == i) for i in range(len(texts))}


def test_heavy_nodes_are_cut_by_shingles_and_keep_every_pair(spark):
    rng = random.Random(4)
    rows = [(1, i, i % 3, rng.randint(1, 60)) for i in range(40)] + [(1, 99, 0, 900), (2, 1, 1, 5), (2, 2, 2, 7), (3, 1, 1, 700)]
    size = {(node, i): n for node, i, _, n in rows}
    parts = {}
    for r in neardup._light(spark.createDataFrame(rows, "node long, id long, label long, n long"), 200).collect():
        parts.setdefault(r.node, set()).add((r.id, r.label))
    assert parts.pop(2) == {(1, 1), (2, 2)}
    weight = sorted(sum(size.get((1, i), 700) for i, _ in p) - max(size.get((1, i), 700) for i, _ in p) for p in parts.values())
    assert weight[-1] <= 200 + 60
    met = {(a, b) for p in parts.values() for a, _ in p for b, _ in p if a < b}
    ids = [*range(40), 99]
    assert met == {(a, b) for a in ids for b in ids if a < b}
    assert all(label == (i % 3 if i < 40 else 0) for p in parts.values() for i, label in p if len(p) > 1)


@pytest.mark.parametrize(("passes", "heavy"), [(2, neardup.HEAVY), (0, 250)])
def test_links_of_large_mixed_nodes_equal_brute_force(spark, passes, heavy):
    """Thirty pairs of similarity 0.8 in texts that are all alike: no node is small at first."""
    common = [f"c{i}" for i in range(88)]
    texts = [" ".join([*common, *(f"f{i // 2}x{k}" for k in range(2)), *(f"d{i}x{k}" for k in range(11))]) for i in range(60)]
    own = docs(spark, texts).select(F.col("doc_id").alias("id"), "text")
    sigs = neardup.settled(neardup.signatures(own, 1), "test")
    found = {r.id: r.label for r in neardup.linked_classes(own, sigs.select("id", "sig", "marks"), 1, 80, trees=4 if passes else 16, small=8, passes=passes, whole=6, heavy=heavy).collect()}
    assert found == {i: i // 2 * 2 for i in range(60)}


def test_trees_hold_recall_at_every_depth():
    """A walk of pairs that agree at 0.8 of all positions, and the calculation that trees are counted by."""
    rng = np.random.default_rng(3)
    n, depth = 2000, 9
    least = rng.integers(0, 1 << 32, (n, 64), np.uint32)
    other = np.where(rng.random((n, 64)) < 0.8, least, rng.integers(0, 1 << 32, (n, 64), np.uint32))
    met = np.zeros(n, bool)
    for tree in range(1, 9):
        root = np.full(n, neardup.mixed(np.array([tree], shingles.U))[0])
        (a, i), (b, j) = (neardup.walk(root, np.arange(n), x, depth) for x in (least, other))
        met[[r for r, _ in set(zip(i.tolist(), a.tolist(), strict=True)) & set(zip(j.tolist(), b.tolist(), strict=True))]] = True
    assert (~met).mean() <= 1.3 * neardup.missed(0.8, depth, 8, 64)
    for deep in range(3, 28, 3):
        assert neardup.missed(0.8, deep, 16, 64) * neardup.missed(0.8, deep, neardup.further(0.8, deep, 16), 192) <= neardup.MISS


def test_blocks_of_a_node_hold_every_pair(spark):
    rows = spark.range(200).select(F.lit(7).cast("long").alias("node"), "id", F.lit(200).cast("long").alias("size"), F.col("id").alias("label"))
    sets = {}
    for r in neardup._blocks(rows, 32).collect():
        sets.setdefault(r.node, set()).add(r.id)
    assert max(map(len, sets.values())) < 64
    assert len({(a, b) for s in sets.values() for a in s for b in s if a < b}) == 200 * 199 // 2


def test_near_duplicates_of_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert by_id(neardup.near_duplicates(df))[None].component_id is None and by_id(neardup.near_duplicates(df))[5].component_id == 3
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5), (None, 3)], "a long, b long")
    found = {r.id: r.label for r in components.components(links).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[901] == 900


def test_words_over_buffers(monkeypatch):
    texts = ["Alpha beta\tgamma", None, "é " * 50, "long" * 40 + " word tail", "A"]
    whole, counts, _ = shingles.words_of(texts)
    monkeypatch.setattr(shingles, "BUFFER", 16)
    again, counts2, _ = shingles.words_of(texts)
    assert counts.tolist() == counts2.tolist() == [len(WORD.findall(t or "")) for t in texts] and (whole == again).all()


# --- 7


def test_rule_statistics_equal_brute_force(spark):
    rng = random.Random(11)
    texts = [*ODD, *("".join(rng.choice(["a ", "b ", "c#\n", "a b c d e ", "\n", "line one\n", "$ "]) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    found = by_id(rules.apply(docs(spark, texts), []))
    for i, t in enumerate(texts):
        w, t = WORD.findall(t or ""), t or ""
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {p for k, x in enumerate(windows) if windows.count(x) > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) == (not r.kept)


def test_rules_find_the_threshold(spark):
    rng = random.Random(12)
    texts = [" ".join(("w%d%s" % (rng.randint(0, 9999), "#" if i % 4 == 0 else "")) for _ in range(30)) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    learned = rules.learn(docs(spark, texts), labels)
    assert {c.statistic for r in learned for c in r} <= {"symbol_share", "word_length"}, learned
    kept = {i for i, r in by_id(rules.apply(docs(spark, texts), learned)).items() if r.kept}
    assert kept == {i for i in range(200) if i % 4}
    assert rules.learn(docs(spark, texts), labels.limit(0)) == []


def test_few_labels_still_give_rules_beyond_the_base():
    """Twenty bad of two hundred, by a cell each; a beginning that fails on the pruning rows gives way to another."""
    cell = lambda bins, bad, prune, n=1: (bins, *(n if (k == 0) == bad and p == prune else 0 for p in (False, True) for k in (0, 1)))
    few = [cell((1, 0), True, False, 4), cell((1, 0), True, True, 2), cell((0, 0), False, False, 60), cell((0, 0), False, True, 30)]
    assert rules.cover(few, [1, 1]) == [[(0, True, 0)]]
    fails = [cell((1, 0), True, False, 4), cell((1, 0), False, True, 9), cell((0, 1), True, False, 3), cell((0, 1), True, True, 2), cell((0, 0), False, False, 60), cell((0, 0), False, True, 30)]
    assert rules.cover(fails, [1, 1]) == [[(1, True, 0)]]
    assert rules.cover([], [1, 1]) == [] and rules.cover([cell((0, 0), False, False, 5)], [1, 1]) == []


def test_rules_of_odd_tables(spark):
    df = docs(spark, ["a b c d e f g h i j", None, "", "x" * 400_000, "w " * 60_000])
    labels = spark.createDataFrame([(0, 1, "s"), (0, 1, "s"), (1, 0, "s"), (None, 0, "s"), (3, None, "s")], "doc_id long, quality int, text string")
    found = by_id(rules.apply(df, rules.learn(df, labels)))
    assert [found[i].base_failed for i in range(5)] == [False, True, True, True, True] and found[4].n_repeat_words == 60_000
    assert rules.apply(df.unionByName(df), []).count() == 10 and rules.apply(df.limit(0), []).count() == 0 and rules.learn(df.limit(0), labels) == []


# --- 8


def test_personal_data_base_and_field(spark):
    texts = [*ODD, "mail a.b+c@ex-ample.co.uk, 10.0.0.256 10.0.0.25 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111 1111 1111 1112 +49 (30) 1234-5678x +1 2", "x@y", "00010.1.1.1 é +123456789012345678"]
    found = by_id(pii.scan(docs(spark, texts), pii.learn(docs(spark, texts))))
    want = {9: "email:5:25,ip:38:47,ip:48:55", 10: "card:5:24,phone:49:67"}
    for i, spans in want.items():
        assert found[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest(), (i, pii.named(pii.base_spans(texts[i])))
        assert set(spans.split(",")) <= set(found[i].spans.split(","))
    assert (found[9].n_email, found[9].n_ip, found[10].n_card, found[10].n_phone) == (1, 2, 1, 1)
    assert pii.scan(docs(spark, texts).limit(0), pii.learn(docs(spark, texts).limit(0))).count() == 0


def base_personal(t):
    """The contract's patterns as they stand."""
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    fits = [lambda m: True, lambda m: all(int(p) <= 255 for p in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, rx in enumerate((email, ip, card, phone)) for m in rx.finditer(t) if fits[k](m)]


def test_personal_base_equals_the_patterns():
    rng = random.Random(15)
    parts = ["a", "b@", "@", ".", "1", "22", "255", ".1", ".2.3", "@x.y", "+1", " ", "-", "(", ")", "4111111111111111", "é", "_", "0"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == base_personal(t), t


def test_personal_data_in_very_long_texts_without_blanks(spark):
    field = pii.learn(docs(spark, ["mail a.b@c.de now"]))
    texts = ["0" * 5000 + "1.1.1.1", *(x * (1_000_000 // len(x)) for x in ("中", "a", "1", "1.", "a@", "a.b@c-", "é%+1("))]
    began = time.time()
    found = by_id(pii.scan(docs(spark, texts), field))
    assert time.time() - began < 60 and len(found) == len(texts)
    assert (found[0].n_ip, found[0].spans) == (1, "ip:0:5007") and [found[i].n_spans for i in (1, 2, 3)] == [0, 0, 0]


def personal_texts(rng, n):
    """Prose with values that the patterns find."""
    word = lambda: "".join(rng.choice("abdegilmnorstu") for _ in range(rng.randint(2, 8)))
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = lambda: next(x for x in iter(lambda: "4" + d(15), "") if pii.luhn(x))
    makers = [lambda: f"{word()}.{d(2)}@{word()}{d(1)}.example.com", lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: pii.noise(rng)]
    return [" ".join(x for _ in range(rng.randint(1, 4)) for x in (*(word() for _ in range(12)), rng.choice(makers)(), word())) for _ in range(n)]


def test_field_finds_planted_values_that_the_patterns_miss(spark):
    rng = random.Random(16)
    field = pii.learn(docs(spark, personal_texts(rng, 600)))
    tests = [pii.varied(t, pii.base_spans(t), rng) for t in personal_texts(rng, 300)]
    found = by_id(pii.scan(docs(spark, [t for t, _ in tests]), field))
    planted = right = wrong = 0
    for i, (t, spans) in enumerate(tests):
        base = pii.base_spans(t)
        touch = lambda a, b: a[1] < b[2] and b[1] < a[2]
        missed = [s for s in spans if not any(touch(s, b) for b in base)]
        got = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in found[i].spans.split(",") if x)]
        assert set(base) <= set(got) and found[i].n_added == len(got) - len(base) and found[i].n_spans == len(got)
        own = [s for s in got if s not in base]
        planted += len(missed)
        right += sum(any(s[0] == m[0] and touch(s, m) for s in own) for m in missed)
        wrong += sum(not any(s[0] == m[0] and touch(s, m) for m in spans) for s in own)
    assert planted > 100 and right >= 0.7 * planted and wrong <= 0.03 * right, (planted, right, wrong)
    clean = by_id(pii.scan(docs(spark, [f"{pii.noise(rng)} is no one's, and {pii.noise(rng)} neither" for _ in range(200)]), field))
    assert sum(r.n_added for r in clean.values()) <= 4


def test_what_one_mention_shows_reaches_its_repeats():
    """A value that is plain at its first mention lifts all later ones, forty of them too, by their shared hub."""
    field = pii.Field(np.zeros((pii.WIDTH, 5)), np.zeros((5, 5)), 3.0 * np.eye(5), np.zeros((5, 5)))
    g = pii.graph(["call 030.555.7713 now " + "then 030 555 7713 again " * 40], [[]])
    g.x[:] = 0
    g.x[0, 0] = 1
    field.unary[0, 4] = 6.0
    alone = pii.marginals(pii.Graph(g.owner, g.spans, g.x, g.y, g.chain, g.same[:0], g.alike[:0]), field)
    shared = pii.marginals(g, field)
    assert len(g.y) == 41 and np.allclose(alone[1:, 4], 0.2) and (shared[1:, 4] > 0.5).all() and np.allclose(shared[1:, 4], shared[1, 4], atol=0.02)


def test_messages_equal_exact_marginals_on_a_tree():
    rng = np.random.default_rng(0)
    k = len(pii.KINDS) + 1
    sym = lambda: (lambda m: m + m.T)(rng.normal(size=(k, k)))
    field = pii.Field(np.eye(k), sym(), sym(), sym())
    g = pii.Graph(np.zeros(3), [(0, 1)] * 3, rng.normal(size=(3, k)), np.zeros(3, int), np.array([[0, 1]]), np.array([[1, 3], [2, 3]]), np.zeros((0, 2), int), 1)
    joint = np.exp(g.x[0][:, None, None, None] + g.x[1][None, :, None, None] + g.x[2][None, None, :, None] + field.chain[:, :, None, None] + field.same[None, :, None, :] + field.same[None, None, :, :])
    want = joint.sum(axis=(0, 1, 3)) / joint.sum()
    assert np.allclose(pii.marginals(g, field)[2], want, atol=2e-3)


# --- 9


def test_classifier_held_out(spark):
    rng = random.Random(13)
    texts = [" ".join(rng.choices(["fine", "clear", "text", "reads", "well"] if i % 3 else ["BUY!!", "NOW##", "$$$", "win"], k=25)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)] + [(None, 1)], "doc_id long, quality int")
    weights = quality.learn(docs(spark, texts), labels)
    found = by_id(quality.score(docs(spark, texts), weights))
    out = [i for i, r in found.items() if r.held_out]
    assert np.mean([found[i].predicted == int(i % 3 != 0) for i in out]) > 0.95
    odd = by_id(quality.score(docs(spark, ODD), weights))
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[0].score == odd[1].score
    assert quality.score(docs(spark, ["a"]), quality.learn(docs(spark, texts), labels.limit(0))).first().score == 0.5


# --- all of them


#: Names that operators use inside, or give to their results.
CLASHING = ["id", "row", "base", "own", "live", "n", "label", "sig", "marks", "t", "i", "b", "h", "w", "s", "x", "text_key", "doc", "owner", "repo", "words", "score", "held_out", "kept", "rule", "n_words", "start", "length", "spans", "row_key", "item", "node", "part", "before", "ids", "digest", "payload", "uri", "best", "rep", "component_id", "n_tokens", "lang_pred", "predicted", "_gone_id", "two words", "a.b"]


def every_operator(spark):
    """Name -> what it makes of documents, with models learned beforehand, and whether each row gives one."""
    rng = random.Random(22)
    langs = [rng.choice(["en", "de", "fr"]) for _ in range(40)]
    plain = docs(spark, [f"{prose(rng, x, 20)} mail a.{i}@b.de" for i, x in enumerate(langs)], langs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    bench = spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string")
    models, listed, field, weights = langid.learn(plain), rules.learn(plain, labels), pii.learn(plain), quality.learn(plain, labels)
    return {
        "warc": (lambda df: warc.pages_through_archives(df.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))), True),
        "decontamination": (lambda df: decontam.contained(df, bench), False),
        "secrets": (secrets.scan, True),
        "language": (lambda df: langid.predict(df, models), True),
        "tokens": (tokens.count_tokens, True),
        "duplicates": (neardup.near_duplicates, True),
        "rules": (lambda df: rules.apply(df, listed), True),
        "personal": (lambda df: pii.scan(df, field), True),
        "quality": (lambda df: quality.score(df, weights), True),
        "packing": (lambda df: packing.pack(df, length=16).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct(), False),
        "bpe": (bpe.round_trip, True),
        "divergence": (divergence.audit, False),
        "merkle": (lambda df: merkle.manifest(df if "n_chars" in df.columns else df.withColumn("n_chars", F.lit(1))), True),
    }


def test_clashing_columns_repeated_rows_and_empty_tables_change_nothing(spark):
    texts = ["one two three four five six seven", "one two three four five six seven", "password: hunter2", None, "", "\n", "12 34", "x" * 3000, "mail a.b@c.de or 1.2.3.4"]
    rows = [(i if i != 6 else None, t, "en", "s") for i, t in enumerate(texts)]
    rows += [rows[2], rows[3], (8, "another text of the same id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clashing = df.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHING)))
    for name, (operator, row_for_row) in every_operator(spark).items():
        plain, extra = operator(df), operator(clashing)
        found = sorted(map(str, plain.collect()))
        assert found == sorted(map(str, extra.select(plain.columns).collect())), name
        assert not row_for_row or len(found) == len(rows), name
        empty = operator(clashing.limit(0))
        assert empty.columns == plain.columns and empty.count() == 0, name


def test_one_very_long_text(spark):
    """Four million characters of words, most lines alike: every operator ends, and counts come out exactly."""
    line = "the quick brown fox jumps over the lazy dog near the river bank today\n"
    long = line * 30_000 + " ".join(f"w{i}" for i in range(300_000))
    began, found = time.time(), {}
    df = docs(spark, [long, "short"])
    for name, (operator, _) in every_operator(spark).items():
        found[name] = {r[0]: r for r in operator(df).collect()}
    n = len(WORD.findall(long))
    assert found["rules"][0].n_words == n and found["rules"][0].n_dup_lines == 29_999
    assert found["tokens"][0].n_bytes == len(long) and found["tokens"][0].n_tokens == found["packing"][0].doc_tokens - 1
    assert found["duplicates"][0].n_shingles == len({tuple(w) for w in zip(*(low(long)[k:] for k in range(5)), strict=False)})
    assert found["bpe"][0].decoded_sha256 == hashlib.sha256(long.encode()).hexdigest() and found["merkle"][0].leaf == hashlib.sha256(f"1:02:s02:en1:0{len(long)}:{long}".encode()).hexdigest()
    assert found["warc"][0].payload_bytes == len(long) and found["warc"][0].payload_digest == hashlib.sha1(long.encode()).hexdigest()
    assert time.time() - began < 300


# --- pipeline


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(14)
    clean = [prose(rng, "en", 5) + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(12)]
    item = " ".join(f"b{i}" for i in range(20))
    live = "Mn1Bv2Cx3Zl4Kj5Hg6Fd7"
    texts = [*clean, clean[0], clean[1] + " tail", clean[2] + " " + item, f"{clean[3][::-1]} {live}", None, "12 34"]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(out := scratch(spark, "test"))
        now = spark.read.parquet(out)
        kept.append((name, now.count()))
        if name != "packing":
            assert set(now.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
            last = by_id(now)
    assert [n for _, n in kept[:4]] == [16, 14, 13, 13] and set(last) == {0, 1, *range(3, 12), 2, 15} and live not in last[15].text
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(last)


def test_filtering_stages_judge_rows_that_repeat_an_id_by_their_texts(spark, tmp_path):
    rng = random.Random(21)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(4))
    item = " ".join(f"b{i}" for i in range(20))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, a, "k1"), (5, a, "k2"), (5, b, "k3"), (5, b, "k3"), (6, f"{c} {item}", "k4"), (6, d, "k5"), (None, item, "k6"), (None, None, "k7"), (8, None, "k8"), (9, "", "k9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key string")
    deduped = corpus_pipeline.one_of_each_group(spark, df, str(tmp_path))
    assert sorted(r.text_key for r in deduped.collect()) == ["k1", "k3", "k3", "k4", "k5", "k6", "k7", "k8", "k9"]
    clean = corpus_pipeline.without_benchmark(spark, df, str(tmp_path))
    assert sorted(r.text_key for r in clean.collect()) == ["k1", "k2", "k3", "k3", "k5", "k7", "k8", "k9"]
    for stage in (corpus_pipeline.one_of_each_group, corpus_pipeline.without_benchmark):
        assert stage(spark, df.limit(0), str(tmp_path)).columns == df.columns and stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_arrow_node_groups_cross_batches():
    t = pa.table({"node": [1, 1, 2, 3, 3, 3], "id": [1, 2, 3, 4, 5, 6], "own": [b"a", b"b", b"c", b"d", b"e", b"f"]})
    groups = [g[0].tolist() for g in neardup._nodes(iter(t.to_batches(max_chunksize=2)), ["id"], "own")]
    assert groups == [[1, 2], [4, 5, 6]]
    assert F is not None
