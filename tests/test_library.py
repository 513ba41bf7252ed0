"""The library's own cases as small rows, and property tests against plain Python."""

import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docverify.functions import matching
from docverify.functions.text import normalize_ws, slot_key
from docverify.operators import anchors, conventions, curation, decisions, integrity, ledger, manifest, review, structure, verify
from docverify.operators import graph
from docverify.operators.graph import classes, followed, levels, on_cycles, with_cycles
from docverify.sources import corpus
from docverify.streaming import streams


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sections_ignore_fences_and_join_back(spark):
    text = "intro\n# One #\nbody\n```\n# no\n```\n   # C#\r\nx\n    # code\n~~~\n# no\n~~~\nend"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "# a")], "doc_id int, text string")
    found = structure.sections(docs).orderBy("doc_id", "section_idx").collect()
    assert [(r.doc_id, r.title) for r in found] == [(1, None), (1, "One"), (1, "C#"), (4, "a")]
    assert "".join(r.block for r in found if r.doc_id == 1) == text


def test_lines_are_those_of_splitlines(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "b ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = structure.lines(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "eol"))).alias("l")).collect()
    by = {r.doc_id: r.l for r in found}
    for i, t in enumerate(texts):
        assert [x.line for x in by.get(i, [])] == t.splitlines()
        assert "".join(x.line + x.eol for x in by.get(i, [])) == t


def test_blockquotes_merge(spark):
    docs = spark.createDataFrame([(1, "> a\n> b\n\ntext\n```\n> no\n```\n   > c\n    > code\n>\n")], "doc_id int, text string")
    assert got(structure.blockquotes(docs), "quote_idx", "quote") == [(1, "a b"), (2, "c")]


def test_fences_and_quotes_equal_a_plain_walk(spark):
    rng = random.Random(11)
    made = ["\n".join(rng.choice(["```", " ~~~ x", "> q", ">", "   > r ", "# T", "text", "", "    > code"]) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    fences, quotes = [], []
    for i, t in enumerate(made):
        inside, group = False, []
        found = []
        for n, line in enumerate(t.splitlines(), 1):
            fence = line.strip().startswith(("```", "~~~"))
            inside ^= fence
            fences.append((i, n, line, fence, fence or inside))
            if not (fence or inside) and re.match(r" {0,3}>", line):
                group.append(re.sub(r"^\s{0,3}>\s?", "", line))
            else:
                found, group = [*found, group], []
        kept = [q for g in [*found, group] if (q := " ".join(g).strip())]
        quotes += [(i, n, q) for n, q in enumerate(kept, 1)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id int, text string")
    assert got(structure.fence_state(docs), "doc_id", "line_no", "line", "is_fence", "in_fence") == sorted(fences)
    assert got(structure.blockquotes(docs), "doc_id", "quote_idx", "quote") == sorted(quotes)


def test_white_space_and_slot_keys(spark):
    row = spark.createDataFrame([("a  b\n c\t d", "Café  SLOT É")], "a string, b string").select(normalize_ws(F.col("a")), slot_key(F.col("b"))).first()
    assert tuple(row) == ("a b c d", "café slot É")


def test_unstable_ids(spark):
    cases = {
        "blank_id": ["", " ", "\u3000", "\n\t"], "space_in_id": ["a b", " a", "a\u00a0", "a\u2028b", "ok\n"], "slash_in_id": ["a/b", "/"],
        "invisible_in_id": ["a\u200bb", "a\U000e0100", "a\ufff0", "a\u2065b", "a\U000e0fff", "k\u3164", "k\u115f", "\ufeffk", "k\u00ad", "a\x07"], "no_base_character": ["\u0301", "\u20dd\u0903", "\ue000", "\u0378", "\U000f0000"],
        None: ["ok", "-1", "\u0301a", "a\u0301", "a\ue000", "a\u0378", "中", "\U0001f600", "é_", "k\U0001d172"],
    }
    rows = [(rule, v) for rule, values in cases.items() for v in values]
    found = structure.unstable_ids(spark.createDataFrame(rows, "k string, id string"), ["k"], ["id"]).collect()
    rules = {}
    for r in found:
        rules.setdefault((r.k, r.subject), set()).add(r.rule)
    assert all(rule in rules[rule, v] for rule, v in rows if rule) and not any(k is None for k, _ in rules)
    assert {v: r - {"space_in_id"} for (k, v), r in rules.items() if k == "invisible_in_id"} == {v: {"invisible_in_id"} for v in cases["invisible_in_id"]}
    details = {r.subject: r.detail for r in found if r.rule == "invisible_in_id"}
    assert details["a\u200bb"] == "U+200B" and details["a\U000e0100"] == "U+E0100" and details["a\x07"] == "U+0007"


def test_items_beyond_the_ninety_ninth_keep_their_order(spark):
    rows = [(1, "pm", n, f"1/pm/{n:02d}", "s", "c", "q" if n != 5 else " ", "none", ["a"]) for n in range(1, 103)]
    items = spark.createDataFrame(rows, "run_id long, perspective string, item_no long, item_id string, target_section string, consideration string, human_question string, human_need string, evidence_refs array<string>")
    sections, files = spark.createDataFrame([(1, "s", 0)], "run_id long, section string, pos int"), spark.createDataFrame([(1, "a")], "run_id long, path string")
    assert got(curation.envelope_violations(items, sections, files), "rule", "subject") == [("human_question_blank", "1/pm/05")]


def test_dictionaries_with_blank_entries(spark):
    rows = [(1, "good", ["bad", " "], None, None), (1, "fine", ["poor"], ["poorly", ""], "x"), (1, "kept", ["keep"], ["keeper"], " "), (2, "a", None, None, None), (2, None, ["z"], ["q"], None)]
    terms = spark.createDataFrame(rows, "k int, canonical string, forbidden array<string>, excepted array<string>, note string")
    found = got(verify.term_dictionary_violations(terms, ["k"]).na.fill("-"), "k", "rule", "subject")
    assert found == [(1, "exception_blank", "fine"), (1, "forbidden_blank", "good"), (1, "note_blank", "kept"), (2, "canonical_missing", "-"), (2, "exception_useless", "-"), (2, "forbidden_empty", "a")]
    meta = spark.createDataFrame([(1, "t", "2024-01-02", 3), (2, " ", "2024-1-02", 0), (3, None, None, None), (4, "t", "2024-01-02\n", 1)], "k int, target string, updated_at string, n_terms long")
    every = ["date_malformed", "target_missing", "terms_empty"]
    assert got(verify.dictionary_meta_violations(meta, ["k"]), "k", "rule") == [(k, r) for k in (2, 3) for r in every] + [(4, "date_malformed")]


def test_scan_hits_ask_for_anchors(spark):
    reports = spark.createDataFrame([(1, "HIT line 12 x\nHIT line 7\nHIT line 12\nHIT line 123456, xHIT line 33"), (2, None)], "run_id int, text string")
    assert got(anchors.scan_anchors(reports, ["run_id"]), "run_id", "anchor") == [(1, "L12")]


def test_verbatim_equals_the_nested_loop(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "de", "e", "zeta eta", "theta"]
    sources = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(12)]
    quotes = [s[a : a + rng.randint(1, 40)] for s in sources for a in [rng.randint(0, max(0, len(s) - 5))] for _ in range(3)] + ["", "  ", "nothing like it here", "alpha beta zz qq xx yy ww"]
    norm = lambda t: re.sub(r"\s+", " ", t).strip()

    def expect(q):
        n = norm(q)
        for verdict, part in (("FULL", n), ("PARTIAL", n[: max(8, int(len(n) * 0.6))])):
            for label, s in enumerate(sources[1:], 1):
                if n and part in norm(s):
                    return verdict, str(label)
        return "MISS", None

    q = spark.createDataFrame([(0, i, t) for i, t in enumerate(quotes)], "doc_id int, quote_idx int, quote string")
    s = spark.createDataFrame([(0, i, str(i), None if i == 0 else t) for i, t in enumerate(sources)], "doc_id int, source_ord int, label string, text string")
    matches = verify.verbatim_match(q, s)
    assert {r.quote_idx: (r.verdict, r.label) for r in matches.collect()} == {i: expect(t) for i, t in enumerate(quotes)}
    row = verify.verbatim_summary(matches, s).first()
    assert (row.n_declared, row.n_missing, row.blind) == (12, 1, False)


def test_quotes_are_read_for_once_or_by_keys_with_the_same_rows(spark, tmp_path, monkeypatch):
    """One pass over the sources, keys of the sources, and an index with all kinds of keys, some or none agree with plain Python; white space is what normalize_ws takes."""
    every = "".join(f"a{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert spark.createDataFrame([(every,)], "t string").select(normalize_ws(F.col("t"))).first()[0] == " ".join(every.split())
    rng = random.Random(5)
    texts = [f"{chr(0x2003)}".join(rng.choices("ab cd ef gh \u00e4\u00f6 \U0001f600x".split(), k=60)) for _ in range(40)] + ["", None]
    whole = [t and " ".join(t.split()) for t in texts]
    quotes = [" ".join(whole[i].split()[k : k + n]) for i, k, n in ((0, 0, 30), (7, 20, 30), (9, 5, 9), (3, 3, 4), (12, 1, 2), (30, 9, 1))] + [whole[4][:70] + " zz zz", "none of it", " ", "ef"]
    q = spark.createDataFrame([(d, i, t) for d in (0, 1) for i, t in enumerate(quotes)], "doc_id int, quote_idx int, quote string")
    s = spark.createDataFrame([(0, i, str(i), t) for i, t in enumerate(texts)] + [(0, None, "x", texts[0])], "doc_id int, source_ord int, label string, text string")
    cut = lambda n: n[: max(8, int(len(n) * 0.6))]
    first = lambda part: next((str(i) for i, t in enumerate(whole) if part and t and part in t), None)

    def expect(n):
        return ("FULL", first(n)) if first(n) else ("PARTIAL", first(cut(n))) if first(cut(n)) else ("MISS", None)

    want = sorted([(0, i, *expect(" ".join(t.split()))) for i, t in enumerate(quotes)] + [(1, i, "MISS", None) for i in range(len(quotes))], key=str)
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "quote_idx", "verdict", "label").collect()), key=str)
    place = f"file://{tmp_path}/index"
    verify.write_index(s, place, (verify.RUN,))
    assert rows(verify.verbatim_match(q, index=place, kinds={verify.RUN})) == rows(verify.verbatim_match(q, index=place, kinds={verify.RUN}, chars=0)) == want
    verify.write_keys(spark, place, 3)
    assert rows(verify.verbatim_match(q, index=place, kinds={verify.RUN, 3})) == want
    monkeypatch.setattr(verify, "_keyed", None)  # few quotes need no keys of the sources
    assert rows(verify.verbatim_match(q, s)) == want
    monkeypatch.undo()
    assert rows(verify.verbatim_match(q, s, chars=0)) == want


def test_a_quote_of_common_words_meets_few_sources(spark, tmp_path):
    """Every word, pair of words and run of three is in many sources; the quotes' own order is in one or two."""
    rng = random.Random(12)
    words = ["the", "of", "and", "to", "in", "a"]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(300)]
    quotes = [" ".join(texts[i].split()[k : k + 40]) for i, k in ((3, 0), (70, 100), (299, 360))] + [" ".join(rng.choices(words, k=40)), " ".join(texts[5].split()[50:60]), "of the"]
    q = spark.createDataFrame([(0, i, t) for i, t in enumerate(quotes)], "doc_id int, quote_idx int, quote string")
    s = spark.createDataFrame([(0, i, str(i), t) for i, t in enumerate(texts)], "doc_id int, source_ord int, label string, text string")
    own = verify._quotes(q)
    assert [r.run for r in own.orderBy("quote_idx").collect()] == [5] * 4 + [3, None]
    met = verify._candidates(own.where("run = 5"), s.withColumnRenamed("text", "ns")).count()
    assert met < 150  # of 1,200 pairs, all of which share each word
    found = {r.quote_idx: (r.verdict, r.label) for r in verify.verbatim_match(q, s).collect()}
    # an index of the sources gives the same, and a batch of one quote reads few of its parts
    verify.write_index(s, f"file://{tmp_path}/index")
    assert {r.quote_idx: (r.verdict, r.label) for r in verify.verbatim_match(q, index=f"file://{tmp_path}/index").collect()} == found
    one = verify.verbatim_match(q.where("quote_idx = 0"), index=f"file://{tmp_path}/index")
    assert one.first().label == "3" and re.search(r"PartitionFilters: \[[^\]]*part#", one._jdf.queryExecution().toString())
    first = lambda t: next((str(i) for i, x in enumerate(texts) if t in x), None)
    assert found == {i: ("FULL", first(t)) if first(t) else ("MISS", None) for i, t in enumerate(quotes)}
    assert verify.verbatim_match(q.limit(0), s).count() == 0 and verify.verbatim_match(q.where("quote_idx < 0").union(spark.createDataFrame([(0, 9, " ")], q.schema)), s).first().verdict == "MISS"


def test_term_scan_equals_a_plain_scan(spark):
    terms = [("und", ["and"], ["hand", "land"]), ("x", ["aa"], []), ("y", ["na"], ["banana"])]
    lines = ["hand and land and", "aaaa", "banana na ana", "", "sand handand"]

    def spans(line, part):
        return [i for i in range(len(line) - len(part) + 1) if line.startswith(part, i)]

    want = []
    for n, line in enumerate(lines, 1):
        for c, forbidden, excepted in terms:
            allowed = [(a, a + len(e)) for e in excepted for a in spans(line, e)]
            want += [(n, v, c, a) for v in forbidden for a in spans(line, v) if not any(x <= a and a + len(v) <= y for x, y in allowed)]
    rows = spark.createDataFrame([(1, n, t) for n, t in enumerate(lines, 1)], "doc_id int, line_no int, line string")
    dictionary = spark.createDataFrame(terms, "canonical string, forbidden array<string>, excepted array<string>")
    assert got(verify.term_scan(rows, dictionary), "line_no", "variant", "canonical", "offset") == sorted(want)
    assert verify.term_dictionary_violations(dictionary.withColumn("k", F.lit(1)), ["k"]).count() == 0


def test_anchor_boundaries(spark):
    df = spark.createDataFrame([(1, "L12 L1 L1-24 L99-1 xL22 L123456 A0123456789ab A0123456789abc REQ-7")], "k int, text string")
    assert got(anchors.anchors(df, ["k"], extra=(r"REQ-\d+",)), "anchor") == [("A0123456789ab",), ("L12",), ("REQ-7",)]


def test_graphs(spark):
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(60)] + [(2, 1, 2), (2, 2, 3), (2, 3, 2)], "k int, a int, b int")
    assert got(on_cycles(chain, ["k"], "a", "b"), "k", "node") == [(2, 2), (2, 3)]
    ends = {(r.k, r.a): r.root for r in followed(chain.where("k = 1"), ["k"], "a", "b").collect()}
    assert ends[(1, 0)] == 60 and len(ends) == 60
    pairs = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 7, 9), (2, 1, 5)], "k int, a int, b int")
    assert got(classes(pairs, ["k"], "a", "b"), "k", "node", "label") == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 7, 7), (1, 9, 7), (2, 1, 1), (2, 5, 1)]


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    rounds, write = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or write(df))
    rows = [(1, i, i + 1) for i in range(2000)] + [(2, i, (i + 1) % 500) for i in range(500)] + [(2, 499, 1000), (2, 2000, 0), (3, 1, 1), (3, 1, 2)]
    chain = spark.createDataFrame(rows, "k int, a int, b int")
    assert got(on_cycles(chain, ["k"], "a", "b"), "k", "node") == [(2, i) for i in range(500)] + [(3, 1)]
    nodes = chain.select("k", "a").union(chain.select("k", "b")).distinct()
    found = {(r.k, r.node): r.level for r in levels(chain, nodes, ["k"], "a", "b").collect()}
    assert found == {**{(1, i): 2000 - i for i in range(2001)}, (2, 1000): 0, (3, 2): 0}
    assert len(rounds) < 300


def test_nodes_of_shortened_chains_on_a_cycle_need_no_join_when_read(spark, monkeypatch):
    monkeypatch.setattr(graph, "PEEL", 1)
    edges = spark.createDataFrame([(1, i, (i + 1) % 20) for i in range(20)] + [(1, 20 + i, 21 + i) for i in range(8)] + [(1, 0, 50), (1, 50, 1)], "k int, a int, b int")
    found = on_cycles(edges, ["k"], "a", "b")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert got(found, "k", "node") == [(1, i) for i in [*range(20), 50]]


def test_levels_and_cycles_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(graph, "PEEL", 1)
    rng, rows = random.Random(9), []
    for k in range(12):
        n = rng.randint(5, 25)
        rows += [(k, a, b) for a, b in {(rng.randrange(n), rng.randrange(n)) for _ in range(n)} if k % 2 or a < b]
    want, high = set(), {}
    for k in range(12):
        own = {(a, b) for q, a, b in rows if q == k}
        left = set(own)
        while True:
            into, out = {b for _, b in left}, {a for a, _ in left}
            rest = {(a, b) for a, b in left if a in into and b in out}
            if rest == left:
                break
            left = rest
        want |= {(k, a) for a, _ in left}
        level = {n: 0 for e in own for n in e if all(a != n for a, _ in own)}
        while new := {n: 1 + max(level[b] for a, b in own if a == n) for n, _ in own if n not in level and all(b in level for a, b in own if a == n)}:
            level |= new
        high |= {(k, n): v for n, v in level.items()}
    edges = spark.createDataFrame(rows, "k int, a int, b int")
    assert set(got(on_cycles(edges, ["k"], "a", "b"), "k", "node")) == want
    nodes = edges.select("k", "a").union(edges.select("k", "b")).distinct()
    assert {(r.k, r.node): r.level for r in levels(edges, nodes, ["k"], "a", "b").collect()} == high


DECISION = "registry_id int, id string, decision string, status string, date string, evidence string, subject string, supersedes string, superseded_by string, source_ref string, source_hash string"


def test_decisions(spark):
    rows = [
        (1, "a", "d", "confirmed", "2024-01-02", "e", "Slot", None, None, None, None), (1, "b", "d", "confirmed", "2024-01-01", "e", "slot", "a", None, None, None),
        (2, "a", "d", "confirmed", "2024-01-01", "e", "s", None, None, None, None), (2, "b", "d", "confirmed", "2024-01-01", "e", "s", None, None, None, None),
        (3, "a", "d", "confirmed", "2024-01-01", "e", "s", None, "b", None, None), (3, "b", "d", "rejected", "2024-01-01", "e", "s", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DECISION)
    edges = decisions.supersede_edges(df)
    judged = {(r.registry_id, r.old): (r.reason, r.date_inverted) for r in decisions.judged_edges(edges, df).collect()}
    assert judged == {(1, "a"): (None, True), (3, "a"): ("unconfirmed", False)}
    honored = decisions.honored_edges(edges, df)
    assert got(decisions.slot_conflicts(df, honored), "registry_id", "n") == [(2, 2)]
    verdicts = decisions.registry_verdict(df, decisions.all_findings(df, edges, honored))
    assert got(verdicts, "registry_id", "verdict") == [(1, "pass"), (2, "fail"), (3, "pass")]
    assert got(decisions.eligible_decisions(df, honored, verdicts), "registry_id", "id") == [(1, "b")]


def test_a_registry_is_examined_in_one_pass(spark, monkeypatch):
    rng, rows = random.Random(21), []
    pick = lambda *a: rng.choice(a)
    for registry in [*range(40), None]:
        n = 40 if registry in (3, 4) else rng.randint(1, 9)
        for _ in range(n):
            to = lambda: pick(None, None, None, " ", "gone", *(f"i{rng.randrange(n)}" for _ in range(3)))  # noqa: B023, E731
            rows.append((
                registry, pick(None, *(f"i{rng.randrange(n)}" for _ in range(9))), pick("d", "d", ""), pick("confirmed", "confirmed", "confirmed", "rejected", "do_not_reopen", "maybe", None), pick("2024-01-01", "2024-01-02", "1 May", None),
                "e", pick(None, " ", "S", "s", "S  t", "cafe\u0301", "caf\u00e9"), to(), to(), pick(None, "a.md"), pick(None, "a" * 64, "abc"),
            ))
    df = spark.createDataFrame(rows, DECISION)
    edges = decisions.supersede_edges(df)
    honored = decisions.honored_edges(edges, df)
    text = lambda f: sorted(map(str, f.collect()))
    found = decisions.all_findings(df, edges, honored)
    want, judged = text(found), text(decisions.judged_edges(edges, df))
    eligible = text(decisions.eligible_decisions(df, honored, decisions.registry_verdict(df, found)))
    assert len({r.rule for r in found.collect()}) > 14
    for most in (100_000, 20, 0):  # whole registries, some by id, all by id
        own = decisions.stored(decisions.examined(df, most))
        cards = own.where("field is null")
        assert text(decisions.registry_findings(own)) == want
        assert text(decisions.own_edges(own)) == judged
        assert text(decisions.eligible_decisions(cards, decisions.own_edges(own).where("reason is null"), decisions.registry_verdict(cards, decisions.registry_findings(own)))) == eligible
        assert cards.count() == len(rows)
    monkeypatch.setattr(decisions, "kept", lambda f: f.limit(0))
    assert decisions.examined(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_eligible_decisions_are_told_by_their_own_rows(spark):
    row = lambda r, i, status="confirmed", slot="s", old=None, by=None: (r, i, "d", status, "2024-01-01", "e", slot, old, by, None, None)
    rows = [
        row(1, "a"), row(1, "b", old="a"), row(1, "c", "do_not_reopen", "t"), row(1, "d", slot="u", by="c"), row(1, "e", "rejected"), row(2, "a"), row(2, "b"), row(2, None), row(3, "a"), row(3, "b", "rejected", old="a"),
        row(4, "a", by="a"), row(4, "b", slot="t"), row(5, "a", slot=None), row(5, "b", old="a", slot=None), row(6, "a"), row(6, "a", slot="t"), row(6, "b", old="a"), row(None, "a"), row(None, "b", old="a"), row(7, "a", old="b"), row(7, "b"), row(7, "b", slot="t"),
    ]
    df = spark.createDataFrame(rows, DECISION)
    edges = decisions.supersede_edges(df)
    honored = decisions.honored_edges(edges, df)
    verdicts = spark.createDataFrame([(r, "fail" if r == 2 else "pass") for r in range(1, 8)], "registry_id int, verdict string")
    for most in (100_000, 0):
        examined = decisions.examined(df, most)
        found = decisions.eligible_examined(examined, verdicts)
        assert sorted(map(str, found.collect())) == sorted(map(str, decisions.eligible_decisions(df, honored, verdicts).collect()))
        for line in examined._jdf.queryExecution().optimizedPlan().toString().splitlines():
            assert "Generate" not in line or "filter(" not in line
    stored = decisions.eligible_examined(decisions.stored(examined), verdicts)._jdf.queryExecution().optimizedPlan().toString()
    assert stored.count("Join") == 1
    assert {("1", "b"), ("1", "c"), ("3", "a")} <= {(str(r.registry_id), r.id) for r in found.collect()}


def test_small_graphs_are_searched_for_cycles_without_rounds(spark, monkeypatch):
    rounds, write = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: rounds.append(1) or write(df))
    rows = [(1, "x", i, i + 1) for i in range(300)] + [(1, "y", i, (i + 1) % 50) for i in range(50)] + [(2, "x", 1, 1), (2, "y", None, 1), (2, "z", 1, 2), (2, "z", 1, 2), (None, "x", 1, 1)]
    edges = spark.createDataFrame(rows, "k int, l string, a int, b int")
    assert got(with_cycles(edges, ["k", "l"], "a", "b"), "k", "l") == [(1, "y"), (2, "x")]
    assert len(rounds) == 1
    assert got(with_cycles(edges, ["k", "l"], "a", "b", most=20), "k", "l") == [(1, "y"), (2, "x")]


def test_digest_does_not_depend_on_order(spark):
    rows = [(1, f"p{i}", i, f"h{i}") for i in range(40)]
    make = lambda r: integrity.aggregate_digest(spark.createDataFrame(r, "run_id int, path string, bytes long, sha256 string").repartition(7), ["run_id"]).first().digest
    assert make(rows) == make(rows[::-1]) != make(rows[:-1])


def test_corpus_flags_bytes_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"ok \xc3\xa9")
    (tmp_path / "b.md").write_bytes(b"bad \xff")
    found = {r.path.rsplit("/", 1)[1]: (r.valid, r.n_bytes) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert found == {"a.md": (True, 5), "b.md": (False, 5)}


def test_clusters_of_a_project_need_no_rounds(spark, monkeypatch):
    """A chain, a set, null and blank sources, null ids and projects, and repeated rows; one pass, rounds and both give what plain Python gives."""
    rows = [(1, str(i), [f"s{i}", f"s{i + 1}"]) for i in range(30)] + [(1, "zz", ["t"]), (1, "z", ["t", " "]), (1, "y", [" ", None]), (1, "x", None), (1, None, ["t"]), (1, "x", None)]
    rows += [(2, str(i), [f"s{i % 3}"]) for i in range(7)] + [(None, "a", ["s0"]), (None, "b", ["s0"]), (3, "only", [])]
    obs = spark.createDataFrame(rows, "project_id int, id string, sources array<string>")
    want = set()
    for p, i, _ in rows:
        near, before = {i}, None
        while p is not None and i is not None and near != before:
            before = set(near)
            held = {s for q, j, own in rows if q == p and j in near for s in own or () if s and s.strip()}
            near |= {j for q, j, own in rows if q == p and j is not None and held & set(own or ())}
        want.add((p, i, min(near) if i is not None else None))
    found = lambda most: sorted((tuple(r) for r in manifest.cluster_observations(obs, most).collect()), key=str)
    assert found(0) == found(40) == sorted(want, key=str)
    monkeypatch.setattr(manifest, "classes", None)
    assert found(1_000) == sorted(want, key=str)


def test_scale_keys_and_weights(spark):
    df = spark.createDataFrame([(1, {"pass_threshold": 4}, {"max": 6}, None, None, {"a": 2}), (2, None, None, None, {}, {"a": 2})], "project_id int, legacy_scale map<string,int>, scale map<string,int>, rubric_scale map<string,int>, weights map<string,int>, legacy_weights map<string,int>")
    assert [(r.pass_threshold, r.max, dict(r.weights)) for r in manifest.scale_of(df).orderBy("project_id").collect()] == [(4, 6, {"a": 2}), (3, 5, {})]


def test_rounds_fold_and_converge(spark):
    names = spark.createDataFrame([(1, "REVIEW_r1.md"), (1, "TRIAGE_r3"), (2, "notes")], "k int, name string")
    assert got(review.next_round(names, ["k"]), "k", "next_round") == [(1, 2), (2, 1)]
    f = spark.createDataFrame([(1, "a", None, None), (1, "b", "a", None), (1, "c", "b", True), (1, "x", "y", None), (1, "y", "x", None)], "k int, finding_id string, alias_of string, new_evidence boolean")
    assert {r.finding_id: (r.canonical, r.folded) for r in review.fold_aliases(f, ["k"]).collect()} == {"a": ("a", "new"), "b": ("a", "duplicate"), "c": ("a", "reopened"), "x": (None, "duplicate"), "y": (None, "duplicate")}


def test_curation_order(spark):
    items = spark.createDataFrame([(1, "pm", 1, "1/pm/01", "s1", "c"), (1, "pm", 2, "1/pm/02", "s0", "c"), (1, "qa", 1, "1/qa/01", "s0", "c")], "run_id int, perspective string, item_no int, item_id string, target_section string, consideration string")
    d = spark.createDataFrame([(1, "1/pm/01", "decided", "", "y", [], ""), (1, "1/pm/02", "open", "", "", [], ""), (1, "1/qa/01", "decided", "g", "y", ["m"], "")], "run_id int, item_id string, status string, group_id string, decision string, material_refs array<string>, rationale string")
    m = spark.createDataFrame([(1, "m", "sha")], "run_id int, material_id string, sha256 string")
    s = spark.createDataFrame([(1, "s0", 0), (1, "s1", 1)], "run_id int, section string, pos int")
    assert [r.item_id for r in curation.curated_items(items, d, m, s).orderBy("pos").collect()] == ["1/qa/01", "1/pm/02", "1/pm/01"]


def test_conventions_conflict_and_refuse(spark):
    p = spark.createDataFrame([("p", 1, "q1"), ("p", 2, "q2")], "profile_id string, pos int, question_id string")
    i = spark.createDataFrame([("i", "p", "applicable"), ("j", "p", "inapplicable")], "intake_id string, profile_id string, result string")
    a = spark.createDataFrame([("i", "q1", "o", "approved_to_draft"), ("i", "q2", "o", "approved_to_draft")], "intake_id string, question_id string, response string, approval string")
    d = spark.createDataFrame([("p", "q1", "o", "sections", "é", "1"), ("p", "q2", "o", "sections", "é", "2"), ("p", "q2", "o", "sections", "z", "2")], "profile_id string, question_id string, option_id string, key string, identity string, body string")
    found = conventions.materialize_conventions(p, i, a, d).collect()
    assert {(r.intake_id, r.state, r.identity, r.body) for r in found} == {("i", "conflict", "é", "1"), ("i", "merged", "z", "2"), ("j", "refused", None, None)}


def test_event_order_in_batch_and_as_a_stream(spark):
    good = ["intake", "input_gate", "lens_L2", "lens_L1", "other", "lens_L3", "candidates"]
    runs = {1: good, 2: ["input_gate"], 3: ["intake", "lens_L1"], 4: [*good, "candidates"], 5: ["intake", "intake"], 6: ["intake", "input_gate", "lens_L9"], 7: ["intake", "input_gate", "candidates"]}
    rows = [(k, n, e) for k, events in runs.items() for n, e in enumerate(events, 1)]
    random.Random(1).shuffle(rows)
    events = spark.createDataFrame(rows + rows[:5], "run_id long, seq long, event string")
    want = [(2, "gate_before_intake", 1), (3, "lens_before_gate", 2), (4, "candidates_repeated", 8), (5, "intake_repeated", 2), (6, "lens_unknown", 3), (7, "candidates_early", 3)]
    assert got(streams.trace_order(events.distinct()), "run_id", "violation", "seq") == want
    stream = streams.run_to_end(lambda x: streams.trace_order_stream(x, None), events.repartition(3))
    assert got(stream, "run_id", "violation", "seq") == want


def test_terms_of_a_large_dictionary_are_found_like_those_of_a_small_one(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "the hand and the land"), (1, 2, "a\\Eb and a"), (2, 1, "é and日本語"), (2, 2, ""), (3, 1, None)], "doc_id long, line_no int, line string")
    terms = spark.createDataFrame([("und", ["and", "", "日本"], ["hand", "land"]), ("x", ["a\\Eb", "é", "日本語"], None), ("none", ["zzzz"], [])], "canonical string, forbidden array<string>, excepted array<string>")
    small = sorted(map(tuple, verify.term_scan(rows, terms).collect()))
    monkeypatch.setattr(matching.matched, "__defaults__", (0,))
    assert small == sorted(map(tuple, verify.term_scan(rows, terms).collect()))
    assert [(r[0], r[1], r[2], r[4]) for r in small] == [(1, 1, "and", 9), (1, 2, "a\\Eb", 0), (1, 2, "and", 5), (2, 1, "and", 2), (2, 1, "é", 0), (2, 1, "日本", 5), (2, 1, "日本語", 5)]


@pytest.mark.parametrize("chars", [10**6, 0])
def test_term_usage_equals_a_plain_count(spark, monkeypatch, chars):
    monkeypatch.setattr(matching.matched, "__defaults__", (chars,))
    rng = random.Random(9)
    terms = [("und", ["and", "aa"], ["hand", "andand"]), ("aba", ["ab", "aba"], None), ("ab", ["b"], ["bb"]), ("é日", ["日"], ["日本"]), ("", ["zz"], []), (None, ["q"], []), ("unused", [], [])]
    lines = ["".join(rng.choice(["a", "b", "and", "h", "un", "d", "é", "日", "本", " ", "q", "z"]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + [None, ""]

    def spans(line, part):
        return [i for i in range(len(line) - len(part) + 1) if part and line.startswith(part, i)]

    want = {}
    for n, line in enumerate(lines):
        for c, forbidden, excepted in terms:
            allowed = [(a, a + len(e)) for e in excepted or [] for a in spans(line or "", e)]
            used = [a for v in forbidden for a in spans(line or "", v) if not any(x <= a and a + len(v) <= y for x, y in allowed)]
            own = want.setdefault((n % 4, c), [0, 0])
            own[0] += len(used)
            own[1] += len(spans(line or "", c or ""))
    rows = spark.createDataFrame([(n % 4, n, t) for n, t in enumerate(lines)], "doc_id int, line_no int, line string")
    found = verify.term_usage(rows, spark.createDataFrame(terms, "canonical string, forbidden array<string>, excepted array<string>"))
    assert {(r.doc_id, r.canonical): [r.n_avoided, r.n_preferred] for r in found.collect()} == {k: v for k, v in want.items() if any(v)}


def test_a_dictionary_of_a_hundred_thousand_names_makes_no_nested_loop(spark):
    names = spark.range(120_000).select(F.concat(F.lit("name "), F.sha2(F.col("id").cast("string"), 256).substr(1, 12)).alias("canonical")).withColumns({"forbidden": F.array(F.concat(F.lit("x"), "canonical")), "excepted": F.array().cast("array<string>")})
    some = [r.canonical for r in names.limit(50).collect()]
    lines = spark.createDataFrame([(i, 1, f"see {some[i % 50]} and x{some[(i + 1) % 50]}.") for i in range(200)], "doc_id int, line_no int, line string")
    used = verify.term_usage(lines, names)
    plan = used._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # an avoided variant holds its preferred wording, so a line has both names
    assert used.agg(F.sum("n_avoided"), F.sum("n_preferred")).first()[:] == (200, 400)


def test_patterns_take_time_linear_in_a_line(spark):
    rng = random.Random(10)
    patterns = [("email", r"[A-Za-z0-9_.]+@[A-Za-z0-9_.]+"), ("pair", r"\w+:\w{2}"), ("dash", r"[^-]+-x?"), ("either", r"[ab]+@|c"), ("group", r"(?:[a-z]+=|b)1"), ("plain", r"to(?:ken|ll)")]
    assert [matching.linear(p)[1] for _, p in patterns] == ["@", ":", "-", None, None, None]
    lines = ["".join(rng.choice(list("aAb@@:-=1 x_.") + ["token", "ab@cd@ef", "b:cde:fg"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(1, n, t) for n, t in enumerate(lines)], "doc_id int, line_no int, line string")
    want = sorted((n, name, h.group()) for n, t in enumerate(lines) for name, p in patterns for h in re.finditer(p, t, re.IGNORECASE | re.ASCII))
    assert got(verify.pattern_scan(rows, patterns), "line_no", "pattern", "hit") == want
    began = time.time()
    long = spark.createDataFrame([(1, 1, "a" * 1_000_000), (1, 2, "b@" + "a" * 1_000_000), (1, 3, "a" * 1_000_000 + "@b")], "doc_id int, line_no int, line string")
    assert [len(r.hit) for r in verify.pattern_scan(long, patterns[:1]).orderBy("line_no").collect()] == [1_000_002, 1_000_002]
    assert time.time() - began < 30


def test_nodes_between_cycles_are_on_none(spark):
    """Two cycles joined by a path, by one node, and by long chains; self loops; random graphs against plain reachability."""
    path = [(1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6), (1, 6, 5), (2, 1, 1), (2, 1, 2), (2, 2, 3), (2, 3, 3)]
    long = [(3, i, i + 1) for i in range(14)] + [(3, 3, 0), (3, 14, 11)]
    rng = random.Random(15)
    noise = [(10, rng.randint(0, 6), rng.randint(0, 6)) for _ in range(8)]
    edges = [*path, *long, *noise, (4, None, 1), (4, 2, None)]

    def reach(k, start):
        seen, todo = set(), [b for x, a, b in edges if x == k and a == start]
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += [b for x, a, b in edges if x == k and a == n]
        return seen

    want = sorted({(k, n) for k, a, b in edges for n in (a, b) if n is not None and n in reach(k, n)})
    found = got(on_cycles(spark.createDataFrame(edges, "k int, a int, b int"), ["k"], "a", "b"), "k", "node")
    assert found == want and {n for k, n in found if k == 3} == {*range(4), *range(11, 15)} and {n for k, n in found if k == 1} == {1, 2, 5, 6}


def test_a_snapshot_is_published_once_and_read_whole(spark, tmp_path):
    docs = corpus.from_table(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, text string"), "id", "text")
    root = f"file://{tmp_path}"
    written = corpus.write_snapshot(docs, root, "r1").first()
    assert written.n_files == 50 and corpus.read_snapshot(spark, root, "r1").count() == 50
    with pytest.raises(corpus.SnapshotError, match="already"):
        corpus.write_snapshot(docs.limit(1), root, "r1")
    with pytest.raises(corpus.SnapshotError, match="not complete"):
        corpus.read_snapshot(spark, root, "r0")
    # half-written: rows without a record, and a record that breaks off
    docs.write.parquet(f"{root}/r2/attempt-x")
    with pytest.raises(corpus.SnapshotError, match="no record"):
        corpus.read_snapshot(spark, root, "r2")
    (tmp_path / "r2" / corpus.RECORD).write_text('{"run_id": "r2", "rows": "att')
    with pytest.raises(corpus.SnapshotError, match="broken off"):
        corpus.read_snapshot(spark, root, "r2")
    # a changed row, and one that is gone
    for name, other in (("r3", docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text")))), ("r4", docs.where("doc_id <> 7"))):
        corpus.write_snapshot(docs, root, name)
        record = json.loads((tmp_path / name / corpus.RECORD).read_text())
        other.write.mode("overwrite").parquet(f"{root}/{name}/{record['rows']}")
        with pytest.raises(corpus.SnapshotError, match="not those of its record"):
            corpus.read_snapshot(spark, root, name)


def test_of_two_writers_of_a_snapshot_one_wins(spark, tmp_path, monkeypatch):
    docs = corpus.from_table(spark.createDataFrame([(i, f"text {i}") for i in range(9)], "id long, text string"), "id", "text")
    root, real = f"file://{tmp_path}", corpus._digest

    def meanwhile(rows, run_id, inventory):  # another writer comes while this one works out its digest
        monkeypatch.setattr(corpus, "_digest", real)
        corpus.write_snapshot(docs.limit(4), root, "r")
        return real(rows, run_id, inventory)

    monkeypatch.setattr(corpus, "_digest", meanwhile)
    with pytest.raises(corpus.SnapshotError, match="meanwhile"):
        corpus.write_snapshot(docs, root, "r")
    assert corpus.read_snapshot(spark, root, "r").count() == 4
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("attempt-")]) == 1


def test_digest_of_a_run_of_many_files_streams(spark):
    rows = spark.range(200_000).select(F.lit(None).cast("string").alias("run"), F.concat(F.lit("p/"), F.col("id").cast("string")).alias("path"), "id", F.lit("ab").alias("sha256")).withColumnRenamed("id", "bytes")
    rows = rows.unionByName(spark.createDataFrame([("r", "é", 1, "x"), ("r", "z", 2, "y"), ("r", "z", 2, "y"), ("r", None, 2, "y")], "run string, path string, bytes long, sha256 string"))
    found = {r.run: (r.digest, r.n_files) for r in integrity.aggregate_digest(rows.repartition(7), ["run"]).collect()}
    line = lambda p, b, s: f"{p}\0{b}\0{s}\n"
    many = "".join(line(p, p[2:], "ab") for p in sorted(f"p/{i}" for i in range(200_000)))
    assert found == {None: (hashlib.sha256(many.encode()).hexdigest(), 200_000), "r": (hashlib.sha256((line("z", 2, "y") * 2 + line("é", 1, "x")).encode()).hexdigest(), 4)}


def test_findings_match_one_to_one_whatever_the_order_of_rows(spark):
    gold = [(1, "x", True, 50, 60), (1, "x", False, 10, 20), (1, "x", False, 15, 40), (1, "y", False, None, None), (1, "y", True, None, None), (2, "z", False, 1, 5), (2, "w", True, 3, 9)]
    said = [(1, "x", None, 18, 42), (1, "x", "valid-new", 12, 16), (1, "x", None, 90, 95), (1, "y", None, None, None), (2, "z", None, 70, 80), (2, "z", None, 4, 6)]
    schema = ("d int, item string, known_false boolean, start int, end int", "d int, item string, adjudicated string, start int, end int")
    found = set()
    for seed in range(3):
        rng = random.Random(seed)
        g, p = rng.sample(gold, len(gold)), rng.sample(said, len(said))
        found.add(tuple(review.reviewer_eval(spark.createDataFrame(g, schema[0]).repartition(3), spark.createDataFrame(p, schema[1]).repartition(2), ["d"]).first()))
        found.add(tuple(review.reviewer_eval(spark.createDataFrame(g, schema[0]).repartition(2).drop("start", "end"), spark.createDataFrame(p, schema[1]).drop("start", "end"), ["d"]).first()))
    # by place 18-42 and 12-16 match x's true ones and 90-95 is left for the known false one; without places the known false one gets what is neutral
    assert found == {(4, 4, 1.0, (3 / 4 + 1 / 2) / 2, 2 / 3), (4, 4, 1.0, (1 + 1 / 2) / 2, 2 / 3)}


def test_tree_digest_sees_every_change_and_no_order(spark):
    rows = [(1, f"p{i}", i, f"h{i}") for i in range(300)]
    of = lambda x: integrity.tree_digest(spark.createDataFrame(x, "run_id long, path string, bytes long, sha256 string"), ["run_id"]).first()
    whole = of(rows)
    assert whole == of(rows[::-1]) and whole.n_files == 300
    assert len({whole.digest, of(rows[:-1]).digest, of([(1, "p0", 1, "h0"), *rows[1:]]).digest, of([(1, "q0", 0, "h0"), *rows[1:]]).digest}) == 4


def test_findings_by_schema_version(spark):
    base = "run_id long, record_id string, category string, schema_version int, verdict string"
    rows = spark.createDataFrame([(1, "a", "finding", 1, None), (1, "b", "finding", 1, "full"), (1, "c", "finding", 2, None), (1, "d", "finding", 2, "full"), (1, "e", "finding", 2, "odd"), (1, "f", "nonissue", 3, None)], base)
    found = {(r.subject, r.rule) for r in ledger.shape_violations(rows).collect() if "verdict" in r.rule or r.rule == "schema_version"}
    assert found == {("b", "unknown:verdict"), ("c", "missing:verdict"), ("e", "enum:finding.verdict"), ("f", "schema_version")}


def test_approvals_that_are_no_authority(spark):
    good, now = "a" * 64, "b" * 64
    registries = spark.createDataFrame([(1, "t", "2024-01-01"), (2, None, "May"), (3, "t", "2024-01-01"), (4, "t", "2024-01-01")], "registry_id int, target string, updated_at string")
    base = "registry_id int, id string, docmodel_path string, docmodel_sha256 string, status string, approved_by string, approved_at string, evidence string, template string"
    entry = lambda k, i, path, sha=good, status="approved", template=None: (k, i, path, sha, status, "p", "2024-01-01", "e", template)
    approvals = spark.createDataFrame([
        entry(1, "a", "m.yaml"), entry(1, "b", "x/M.DRAFT.yaml"), entry(1, "c", "m.draft.d/n.yaml", status="revoked"), entry(3, "a", "../m.yaml"), entry(3, "a", "old.yaml"), entry(3, None, "gone.yaml", template=" "), entry(3, "d", None, "x", "odd"),
    ], base)
    files = spark.createDataFrame([("m.yaml", good), ("x/M.DRAFT.yaml", good), ("m.draft.d/n.yaml", good), ("old.yaml", now)], "path string, sha256 string")
    found = ledger.approval_violations(registries, approvals, files)
    assert {(r.registry_id, r.subject, r.rule) for r in found.collect()} == {
        (2, None, "blank:target"), (2, None, "format:updated_at"), (2, None, "no_approval"), (4, "t", "no_approval"), (3, "a", "unsafe_path"), (3, "a", "stale_model"), (3, None, "missing_model"), (3, None, "blank:id"),
        (3, None, "blank:template"), (3, "d", "blank:docmodel_path"), (3, "d", "format:docmodel_sha256"), (3, "d", "enum:status"), (3, "a", "repeated_id"),
    }
    assert got(ledger.current_approvals(approvals, found), "id", "state") == [("a", "approved"), ("b", "draft"), ("c", "revoked")]
