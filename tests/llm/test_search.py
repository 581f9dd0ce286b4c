"""Phrase search, ranked search and infilling against brute-force versions, on ordinary and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from zonecast.llm import infill, inverted, phrases, ranked
from zonecast.llm.common import drop

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, items string, m int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(r, n, words=40):
    return " ".join(f"w{int(words * r.random() ** 2)}" for _ in range(n))


def made():
    r = random.Random(7)
    items = [(i, prose(r, r.choice((12, 15, 30)))) for i in range(12)]
    items += [(50, "three words only"), (51, "Ünïcode ＡＢＣ 漢字"), (52, None), (53, "-- !!"), (54, "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"), (3, "shares an id with another"), (None, "nobody knows me"), (55, items[0][1])]
    texts = [prose(r, r.randint(0, 120)) for _ in range(60)]
    for i in range(40):  # passages of items, whole and broken
        own = (r.choice(items)[1] or "").split(" ")
        low = r.randrange(1 + len(own) // 3)
        texts.append(prose(r, 5) + ", " + ", ".join(own[low : low + r.randint(5, 25)]).upper() + ". " + prose(r, 5))
    texts += [None, "", " \n", "w1 " * 500, "w1", "Three, WORDS--only", "only three words", "ünïcode ＡＢＣ 漢字 x", "three words", "nobody knows me", "x" * 70_000, texts[0], texts[0], "é\x00w1 w2"]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)]
    return [*rows, (None, texts[1], "", 0), (5, texts[2], "", 0), (5, texts[2], "", 0)], items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items = made()
    out = tmp_path_factory.mktemp("search")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").repartition(2).write.parquet(f"{out}/benchmark.parquet")
    return rows, items, f"file://{out}"


@pytest.fixture(params=[1 << 20, 40], ids=["one block", "blocks of an item or two"])
def cuts(request, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", request.param)


def run(spark, folder, prefix):
    name = next(q for q in entry.queries() if q.startswith(prefix))
    return entry.queries()[name](spark, folder).collect()


def hits(text, items, width=10):
    own, marks, names = terms(text), set(), set()
    for name, x in items:
        w = terms(x)
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for p in range(len(own) - size + 1):
                if own[p : p + size] == w[i : i + size]:
                    marks |= set(range(p, p + size))
                    names |= {str(name)} - {"None"}
    return len(own), len(marks), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def test_phrases_are_all_found(spark, tables, cuts):
    rows, items, folder = tables
    got = run(spark, folder, "op11_")
    want = [(d, *hits(t, items)) for d, t, *_ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got], key=key) == sorted(want, key=key)
    assert all(r.contaminated == (r.n_hit > 0) for r in got) and sum(r.contaminated for r in got) > 15


def test_segments_do_not_change_what_is_found(spark, tables):
    rows, items, folder = tables
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    tell = lambda index: sorted(repr((r.doc_id, r.n_words, r.spans, sorted(r["items"]))) for r in phrases.search(index, asked).collect())
    whole, cut = phrases.build(docs), phrases.build(docs, 3)
    assert cut.count() > whole.count() and tell(cut) == tell(whole)
    n, total = ranked.sizes(docs)
    tell = lambda index: sorted(map(repr, ranked.search(index, asked, n).collect()))
    assert tell(ranked.build(docs, n, total, 3)) == tell(ranked.build(docs, n, total))


def test_proximity_lets_terms_move(spark):
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "a x b c d"), (2, "b a c d"), (3, "a b x y z c d"), (4, "d c"), (5, "q a b c"), (6, "d z z z z")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c d")], "item_id string, text string")
    index = phrases.build(docs)
    found = lambda slop: {r.doc_id for r in phrases.search(index, items, 10, slop).collect() if r["items"]}
    brute = lambda slop: {d for d, t in ((r.doc_id, terms(r.text)) for r in docs.collect()) if any(all(any(0 <= s + o + m < len(t) and t[s + o + m] == w for m in range(-slop, slop + 1)) for o, w in enumerate("abcd")) for s in range(-slop, len(t)))}
    assert [found(s) for s in range(4)] == [brute(s) for s in range(4)] and found(0) == {0} and 1 in found(1) and 3 not in found(1)


def test_a_window_with_more_postings_than_a_part(monkeypatch):
    monkeypatch.setattr(phrases, "CANDIDATES", 7)
    r = random.Random(2)
    own = [f"t{r.randrange(4)}".encode() for _ in range(400)]
    number = {x: i for i, x in enumerate(dict.fromkeys(own))}
    flat = np.array([number[x] for x in own], np.int32)
    row = {"lengths": np.array([150, 0, 250], np.int32).tobytes(), "terms": b" ".join(number), "ends": np.cumsum(np.bincount(flat)).astype(np.int32).tobytes(), "places": np.argsort(flat, kind="stable").astype(np.int32).tobytes()}
    windows = phrases.Windows([("a", own[140:160])], 3)
    segment = phrases.Segment(row, windows, 5)
    (size, table, *_), found = windows.tables[0], set()
    for window, start in segment.matches(table, 0):
        found |= set(zip(window.tolist(), start.tolist(), strict=True))
    want, place = set(), {tuple(x): i for i, x in enumerate(table.tolist())}
    slots = [windows.slot[x] for x in own]
    for low, high, gap in ((0, 150, 5), (150, 400, 15)):
        want |= {(place[tuple(slots[p : p + size])], p + gap) for p in range(low, high - size + 1) if tuple(slots[p : p + size]) in place}
    assert found == want and len(found) > 50


def scores(rows, items, k=20):
    own = [(d, Counter(terms(t))) for d, t, *_ in rows]
    own = [(d, c) for d, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(x for _, c in own for x in c)
    asked = {}
    for name, x in items:
        asked.setdefault(name, Counter()).update(terms(x))
    out = []
    for name, c in asked.items():
        found = []
        for d, tf in own:
            m = 75 + 25 * sum(tf.values()) * n // total
            s = sum(y * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x, y in c.items() if x in tf)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(name, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return out


def test_ranks_are_exact(spark, tables, cuts):
    rows, items, folder = tables
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(map(tuple, run(spark, folder, "op13_")), key=key)
    assert got == sorted(scores(rows, items), key=key) and len(got) > 150


def test_bounds_hold_and_ties_are_scored(spark):
    r = random.Random(3)
    rows = [(100 - i, prose(r, 30, 15)) for i in range(30)] + [(1000 - i, "w1 w2 w3") for i in range(90)] + [(i, "zz") for i in range(2000, 2010)]
    items = [("a", "w1 w2 w3"), ("b", "zz"), ("c", "never seen")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id string, text string")
    n, total = ranked.sizes(docs)
    index = ranked.build(docs, n, total)
    for k in (1, 20, 500):
        assert sorted(map(tuple, ranked.search(index, asked, n, k).collect())) == sorted(scores(rows, items, k))
    drop(index)
    tf = np.arange(1, 5000)
    for m in (75, 100, 5000, 10**8):
        exact = ranked.part(tf, np.full(len(tf), m))
        up = -(-exact // ranked.STEP)
        assert up.max() <= 255 and (up * ranked.STEP >= exact).all() and (np.maximum(up - 1, 0) * ranked.STEP <= exact).all()


def test_empty_tables(spark, tables):
    rows, items, folder = tables
    docs, asked = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    none = phrases.search(phrases.build(docs.where("false")), asked)
    assert none.count() == 0 and infill.infilled(docs.where("false")).count() == 0
    left = phrases.search(phrases.build(docs), asked.where("false")).collect()
    assert len(left) == len(rows) and not any(r["items"] or r.spans for r in left)
    n, total = ranked.sizes(docs.where("false"))
    assert (n, total) == (0, 0) and ranked.search(ranked.build(docs.where("false"), n, total), asked, n).count() == 0
    n, total = ranked.sizes(docs)
    assert ranked.search(ranked.build(docs, n, total), asked.where("false"), n).count() == 0


def cut(doc_id, text, form=None):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infilling_and_back(spark):
    r = random.Random(9)
    alphabet = ["a", "Bc", "<", ">", "P", "S", "<M", "é", "漢", "😀", "\n", " ", "1", "\x00", "M>"]
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "<P>"), (1003, "x<S>y"), (1004, "abc" * 3_000_000), (1005, "é" * 2_500_000), (1006, "<" * 4_194_303 + "P>"), (None, "no number"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, n int")
    out = infill.infilled(docs)
    got = sorted(map(tuple, out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[5]))
    want = sorted([(i, *cut(i, t)) for i, t in rows], key=lambda x: (x[0] is None, x[0] or 0, x[5]))
    assert got == want and {x[2] for x in got} == {"plain", "psm", "spm"}
    back = sorted((r.doc_id is None, r.doc_id or 0, r.t) for r in out.select("doc_id", infill.restored(out["output"], out["form"]).alias("t")).collect())
    assert back == sorted((i is None, i or 0, t or "") for i, t in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ<>PSMé漢😀 \n"), max_size=30), min_size=1, max_size=6))
def test_the_automaton_is_the_pattern(texts):
    data = [x.encode() for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    units = infill.Units(infill.scan(np.frombuffer(b"".join(data), np.uint8), bounds[:-1][np.diff(bounds) > 0]), bounds)
    for i, text in enumerate(texts):
        own = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert units.n[i] == len(own) and units.marked()[i] == any(x in text for x in ("<P>", "<S>", "<M>"))
        for k in range(len(own) + 1):
            assert units.place(i, k) - bounds[i] == len("".join(own[:k]).encode())


def test_new_queries_and_their_sql(spark, tables):
    import duckdb

    *_, folder = tables
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder.removeprefix('file://')}/{t}.parquet/*.parquet'" + (" WHERE item_id IS NOT NULL AND item_id <> 3" if t == "benchmark" else ""))
    sql = entry.oracle_sql()
    for name in ("op11_positional_index", "op12_fill_in_middle"):
        got = entry.queries()[name](spark, folder)
        if name == "op12_fill_in_middle":
            want = con.sql(sql[name])
            assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
        else:
            assert sorted(got.columns) == sorted(con.sql(sql[name]).columns)
