"""Host reputation on pages whose hosts differ, recomputed in Python, and mixes whose targets contradict each other."""

import math

import duckdb

import __spark_entry__ as entry
from zonecast.llm import hosts, mixing


def brute(rows):
    """rows: (host, bad). Posterior rate and bound by host, with strengths fitted by moments and held to what was seen."""
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]
    tree = {h: (domain(h), suffix(h)) for h, _ in rows}
    count = lambda key: {k: (len([1 for h, _ in rows if key(h) == k]), sum(b for h, b in rows if key(h) == k)) for k in {key(h) for h in tree}}
    levels = [count(lambda h: h), count(domain), count(suffix), count(lambda h: "")]
    parents = [lambda k: domain(k), lambda k: suffix(k), lambda k: ""]
    strength = []
    for own, above, up in zip(levels, levels[1:], parents, strict=False):
        s = v = w = 0.0
        for k, (n, x) in own.items():
            pn, px = above[up(k)]
            r = (px + 0.5) / (pn + 1)
            s, v, w = s + n * (x / n - r) ** 2, v + r * (1 - r), w + r * (1 - r) * (n - 1)
        strength.append(min(1e4, max(0.5, 1 / max(1e-9, (s - v) / w if w else 0) - 1)))
    n0, x0 = levels[3][""]
    mean, out = (x0 + 0.5) / (n0 + 1), {}
    for h, (d, s) in tree.items():
        rate = mean
        for (n, x), k, seen in zip((levels[2][s], levels[1][d], levels[0][h]), reversed(strength), (n0, levels[2][s][0], levels[1][d][0]), strict=True):
            k = min(k, max(seen, 0.5))
            rate, weight = (k * rate + x) / (k + n), k + n
        out[h] = rate, rate - 1.645 * math.sqrt(rate * (1 - rate) / (weight + 1)), mean
    return out


def test_rates_are_those_of_the_hosts(spark, tmp_path):
    pages = [f"http://{h}/{'en' if i < bad else 'fr'}/{i}" for h, n, bad in (("a.one.com", 40, 38), ("b.one.com", 40, 2), ("c.two.com", 3, 3), ("d.two.com", 3, 0), ("e.three.org", 30, 30), ("f.four.net", 1, 1), ("g.one.com", 200, 60)) for i in range(n)]
    rows = [(u.split("/")[2], int(u.split("/")[2].endswith(".com") and "/en/" in u)) for u in pages]
    want = brute(rows)
    got = {r.host: (r.rate, r.bound, r.overall) for r in hosts.reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got.keys() == want.keys() and all(math.isclose(x, y, rel_tol=1e-9) for h in want for x, y in zip(got[h], want[h], strict=True))
    spark.createDataFrame([(i, u, "x") for i, u in enumerate(pages)], "page_id long, url string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    judged = {r.page_id: r for r in entry.queries()["op9_host_reputation"](spark, f"file://{tmp_path}").collect()}
    for i, u in enumerate(pages):
        h = u.split("/")[2]
        assert judged[i].verdict == ("block" if rows[i][1] or want[h][1] > want[h][2] else "allow")
    assert {r.verdict for r in judged.values() if r.rule is None} == {"allow", "block"}
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duckdb.sql(entry.oracle_sql()["op9_host_reputation"]).fetchall()) == sorted(tuple(r) for r in judged.values())


def test_rules_are_those_of_the_contract(spark, tmp_path):
    want = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    assert {(r.host, r.path): r.action for r in hosts.RULES} == want
    urls = [f"http://{h}{p}x" for host, _ in want for h in (host, f"a.{host}") for _, p in want]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in entry.queries()["op9_host_reputation"](spark, f"file://{tmp_path}").collect()}
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        fits = [(h, p) for h, p in want if (host == h or host.endswith(f".{h}")) and f"/{path}".startswith(p)]
        rule = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert got[i].rule == (rule and rule[0] + rule[1]) and (rule is None or got[i].verdict == want[rule])
    assert got[urls.index("http://a.net/de/x")].verdict == "allow" and got[urls.index("http://example.net/de/8x")].verdict == "block"


def test_odd_pages(spark, tmp_path):
    rows = [(1, None), (1, None), (None, "http://x.com/en/1"), (2, ""), (3, "nothing"), (4, "://"), (5, "HTTP://UP.Example.COM/en/7?q"), (6, "a://b://c/en/")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["op9_host_reputation"](spark, f"file://{tmp_path}").collect()
    assert len(got) == len(rows) and {(r.page_id, r.host, r.path, r.rule) for r in got} >= {(1, "", "", None), (None, "x.com", "/en/1", "com/en/"), (5, "up.example.com", "/en/7", "example.com/en/7"), (4, "", "", None), (6, "b:", "//c/en/", None)}
    assert hosts.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_contradicting_targets_end(spark):
    rows = [("a", "x", 10, 20.0, 100.0), ("b", "x", 10, 20.0, 100.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, size long, source_target double, lang_target double")
    out = mixing.balanced(cells, ["source", "lang"]).collect()
    assert len(out) == 2 and all(r.rate > 0 for r in out)
