from shelfmerge.llm import link_graph as lg

SCHEMA = "page_id bigint, url string, html string"


def rule_of(host, path):
    best = None
    for h, p, v in lg.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (not best or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


def split(url):
    import re

    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return low, re.match(r"[^?#]*", rest[len(host) :])[0]


def slow_verdicts(rows, rounds=lg.ROUNDS, damping=lg.DAMPING):
    import re

    hosts = [split(u) for _, u, _ in rows]
    links, a, b = {}, {}, {}
    for (host, path), (_, _, html) in zip(hosts, rows):
        v = rule_of(host, path)[1]
        if host:
            a[host] = a.get(host, 0) + (v == "allow")
            b[host] = b.get(host, 0) + (v == "block")
        for dst in re.findall(lg.HREF, html or ""):
            dst = dst.lower()
            if host and dst != host:
                links[host, dst] = links.get((host, dst), 0) + 1
    sa, sb = max(1, sum(a.values())), max(1, sum(b.values()))
    names = set(a) | {x for e in links for x in e}
    t0 = {h: a.get(h, 0) / sa for h in names}
    d0 = {h: b.get(h, 0) / sb for h in names}
    out = {h: sum(n for (s, _), n in links.items() if s == h) for h in names}
    into = {h: sum(n for (_, d), n in links.items() if d == h) for h in names}
    t, d = dict(t0), dict(d0)
    for _ in range(rounds if links else 0):
        nt = {h: (1 - damping) * t0[h] for h in names}
        nd = {h: (1 - damping) * d0[h] for h in names}
        for (s, e), n in links.items():
            nt[e] += damping * t[s] * n / out[s]
            nd[s] += damping * d[e] * n / into[e]
        t, d = nt, nd
    bad = {h for h in names if links and round(d[h], 12) > round(t[h], 12)}
    res = set()
    for (host, path), (i, _, _) in zip(hosts, rows):
        r, v = rule_of(host, path)
        res.add((i, host, path, r, v or ("block" if host in bad else "allow")))
    return res


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", host string")
    assert {tuple(r) for r in lg.url_verdicts(df).collect()} == slow_verdicts(rows)


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/X?y", "http://net", "http://net/", "http://x.example.net/en/1", "http://example.net/en", "http://badexample.net/en/", "https://É.org/fr/a#b", "ftp://example.com/de/?q", "a://b://c/d", "http://h?x/y", "http://h#/z", "http://x.com/\nde"]
    check(spark, [(i, u, None) for i, u in enumerate(urls)])


def test_propagation(spark):
    link = lambda *h: "".join(f"<a class='x' href='https://{x}/p'>t</a>" for x in h)
    rows = [
        (1, "http://good.org/fr/x", link("friend.com")),
        (2, "http://friend.com/a", link("friend2.com", "friend.com")),
        (3, "http://suspect.com/a", link("BAD.net", "bad.net", "friend.com")),
        (4, "http://bad.net/a", link("innocent.com")),
        (5, "http://innocent.com/a", None),
        (6, "http://farm.com/a", link("suspect.com")),
        (7, None, link("bad.net")),
        (7, "http://lonely.com/", "<a href=/x>y</a><a href='//friend.com'>z</a>"),
    ]
    check(spark, rows)
    got = {r.page_id: r.verdict for r in lg.url_verdicts(spark.createDataFrame(rows[:6], SCHEMA)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block"}


def test_empty_and_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    check(spark, [tuple(r) for r in df.select("page_id", "url", "html").collect()])
    assert lg.url_verdicts(df.limit(0)).count() == 0


def test_native_plan(spark, sf):
    plan = lg.url_verdicts(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_chain_and_many_seeds(spark):
    link = lambda *h: "".join(f"<a href='https://{x}/p'>t</a>" for x in h)
    rows = [(k, f"http://h{k}.com/", link(f"h{k + 1}.com")) for k in range(11)] + [(11, "http://h11.com/", link("bad.net"))]
    rows += [(20, "http://bad.net/a", link("other.com"))]
    got = {r.page_id: r.verdict for r in lg.url_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: "block" for k in (*range(12), 20)}


def test_verdicts_do_not_depend_on_the_number_of_seeds(spark):
    link = lambda h, n: f"<a href='https://{h}/p'>t</a>" * n
    rows = [(1, "http://bad.net/a", None), (2, "http://a.com/", link("bad.net", 1)), (3, "http://b.com/", link("bad.net", 1_000_000))]
    pages = spark.createDataFrame(rows, SCHEMA)
    more = spark.range(1_000_000).selectExpr("id + 10 AS page_id", "'http://x' || id % 1000 || '.net/' AS url", "CAST(NULL AS STRING) AS html")
    got = {r.page_id: r.verdict for r in lg.url_verdicts(pages.union(more)).filter("page_id < 10").collect()}
    assert got == {1: "block", 2: "block", 3: "block"}


def test_cycles_settle(spark):
    link = lambda *h: "".join(f"<a href='https://{x}/p'>t</a>" for x in h)
    rows = [
        (1, "http://good.org/fr/x", link("a.com", "b.com")),
        (2, "http://a.com/", link("b.com", "bad.net")),
        (3, "http://b.com/", link("a.com", "c.com")),
        (4, "http://c.com/", link("a.com", "bad.net")),
        (5, "http://bad.net/a", link("c.com")),
    ]
    got = {tuple(r) for r in lg.url_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == slow_verdicts(rows, rounds=300)
