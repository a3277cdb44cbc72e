import re
from collections import defaultdict

import numpy as np

from tecflow.llm import urls


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def plain_spread(edges, seeds):
    total = sum(seeds.values())
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    now = dict(seeds)
    for _ in range(400):
        came = defaultdict(float)
        for (a, b), w in edges.items():
            came[b] += 0.85 * now.get(a, 0) * w / out[a]
        left = 1 - sum(came.values()) / total if total else 0
        now = {h: came[h] + seeds.get(h, 0) * left for h in {*came, *seeds}}
    return now


def plain(pages):
    rows = [(i, *plain_parts(u)) for i, u, _ in pages]
    count = defaultdict(lambda: [0, 0, 0])
    for _, h, p in rows:
        if h:
            v = plain_rule(h, p)[1]
            count[h][0] += 1
            count[h][1] += v == "allow"
            count[h][2] += v == "block"
    edges = defaultdict(int)
    for (_, h, _), (_, _, html) in zip(rows, pages, strict=True):
        for link in re.findall(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'>\s]+)", html or ""):
            to = plain_parts(link if "://" in link else "x:" + link)[0]
            if h and to and h != to:
                edges[h, to] += 1
    trust = plain_spread(edges, {h: a / n for h, (n, a, _) in count.items() if a / n >= 0.5})
    distrust = plain_spread({(b, a): w for (a, b), w in edges.items()}, {h: b / n for h, (n, _, b) in count.items() if b / n >= 0.5})
    out = []
    for i, h, p in rows:
        name, verdict = plain_rule(h, p)
        t, d = trust.get(h, 0.0), distrust.get(h, 0.0)
        out.append((i, h, p, name, verdict or ("block" if d - t >= 0.1 else "allow"), round(t, 4), round(d, 4)))
    return out


def corpus():
    rng = np.random.default_rng(1)
    hosts = [f"h{i}.example.{rng.choice(['com', 'org', 'net', 'info'])}" for i in range(40)]
    pages = []
    for i in range(300):
        links = "".join(f'<p><A class="x" href="{rng.choice(["https:", "http:", ""])}//{rng.choice(hosts)}/q?x#y">l</a>' for _ in range(int(rng.integers(0, 4))))
        pages.append((i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}?a=b#c", f'<a href="/own">own</a><link href="https://h1.example.com/x.css">{links}'))
    odd = [(1000, None, None), (1001, "", "<a href=//h1.example.com>"), (1002, "no scheme/net/", ""), (1003, "HTTP://WWW.Example.NET", None), (1004, "x://a.net?q=://b.org/fr/", None), (1005, "x://net/", None), (1006, "ftp://u:p@É.Org:80/fr/x", None), (None, "a://b.example.com/de/", None), (0, pages[0][1], pages[0][2])]
    return pages + odd


def test_equals_brute_force(spark):
    pages = corpus()
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.trust, 4), round(r.distrust, 4)) for r in urls.judged(df).collect()]
    want = plain(pages)
    key = lambda r: (str(r[0]), r[1], r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-4 and abs(a[6] - b[6]) < 2e-4
    assert any(r[3] is None and r[4] == "block" for r in want) and any(r[5] > 0 for r in want)


def test_no_links_no_seeds_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.info/x", "<p>")], "page_id long, url string, html string")
    assert urls.judged(df).first().verdict == "allow"
    assert urls.judged(df.limit(0)).count() == 0


def test_walks_are_followed_until_they_settle(spark):
    """Two hosts that link to each other, and a chain of 40 hosts reached from 1,000 seeds, against plain iteration."""
    ring = {("a", "b"): 1, ("b", "a"): 3}
    chain = {(f"c{i}", f"c{i + 1}"): 1 for i in range(40)} | {(f"s{i}", "c0"): 2 for i in range(1000)}
    for links, weights in ((ring, {"a": 1.0}), (chain, {f"s{i}": 0.5 for i in range(1000)})):
        edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "src string, dst string, w long")
        seeds = spark.createDataFrame(list(weights.items()), "host string, weight double")
        got = {r.host: r.score for r in urls.spread(edges, seeds).collect()}
        want = plain_spread(links, weights)
        assert got.keys() == want.keys() and max(abs(got[h] - want[h]) for h in want) < 2e-6
    assert want["c21"] > 0.1


def test_clashing_columns_and_long_pages(spark):
    html = "<a href=//far.example.org/fr/>x</a>" * 20_000
    df = spark.createDataFrame([(1, "http://n.info/x", html, 1.0, "v"), (1, "http://n.info/x", html, 2.0, "w"), (2, "http://far.example.org/fr/", None, 3.0, None)], "page_id long, url string, html string, trust double, verdict string")
    got = sorted((r.page_id, r.verdict, r.rule) for r in urls.judged(df).collect())
    assert got == [(1, "allow", None), (1, "allow", None), (2, "allow", "org/fr/")]
