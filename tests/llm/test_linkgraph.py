"""Rules, links and propagation against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from docketry.llm import queries
from docketry.llm.linkgraph import SCALE, Propagation, Rule, judge_urls

RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
SCHEMA = "page_id long, url string, html string, host int, rule int, source string, found string, trust int, kind string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return lowered(host), re.match("[^?#]*", rest[len(host) :])[0]


def plain(rows, how=Propagation()):
    pages = []
    for page, url, html in rows:
        host, path = split_url(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
        pages.append((page, host, path, html, rule))
    count, said, edges = Counter(), defaultdict(Counter), Counter()
    for _, host, _, html, rule in pages:
        if not host:
            continue
        count[host] += 1
        if rule:
            said[host][rule.verdict] += 1
        links = set()
        for link in re.findall("href[\x09-\x0d\x20]*=[\x09-\x0d\x20]*[\"']?([^\x09-\x0d\x20\"'<>]+)", html or "", re.I):
            if re.match("[A-Za-z][A-Za-z0-9+.-]*://", link) or link.startswith("//"):
                links.add(split_url("http:" + link if link.startswith("//") else link)[0])
        edges.update((host, other) for other in links - {"", host})
    if how.sites:
        for host in count:
            up = [h for h in count if "." in h and host.endswith("." + h)]
            if up and len(host) <= 253:
                near = max(up, key=len)
                edges.update([(host, near), (near, host)])
    nodes = set(count) | {h for e in edges for h in e}
    values = {}
    for name, verdict, turn in (("trust", "allow", 0), ("distrust", "block", 1)):
        ways = {(e[turn], e[1 - turn]): w for e, w in edges.items()}
        out = Counter()
        for (a, _), w in ways.items():
            out[a] += w
        start = {h: math.floor(said[h][verdict] * float(SCALE) / count[h]) if count[h] else 0 for h in nodes}
        base = {h: math.floor(start[h] * (1 - how.damping)) for h in nodes}
        now = dict(start)
        for _ in range(how.rounds):
            new = {h: base[h] + (0 if out[h] else math.floor(now[h] * how.damping)) for h in nodes}
            for (a, b), w in ways.items():
                new[b] += math.floor(now[a] * (w / out[a]) * how.damping)
            now = new
        values[name] = now
    result = []
    for page, host, path, _, rule in pages:
        trust, distrust = (values[k].get(host, 0) for k in ("trust", "distrust"))
        blocked = distrust >= round((1 - how.damping) * SCALE) - 1 and distrust > trust
        result.append((page, host, path, rule and rule.host + rule.path, rule.verdict if rule else "block" if blocked else "allow", trust, distrust))
    return sorted(result, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust").collect()], key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "s", "f", 3, "k") for r in rows], SCHEMA).repartition(3)


def made(seed):
    rnd = random.Random(seed)
    hosts = [f"{p}{s}.{d}" for p in ("", "www.", "a.b.") for s in ("x", "y", "Zoo", "spam") for d in ("example.com", "example.net", "example.org", "test.io")]
    rows = []
    for i in range(300):
        host = rnd.choice(hosts[:6] + ["x.example.com"] * 6 + hosts)
        links = "".join(f'<a class=n HREF = "{rnd.choice(["http://", "//", "HTTPS://u@"])}{rnd.choice(hosts)}/p?q#r">l</a>' for _ in range(rnd.randint(0, 5)))
        rows.append((i, f"http://{host}{rnd.choice(['', '/', '/de/1', '/en/2?x', '/fr/#t', '/fr', '?q=/de/'])}", f"<p>{links}<a href='/rel'>r</a> <a href=mailto:a@b>m</a>"))
    rows += [rows[0]] * 3 + [(None, None, None), (1000, "", ""), (1001, "no scheme", "href=http://x.example.com"), (1002, "http://", None)]
    rows += [(1003, "http://net/", None), (1004, "http://xnet/", "href=//"), (1005, "x://org/fr/://b", "h" * 100_000), (1006, "http://" + "a." * 3000 + "example.com/", None)]
    return rows


@pytest.mark.parametrize("how", [Propagation(), Propagation(damping=0.85, rounds=5, sites=False)])
def test_verdicts_equal_plain_propagation(spark, how):
    rows = made(1)
    want = plain(rows, how)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    assert found(judge_urls(table(spark, rows), RULES, how)) == want


def test_who_links_to_blocked_hosts_is_distrusted(spark):
    rows = [(i, f"http://bad{i}.net/", None) for i in range(3)]
    rows += [(10, "http://farm.test.io/", "".join(f"<a href=http://bad{i}.net/>" for i in range(3)))]
    rows += [(11, "http://good.org/fr/", "<a href=//friend.test.io/>"), (12, "http://friend.test.io/x", None), (13, "http://alone.test.io/x", None)]
    verdicts = {r["page_id"]: r["verdict"] for r in judge_urls(table(spark, rows), RULES).collect()}
    assert verdicts == {0: "block", 1: "block", 2: "block", 10: "block", 11: "allow", 12: "allow", 13: "allow"}


def test_no_pages(spark):
    assert judge_urls(table(spark, []), RULES).collect() == []


def test_the_query_runs_no_python(spark):
    plan = queries.op12_link_propagation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "ExternalRDD"))
