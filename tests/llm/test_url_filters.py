import duckdb

from lodestone.llm import url_filters
from lodestone.llm.common import Scratch

ROWS = [
    (1, "http://x.org/a", '<a href="http://www.example.com/en/z">k</a>', "h"), (2, "http://y.org/b?x", "<a class=q href=//x.org/a>", None), (3, "http://A.net/es/1", '<a href="https://z.org"><a href="http://y.org/">', ""), (4, None, None, None), (5, "http://w.org", '<a href="http://a.net/es/q"> <a href="http://a.net/fr/">', "h"), (6, "https://t.com/q", "", "h"),
    (7, "http://sub.example.com/en/9", "", "h"), (8, "nohost", "x", "h"), (9, "http://good.com/", '<a href="http://fine.org">', "h"), (9, "http://good.com/", '<a href="http://fine.org">', "h"), (10, "http://fine.org/p#f", "", "h"), (11, "HTTP://www.Example.com/en/1", "", "h"), (12, "http://www.example.com/EN/", "", "h"), (13, "http://xexample.com/en/", "", "h"), (14, "http://com", "", "h"), (15, "", "", "h"), (16, "x://b.net/fr/?q://c", "", "h"),
]
SCHEMA = "page_id long, url string, html string, host string"


def by_hand(rows):
    import re

    out = []
    for page, url, html, _ in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
        fits = [(len(r), v, r) for v, r in url_filters.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        out.append((page, host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None, html or ""))
    links = {}
    for _, host, _, _, _, html in out:
        for dst in re.findall(r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)""", html):
            if host and dst.lower() != host:
                links[host, dst.lower()] = links.get((host, dst.lower()), 0) + 1
    total = {}
    for (a, _), n in links.items():
        total[a] = total.get(a, 0) + n
    p = {e: n / total[e[0]] for e, n in links.items()}
    edges = {1: p, 0: {(b, a): v for (a, b), v in p.items()}}
    votes = {}
    for _, host, _, _, verdict, _ in out:
        if verdict and host:
            votes.setdefault(host, []).append(verdict)
    score = {}
    for kind in (1, 0):
        seeds = {h: 1.0 for h, v in votes.items() if (v.count("allow") * 2 > len(v)) == bool(kind)}
        rank = dict(seeds)
        for _ in range(200):
            new = {h: s * (1 - url_filters.DAMPING) for h, s in seeds.items()}
            for (a, b), v in edges[kind].items():
                new[b] = new.get(b, 0) + rank.get(a, 0) * v * url_filters.DAMPING
            rank = new
        score[kind] = rank
    return sorted((page, host, path, str(rule), verdict or ("block" if score[0].get(host, 0) >= url_filters.LEAST_DISTRUST and score[0].get(host, 0) > score[1].get(host, 0) else "allow")) for page, host, path, rule, verdict, _ in out)


def test_judge_equals_a_plain_walk_and_sql(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    got = url_filters.judge(pages, Scratch(spark, "t"))
    ours = sorted((r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got.collect())
    assert ours == by_hand(ROWS)
    assert ("block" in {r[4] for r in ours if r[3] == "None"}) and ("allow" in {r[4] for r in ours if r[3] == "None"})
    assert by_sql(pages) == ours


def by_sql(pages):
    own = duckdb.connect()  # a view of the same name would stay on the session's connection
    own.register("pages", pages.select("page_id", "url", "html").toArrow())
    return sorted((r[0], r[1], r[2], str(r[3]), r[4]) for r in own.execute(url_filters.oracle()).fetchall())


def test_judge_of_nothing(spark):
    assert url_filters.judge(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_plan_runs_no_python(spark):
    plan = url_filters.judge(spark.createDataFrame(ROWS, SCHEMA), Scratch(spark, "t"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_distrust_depends_on_own_links_and_reaches_its_end(spark):
    """Referrers of a much-linked blocked host are all blocked; a chain is blocked as far as converged scores reach."""
    rows = [(i, f"http://r{i}.org/", '<a href="http://bad.net/es/">', "h") for i in range(40)] + [(99, "http://bad.net/es/1", "", "h"), (98, "http://worse.net/fr/", "", "h")]
    rows += [(100 + i, f"http://c{i}.org/", f'<a href="http://{f"c{i - 1}.org" if i > 1 else "worse.net"}/">', "h") for i in range(1, 21)]
    judged = url_filters.judge(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert by_sql(spark.createDataFrame(rows, SCHEMA)) == sorted((r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in judged)
    got = {r["page_id"]: (r["verdict"], r["distrust"]) for r in judged}
    assert all(got[i][0] == "block" for i in range(40))
    for i in range(1, 21):
        score = (1 - url_filters.DAMPING) * url_filters.DAMPING**i
        assert abs(got[100 + i][1] - score) < 1e-5 and got[100 + i][0] == ("block" if score >= url_filters.LEAST_DISTRUST else "allow")
