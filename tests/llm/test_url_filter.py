import random
import re

from glyphline.llm import url_filter as U


def base(url):
    """Host, path and rule as the contract has them."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url[url.index("://") + 3 :]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def made():
    rng = random.Random(2)
    hosts = ["A.Example.net", "example.com", "b.example.com", "x.org", "notexample.net", "net", "my-org", "", "É.org", "u@h.com:80"]
    paths = ["", "/", "/en/1", "/en", "/de/x", "/de/12.html", "/fr/a/b/c/d/e/f", "//", "/fr/", "/en/0a1b2c3d4e5f"]
    tails = ["", "?q=/de/", "#top", "?a#b", "#a?b"]
    urls = [rng.choice(["http://", "HTTPS://", "://", "x:", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(600)]
    return urls + [None, "", "://", "no scheme", "http://net/\n/x", "http://a.net"] * 2


def test_host_path_rule(spark):
    urls = made()
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = U.judge(df).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = base(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]), urls[r.page_id]
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule[0])


def test_templates_learn_from_labels(spark):
    """Bad pages of one branch block the rest of it; ids become wildcards; branches alike are merged."""
    rows, labels = [], []
    for i in range(300):
        for part, bad in (("spam", 1), ("news", 0), ("blog", 0)):
            rows.append((len(rows), f"http://site.com/{part}/slug-{part}-{chr(97 + i % 26)}{chr(97 + i // 26)}x?x={i}"))
            if i % 3 == 0:
                labels.append((rows[-1][0], bad))
    rows += [(len(rows) + i, f"http://other.com/p/{i}") for i in range(50)]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "id long, bad int")).collect()}
    for i, url in rows:
        assert got[i].verdict == ("block" if "/spam/" in url else "allow"), (url, got[i])
    assert {got[i].template for i, u in rows if "/spam/" in u} == {"/spam/*"}
    assert len({got[i].template for i, u in rows if "/news/" in u or "/blog/" in u}) <= 2
    assert {got[i].template for i, u in rows if "other" in u} == {"/p/{n}"}


def test_a_small_labelled_branch_of_a_large_host_stays_apart(spark):
    """20+ branches, each with under 1/16 of the pages, one of them bad; its siblings labelled or not."""
    rows, labels = [], []
    for host, told in (("told.com", True), ("bare.com", False)):
        for b in range(26):
            part = "spam" if b == 7 else "b" + chr(97 + b)
            for i in range(12):
                rows.append((len(rows), f"http://{host}/{part}/{i}"))
                if i < 6 and (told or part == "spam"):
                    labels.append((rows[-1][0], int(part == "spam")))
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "id long, bad int")).collect()}
    for i, url in rows:
        assert got[i].verdict == ("block" if "/spam/" in url else "allow"), (url, got[i])
        assert got[i].template == ("/spam/{n}" if "/spam/" in url else "/*/{n}")


def test_rules_do_not_reach_the_branches_beside_them(spark):
    """A rule's few pages on a host with many branches; ruled and free branches are not one template."""
    urls = [f"http://example.com/de/{i}" for i in range(3)] + [f"http://example.com/{chr(97 + b)}x/{i}" for b in range(20) for i in range(4)]
    urls += [f"http://example.com/{part}/x" for part in ("", "a/de")]
    rules = (*U.RULES, *(("block", "many.com", f"/{chr(97 + b)}r/") for b in range(20)))
    urls += [f"http://many.com/{chr(97 + b)}{kind}/{i}" for b in range(20) for kind in "rf" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in U.judge(df, rules=rules).collect():
        assert r.verdict == ("allow" if r.rule is None else "block") and (r.rule is None) == (r.purity == 0.5), (urls[r.page_id], r)
        if "many" in urls[r.page_id]:
            assert r.template == ("/*/{n}" if r.rule is None else "/{ruled}/{n}")


def test_deep_branches_are_told_apart(spark):
    """Paths that differ only far down, one of them much longer than all others."""
    rows, labels = [], []
    for part, bad in (("spam", 1), ("news", 0)):
        for i in range(20):
            rows.append((len(rows), f"http://deep.com/a/b/c/d/e/f/{part}/{i}/x"))
            if i < 10:
                labels.append((rows[-1][0], bad))
    alone = "/".join(["q"] * 60) + "/"
    rows += [(len(rows), f"http://deep.com/{alone}"), (len(rows) + 1, "http://deep.com/a/b/c")]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=spark.createDataFrame(labels, "id long, bad int")).collect()}
    assert len(got) == len(rows)
    for i, url in rows:
        assert got[i].verdict == ("block" if "/spam/" in url else "allow"), (url, got[i])
    assert {got[i].template.split("/f/")[1] for i, u in rows if "/f/" in u} == {"spam/{n}/x", "news/{n}/x"}
    assert [got[i].template for i, u in rows if u.endswith("q/")] == ["/*/" + alone.removeprefix("q/")]


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
