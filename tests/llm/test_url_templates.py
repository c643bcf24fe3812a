import re

import pytest
from tenure.llm import url_templates as u


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for verdict, domain, start in u.RULES:
        if (host == domain or host.endswith("." + domain)) and path.startswith(start):
            if best is None or len(domain + start) > len(best[0]):
                best = (domain + start, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme/net/", "http://a.net/x", "HTTP://A.NET/x?y=/en/", "http://net/", "http://net", "http://anet/x", "http://example.net/en/1",
    "http://b.example.net/en/", "http://b.example.net/en", "http://example.net/de/1", "http://notexample.net/en/1", "https://x.example.com/de/9#f",
    "http://example.com/en/9", "http://a.org/fr/1", "http://a.org/fr?x", "http://org/fr/", "http://ÀB.org/fr/", "ftp://a.net:80/x", "x://y://z.net/a",
    "http://a.net\n/x", "http://?q", "http://#f", "://net/a", "http://user@a.net/x",
]


def test_hosts_paths_and_rules(frame):
    rows = [(i, url) for i, url in enumerate(URLS)] + [(2, URLS[2])]
    out = {r["page_id"]: r for r in u.judge_urls(frame("page_id long, url string", rows)).collect()}
    assert len(out) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = brute_host_path(url)
        assert (out[i]["host"], out[i]["path"]) == (host, path), url
        rule, verdict = brute_rule(host, path)
        assert out[i]["rule"] == rule, url
        assert out[i]["verdict"] == (verdict or "allow"), url


def test_variable_segments_become_wildcards(frame):
    urls = [f"http://h.com/news/{i}" for i in range(5)] + [f"http://h.com/news/{i}.html" for i in range(3)] + [f"http://h.com/u/name-{c}/posts" for c in "abcdefghijklmnopqrstuvwxyz"]
    urls += ["http://h.com/d/2024-01-02/x", "http://h.com/a/b/c/d/e/f/g", "http://h.com/", "http://h.com"]
    out = {r["url"]: r["template"] for r in u.judge_urls(frame("page_id long, url string", list(enumerate(urls)))).collect()}
    assert out["http://h.com/news/3"] == "/news/{number}" and out["http://h.com/news/1.html"] == "/news/{number}.html"
    assert out["http://h.com/u/name-a/posts"] == "/u/{any}/posts"
    assert out["http://h.com/d/2024-01-02/x"] == "/d/{date}/x"
    assert out["http://h.com/a/b/c/d/e/f/g"] == "/a/b/c/d/e/{tail}"
    assert out["http://h.com/"] == out["http://h.com"] == "/"


@pytest.fixture
def labelled(frame):
    urls = [f"http://h.com/spam{k}/{i}" for k in range(3) for i in range(30)] + [f"http://h.com/good/{i}" for i in range(40)]
    pages = frame("page_id long, url string", list(enumerate(urls)))
    known = [(url, "spam" in url) for url in urls[::2]] + [(None, True), ("http://h.com/good/1", None)]
    return pages, frame("url string, unwanted boolean", known)


def test_similar_branches_merge_and_impure_templates_are_rejected(labelled):
    pages, labels = labelled
    out = u.judge_urls(pages, labels, rules=[]).collect()
    assert {r["verdict"] for r in out if "spam" in r["url"]} == {"block"}
    assert {r["verdict"] for r in out if "good" in r["url"]} == {"allow"}
    assert len({r["template"] for r in out}) >= 2
    one = next(r for r in out if "good" in r["url"])
    assert one["purity"] == pytest.approx((0 + u.PRIOR * u.PRIOR_WEIGHT) / (20 + u.PRIOR_WEIGHT))


def test_branches_with_equal_labels_share_a_template(frame):
    urls = [f"http://h.com/{k}/{i}" for k in ("left", "right") for i in range(20)]
    labels = frame("url string, unwanted boolean", [(url, i % 2 == 0) for i, url in enumerate(urls)])
    out = u.judge_urls(frame("page_id long, url string", list(enumerate(urls))), labels, rules=[]).collect()
    assert {r["template"] for r in out} == {"/{similar}/{number}"}


def test_branches_below_the_fifth_segment_are_told_apart(frame):
    urls = [f"http://h.com/a/b/c/d/e/{k}/{i}/x/y" for k in ("spam", "good") for i in range(20)]
    labels = frame("url string, unwanted boolean", [(url, "spam" in url) for url in urls[::2]])
    out = u.judge_urls(frame("page_id long, url string", list(enumerate(urls))), labels, rules=[], depth=None).collect()
    assert {("spam" in r["url"], r["verdict"], r["template"]) for r in out} == {
        (True, "block", "/a/b/c/d/e/spam/{number}/x/y"), (False, "allow", "/a/b/c/d/e/good/{number}/x/y"),
    }


def test_a_branch_of_a_rule_does_not_block_its_siblings(frame):
    urls = [f"http://example.com/de/{i}" for i in range(6)] + [f"http://example.com/s-{chr(97 + i)}/{i}" for i in range(26)]
    out = u.judge_urls(frame("page_id long, url string", list(enumerate(urls)))).collect()
    assert {("/de/" in r["url"], r["verdict"], r["template"]) for r in out} == {(True, "block", "/de/{number}"), (False, "allow", "/{any}/{number}")}


def test_empty_table_and_clashing_columns(frame):
    assert u.judge_urls(frame("page_id long, url string", [])).count() == 0
    out = u.judge_urls(frame("page_id long, url string, HOST int, n int, step int, steps int", [(1, "http://a.net/x", 1, 2, 3, 4)] * 2))
    assert out.columns == ["page_id", "url", "n", "step", "steps", "host", "path", "rule", "verdict", "template", "purity"]
    assert [(r["host"], r["n"], r["steps"]) for r in out.collect()] == [("a.net", 2, 4)] * 2
