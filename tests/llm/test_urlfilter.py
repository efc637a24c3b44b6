import pytest

from quirefold.llm import urlfilter as U


@pytest.mark.parametrize(
    "url, want",
    [
        (None, ("", "")), ("", ("", "")), ("no scheme.example.org/x", ("", "")), ("http://A.Example.ORG", ("a.example.org", "")),
        ("http://É.org/P?q=://b#f", ("É.org", "/P")), ("x://y://z/a", ("y:", "//z/a")), ("http://?q", ("", "")), ("http://h#/a", ("h", "")), ("http://u@h:80/a/b/#c", ("u@h:80", "/a/b/")), ("://", ("", "")),
        ("http://h/a\nb?c", ("h", "/a\nb")),
    ],
)
def test_parts(url, want):
    assert U.parts(url) == want


def brute_rule(host, path):
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.told), default=None)


def test_pages_match_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    got = U.judge(pages).collect()
    model = U.fit(U.labelled())
    assert len(got) == len(rows)
    for r in got:
        host, path = U.parts(rows[r.page_id])
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.told if rule else None)
        assert r.p_block == pytest.approx(model.probability(host, path))
        assert r.verdict == (rule.action if rule else "block" if r.p_block >= 0.5 else "allow")


@pytest.mark.parametrize(
    "url, rule",
    [
        ("http://org/", "org/"), ("http://org", None), ("http://a.org/x", "org/"), ("http://borg/x", None), ("http://example.org/es/1", "example.org/es/"),
        ("http://x.example.org/en/12", "example.org/en/1"), ("http://x.example.org/en/2", "org/"), ("http://notexample.org/es/1", "org/"), ("http://a.com/fr/", "com/fr/"), ("http://a.com/de/x", "com/de/"), ("http://a.com/en/", None), ("http://a.org./", None),
    ],
)
def test_longest_rule_wins(url, rule):
    host, path = U.parts(url)
    found = U.Judge(U.RULES, U.fit(U.labelled()), 0.5).rule(host, path)
    assert (found.told if found else None) == rule
    assert found == brute_rule(host, path)


def test_held_out_accuracy():
    rows = U.labelled()
    right = 0
    for k in range(8):
        model = U.fit([r for i, r in enumerate(rows) if i % 8 != k])
        right += sum((model.probability(*U.parts(u)) >= 0.5) == b for i, (u, b) in enumerate(rows) if i % 8 == k)
    assert right / len(rows) >= 0.8
    model = U.fit(rows)
    for host in ("blog.cheap-pills", "free-bets", "adult-x", "www.spam-farm", "m.ads-track", "blog.casino-win"):
        assert model.probability(f"{host}.example.net", "/en/123") >= 0.5, host
    for host in ("www.ththes", "m.tiontion", "blog.theran", "tionsh", "therwh", "m.thernd"):
        assert model.probability(f"{host}.example.net", "/en/123") < 0.5, host


def test_odd_rows(spark):
    rows = [(1, None, "v"), (1, None, "v"), (None, "http://org/", "v"), (2, "x" * 100_000, "v"), (3, "http://" + "a." * 2000 + "org/", "v")]
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == 5 and all(r.verdict in ("allow", "block") for r in got)
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
