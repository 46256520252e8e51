from paperloom.llm import url_filter
from paperloom.llm.queries import URL_RULES

CASES = [
    ("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/de/5", "x.com", "/de/5", "com/de/", "block"),
    ("http://org", "org", "", None, None), ("http://x.org?a=/", "x.org", "", None, None), ("x.org/a", "", "", None, None), (None, "", "", None, None),
    ("", "", "", None, None), ("http://É.ORG/", "É.org", "/", "org/", "allow"), ("http://x.net/a\nb?c", "x.net", "/a\nb", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None), ("http://x.org:80/", "x.org:80", "/", None, None),
]


def frame(spark, extra=()):
    rows = [(i, c[0], "z") for i, c in enumerate(CASES)] + list(extra)
    return spark.createDataFrame(rows, "page_id long, url string, host string")


def test_rules_and_parts(spark):
    got = {r.page_id: r for r in url_filter.judge(frame(spark), URL_RULES).collect()}
    assert len(got) == len(CASES)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), CASES[i]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trees_learn_what_the_labels_show(spark):
    """Long urls with digits are blocked, short ones allowed; unlabelled urls of the same kinds follow."""
    extra = []
    for i in range(120):
        extra.append((1000 + i, f"http://s{i}.com/de/{i * 7919 % 100000}{i * 104729}?id={i}&p={i * 31}&q=1", None))
        extra.append((2000 + i, f"http://good.org/page{chr(97 + i % 26)}", None))
        extra.append((3000 + i, f"http://u{i}.net/xx/{i * 6151 % 100000}{i * 99991}?id={i}&p={i * 17}&q=1", None))
        extra.append((4000 + i, f"http://fine.net/page{chr(97 + i % 26)}", None))
    got = {r.page_id: r.verdict for r in url_filter.judge(frame(spark, extra), URL_RULES).collect()}
    assert sum(got[3000 + i] == "block" for i in range(120)) > 100 and sum(got[4000 + i] == "allow" for i in range(120)) > 100


def test_one_sided_labels_and_empty_table(spark):
    one = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://b.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(one, URL_RULES).collect()] == ["allow"] * 3
    assert url_filter.judge(one.limit(0), URL_RULES).count() == 0
