from motiontab.llm import urlfilter

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))


def run(spark, urls):
    df = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)], "page_id int, url string, host string, verdict int")
    return [tuple(r)[1:5] for r in urlfilter.judge(df, RULES).orderBy("page_id").collect()]


def test_rules_parts_and_terms(spark):
    cases = [
        (None, ("", "", None, "allow")),
        ("", ("", "", None, "allow")),
        ("no scheme casino", ("", "", None, "block")),
        ("http://A.Example.COM/en/x?q=1", ("a.example.com", "/en/x", "example.com/en/", "block")),
        ("http://www.example.com/en/x#z", ("www.example.com", "/en/x", "www.example.com/en/", "allow")),
        ("http://x.www.example.com/en/", ("x.www.example.com", "/en/", "www.example.com/en/", "allow")),
        ("http://notexample.com/en/", ("notexample.com", "/en/", "com/", "allow")),
        ("http://casino.com/", ("casino.com", "/", "com/", "allow")),
        ("http://casino.com?x", ("casino.com", "", None, "block")),
        ("ftp://h.net/es/1", ("h.net", "/es/1", "net/es/", "block")),
        ("http://cheap-pills.example.org/", ("cheap-pills.example.org", "/", None, "block")),
        ("http://cheap-cheap.example.org/", ("cheap-cheap.example.org", "/", None, "allow")),
        ("http://cheappills.example.org/", ("cheappills.example.org", "/", None, "allow")),
        ("http://e.org/SPAM", ("e.org", "/SPAM", None, "block")),
        ("http://e.org/antispam9", ("e.org", "/antispam9", None, "allow")),
        ("://?a://b", ("", "", None, "allow")),
        ("http://e.org/" + "a" * 100_000 + "/xxx", ("e.org", "/" + "a" * 100_000 + "/xxx", None, "block")),
    ]
    assert run(spark, [u for u, _ in cases]) == [w for _, w in cases]


def test_weights_overlaps_and_ties(spark):
    weights = {"ab": 1.0, "ab-cd": 0.5, "cd": 0.5, "cd-ef": 3.0, "x": 1.0}
    rows = [(None, "http://ab-cd.org"), (1, "http://ab.org/x"), (1, "http://ab.org/AB"), (1, "http://cd.org/ef"), (2, "http://a.org/cd-ef"), (2, None), (2, "http://xab.org/cdx")]
    df = spark.createDataFrame([(i, u, "n", "r") for i, u in rows], "page_id int, url string, n_soft string, rule string")
    rules = (("block", "a.org", "/"), ("allow", "org", "/cd-"), ("block", "org", "/cd-"))
    got = sorted(((r.page_id or 0, r.host, r.rule or "", r.verdict, r.n_strict, r.n_soft) for r in urlfilter.judge(df, rules, weights).collect()))
    assert got == sorted([(0, "ab-cd.org", "", "block", 0, 3), (1, "ab.org", "", "block", 0, 2), (1, "ab.org", "", "allow", 0, 1), (1, "cd.org", "", "allow", 0, 1), (2, "a.org", "org/cd-", "allow", 1, 1), (2, "", "", "allow", 0, 0), (2, "xab.org", "", "allow", 0, 0)])


def test_the_table_of_terms():
    terms = urlfilter.terms_of()
    assert len(terms) > 150 and all(t == t.lower() and t.isalnum() for t in terms) and {w for w in terms.values()} == {0.75, 1.5, 2.0}


def test_empty_table(spark):
    assert run(spark, []) == []
