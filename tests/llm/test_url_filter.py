from lodemap.llm.url_filter import Rules, Vocabulary, judge_urls, split_url


def test_split():
    cases = {
        None: ("", ""), "": ("", ""), "no scheme": ("", ""), "http://A.Com": ("a.com", ""), "http://a.com?x=/y": ("a.com", ""), "x://a/b/c?d#e": ("a", "/b/c"),
        "x://a#/b": ("a", ""), "http://a.com:80/x://y": ("a.com:80", "/x://y"), "://": ("", ""), "h://\u00c9.com/": ("\u00c9.com", "/"),
    }
    assert {u: split_url(u) for u in cases} == cases


def test_longest_rule_wins():
    rules = Rules([("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")])
    assert rules.find("a.example.com", "/en/1") == ("example.com/en/", "block")
    assert rules.find("x.www.example.com", "/en/") == ("www.example.com/en/", "allow")
    assert rules.find("myexample.com", "/en/1") == ("com/", "allow")
    assert rules.find("example.com", "") == (None, None) and rules.find("a.net", "/esx") == (None, None) and rules.find("", "/") == (None, None)


def test_terms_need_boundaries():
    v = Vocabulary(["casino"], ["ads", "track"])
    assert v.count("http://x/casino") == (1, 0) and v.count("http://xcasino/") == (0, 0) and v.count("http://x/CASINO-1") == (1, 0)
    assert v.count("ads.ads/track") == (0, 2) and v.count("roads/track2") == (0, 0) and v.count(None) == (0, 0) and Vocabulary([], []).count("x") == (0, 0)


def test_rows(spark):
    rows = [(1, "http://m.casino-x.org/"), (1, "http://m.casino-x.org/"), (2, None), (3, ""), (None, "http://ads-track.org/"), (4, "http://ads.org/"), (5, "http://x.net/es/a")]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in judge_urls(df).collect()), key=str)
    want = [(1, "m.casino-x.org", None, "block")] * 2 + [
        (2, "", None, "allow"), (3, "", None, "allow"), (4, "ads.org", None, "allow"), (5, "x.net", "net/es/", "block"), (None, "ads-track.org", None, "block"),
    ]
    assert got == sorted(want, key=str)
    assert judge_urls(df.limit(0)).count() == 0
