import random
import re

from scorewatch.llm import url_filter as uf


BLOCKING = [re.compile(r.regex) for r in uf.PATTERN_RULES if r.verdict == "block"]


def judge(url):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in uf.DOMAIN_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
    if fits:
        won = max(fits, key=lambda r: len(r.name))
        return host, path, won.name, won.verdict
    hit = any(r.search(low) for r in BLOCKING)
    return host, path, None, "block" if hit else "allow"


def test_against_every_rule(spark):
    rnd = random.Random(1)
    hosts = ["a.net", "net", "evilnet", "WWW.example.NET", "example.net", "example.com", "x.example.com", "b.org", "org.uk",
             "spam-farm.example.com", "www.cheap-pills.io", "my-spam-farm.example.com", "m.casino-win.io",
             "pills-cheap.io", "win-win.io", "casino.win.io", "ads-track", "ÄB.org", ""]
    tails = ["", "/", "/en/", "/en", "/de/x", "/fr/1?q=/en/", "?x=1", "#top", "/ads/banner/1", "/ad/banner/", "/EN/",
             "/tracking/pixel.gif", "/p?utm_source=spam", "/p?utm_source=spammer", "//en/", "/p?utm_source=spam\n",
             "/p?x=1&click_id=warez#top", "/p?ref=spam-x", "/stats/count.js", "/stats/count"]
    urls = [f"{s}://{h}{t}" for s in ("http", "https") for h in hosts for t in tails]
    urls += [None, "", "no scheme", "a://b://c.net/", "line\nbreak://x.net/\n?", "http:///path"]
    urls += ["".join(rnd.choice("ab.:/?#-N") for _ in range(25)) for _ in range(300)]
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.url_filter(frame).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls)}


def test_index_uses_the_rarest_token():
    rules = [uf.PatternRule("block", "a-b", ("common", "rare")), uf.PatternRule("block", "c", ("common",))]
    assert uf.rarest_token_index(rules, {"common": 9, "rare": 1}) == {"rare": [0], "common": [1]}


def test_no_rules_no_rows_and_null_ids(spark):
    frame = spark.createDataFrame([(None, "http://a.net/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in uf.url_filter(frame, (), ()).collect()} == {"allow"}
    assert uf.url_filter(frame.limit(0)).collect() == []


def test_families_stand_for_their_rules():
    """The one expression of a family (used by the SQL) and its rules match the same URLs."""
    rnd = random.Random(2)
    for f in uf.FAMILIES:
        whole, rules = re.compile(f.any_of_them()), [re.compile(r.regex) for r in f.rules()]
        for _ in range(60):
            a, b = rnd.choice(f.a + ("other",)), rnd.choice(f.b + ("other",))
            for url in (f"http://x.{a}-{b}.io/", f"http://{b}-{a}.io/", f"http://x.io/?{a}={b}", f"http://x.io/{a}/{b}.gif"):
                assert bool(whole.search(url)) == any(r.search(url) for r in rules), url
    assert len(uf.PATTERN_RULES) > 2000 and len(set(uf.PATTERN_RULES)) == len(uf.PATTERN_RULES)


def test_long_url_and_unicode(spark):
    long = "http://a.io/" + "free-casino." * 20_000
    frame = spark.createDataFrame([(1, long), (2, "http://free-casino.io/" + "x" * 70_000), (3, "http://FREE-Casino.ñ/")],
                                  "page_id long, url string")
    assert {r.page_id: r.verdict for r in uf.url_filter(frame).collect()} == {1: "allow", 2: "block", 3: "block"}
