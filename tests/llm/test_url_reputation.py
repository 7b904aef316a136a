from pyspark.sql import functions as F

from rooftop.llm import url_reputation as U
from rooftop.llm.queries import URL_RULES

PAGES = "page_id long, url string"


def split_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[:end]


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)).text if fits else None


ODD = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://A.Example.COM/en/1?x#y"), (6, "x://net/es/"),
       (7, "http://www.example.com/en/"), (8, "http://xexample.com/en/"), (9, "ftp://a.net/fr"), (10, "a://b://c.net/es/"),
       (11, "http://user@h.co.uk:80?q"), (12, "http://1.2.3.4:9/a"), (13, "http://é.Example.com/é?"), (13, "http://net/fr/x"),
       (None, "http://com/\nx"), (14, "http://" + "a" * 100_000 + ".net/es/" + "b" * 100_000), (15, "http://x.com.#/")]


def test_rules_on_odd_urls_without_labels(spark):
    pages = spark.createDataFrame(ODD, PAGES).withColumn("host", F.lit("clash")).withColumn("verdict", F.lit(1))
    outcomes = spark.createDataFrame([], "page long, bad int")
    rows = U.judge_urls(pages, outcomes, URL_RULES).collect()
    want = sorted(((p, *split_url(u), brute_rule(*split_url(u))) for p, u in ODD), key=repr)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in rows), key=repr) == want
    by_text = {r.text: r.verdict for r in URL_RULES}
    assert all(r.verdict == by_text.get(r.rule, "allow") for r in rows)


def test_evidence_blocks_a_host_and_not_its_siblings(spark):
    pages = [(i, f"http://bad.site.org/{i}") for i in range(40)] + [(100 + i, f"http://good.fine.org/{i}") for i in range(40)] \
        + [(200, "http://new.site.org/"), (201, "http://once.org/")]
    outcomes = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(201, 1), (201, None), (None, 1), (999, 1)]
    got = U.judge_urls(spark.createDataFrame(pages, PAGES), spark.createDataFrame(outcomes, "page long, bad int"), [])
    verdict = {r.page_id: (r.verdict, r.bad_rate_low) for r in got.collect()}
    assert verdict[3][0] == "block" and verdict[103][0] == "allow"
    assert verdict[201][0] == "allow"  # one bad page is not evidence enough
    assert verdict[100][1] < verdict[200][1] < verdict[3][1]  # a new host leans on its domain


def test_posteriors_shrink_towards_parents(spark):
    rows = [("a.x.com", "x.com", "com", 100, 90), ("b.x.com", "x.com", "com", 1, 0), ("c.y.com", "y.com", "com", 100, 5),
            ("d.y.com", "y.com", "com", 0, 0)]
    df = spark.createDataFrame(rows, "host_key string, domain string, suffix string, n long, k long")
    rate = {r.host_key: r.a / (r.a + r.b) for r in U.host_posteriors(df).collect()}
    assert 0.5 < rate["a.x.com"] < 0.9 and 0 < rate["b.x.com"] < rate["a.x.com"]
    assert rate["d.y.com"] < 0.3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page long, bad int")
    assert U.judge_urls(spark.createDataFrame([], PAGES), none, URL_RULES).count() == 0


def test_suffix_tables(spark):
    rules = ["com", "uk", "co.uk", "or.jp", "*.ck", "!www.ck", "github.io", " ", "GOUV.fr."]
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.or.jp": ("y.or.jp", "or.jp"), "b.a.x.ck": ("a.x.ck", "x.ck"),
             "www.ck": ("www.ck", "ck"), "q.www.ck": ("www.ck", "ck"), "me.github.io": ("me.github.io", "github.io"), "x.io": ("x.io", "io"),
             "localhost": ("localhost", "localhost"), "1.2.3.4": ("1.2.3.4", "(address)"), "": ("", ""), "a.mairie.gouv.fr": ("mairie.gouv.fr", "gouv.fr")}
    df = spark.createDataFrame([(h, 1) for h in hosts], "host_key string, n int")
    got = {r.host_key: (r.domain, r.suffix) for r in U.with_suffixes(df, rules).collect()}
    assert got == hosts
    pages = spark.createDataFrame([(i, f"http://u{i % 4}.github.io/{i}") for i in range(80)], PAGES)
    outcomes = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "page long, bad int")
    verdict = {r.page_id % 4: r.verdict for r in U.judge_urls(pages, outcomes, [], suffixes=rules).collect()}
    assert verdict == {0: "block", 1: "allow", 2: "allow", 3: "allow"}
