import random
import re

from pyspark.sql import functions as F

from corpuswright.llm import url_filter as u


def plain(rows, rules=u.RULES, default="allow"):
    out = []
    for i, url in rows:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, default))
        out.append((i, host, path, *best[2:]))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert result(u.op6_url_filter(spark, sf_dir)) == plain(rows)


URLS = [None, "", "x", "http://", "http://ORG/", "http://org", "http://example.org/en/12?x#y", "https://a.example.org/es/", "http://notexample.org/es/", "http://a.com/fr/1", "http://COM/de/?q", "http://a.com?/fr/", "http://a.com#/de/", "ftp://x.y://z.org/", "://org/", "http://É.org/É", "http://a..org/", "http://org./", "http://.org/a", "http://a.com:80/fr/"]


def test_odd_rows(spark):
    rows = [*enumerate(URLS), (None, URLS[5]), (3, URLS[6]), (3, URLS[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' as host", "1 as keys")
    assert result(u.judge(pages)) == plain(rows)
    assert result(u.judge(pages, (), "block")) == plain(rows, (), "block")
    assert u.judge(pages.limit(0)).count() == 0


def test_cascade_is_exact_with_false_positives(spark):
    r = random.Random(5)
    names = [f"h{i}.{t}" for i in range(3000) for t in ("com", "org")]
    rules = tuple((r.choice(["allow", "block"]), h, r.choice(["/", "/a", "/ab/"])) for h in r.sample(names, 700))
    rows = [(i, f"http://{r.choice(['', 'www.'])}{r.choice(names)}{r.choice(['/', '/a', '/ab/c', ''])}") for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    assert result(u.judge(pages, rules)) == plain(rows, rules)
    keys = u.with_keys(u.parsed(pages), [1, 2], [1, 2, 4]).select(F.explode("keys").alias("k"))
    listed = {v: spark.createDataFrame([(h + p,) for w, h, p in rules if w == v], "k string") for v in ("allow", "block")}
    for first_bits in (1, 3, 24):
        levels = u.cascades(listed, keys, first_bits)
        assert first_bits == 24 or all(len(x) > 2 for x in levels.values())
        for v, df in listed.items():
            told = {r.k for r in keys.distinct().where(u.member(levels[v], F.col("k"))).collect()}
            assert told == {r.k for r in df.collect()} & {r.k for r in keys.collect()}


def test_long_hosts_and_many_rules(spark):
    many = 1_500_000
    rules = spark.range(many).selectExpr("if(id % 3 = 0, 'block', 'allow') as verdict", "concat('H', id, '.net') as host", "if(id % 2 = 0, '/', '/a/') as path")
    long = "a." * 5000 + "h9.net"
    rows = [(i, f"http://x.h{i * 977}.net/{'a/' if i % 3 else 'b'}") for i in range(2000)] + [(-1, f"http://{long}/a/"), (-2, "http://" + "z" * 100_000 + ".net/a/"), (-3, "http://h9.net/" + "a/" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in u.judge(pages, rules).collect()}

    def want(n, path):
        own = "/" if n % 2 == 0 else "/a/"
        return (f"h{n}.net{own}", "block" if n % 3 == 0 else "allow") if n < many and path.startswith(own) else (None, "allow")

    assert all(got[i] == want(i * 977, "/a/" if i % 3 else "/b") for i in range(2000))
    assert [got[i] for i in (-1, -2, -3)] == [want(9, "/a/"), (None, "allow"), want(9, "/a/")]
