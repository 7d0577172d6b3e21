import math
import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from candidata.llm import url_filter
from candidata.llm.queries import RULES


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, marks: s[: min([s.find(m) for m in marks if m in s] or [len(s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    best = None
    for verdict, rule in RULES:
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best


URLS = [
    None, "", "no scheme", "http://", "://x.org/", "HTTP://A.Example.ORG/es/1", "http://example.org/en/1", "http://example.org/en/2", "http://xexample.org/es/",
    "http://org/", "http://org", "http://a.org?x=/es/", "http://a.com/fr/#f", "http://a.com/fr", "http://a.com/de/x", "http://b.net/a/b-c.html?u=1&v=2#t",
    "a\nb://c.com/de/\n?q", "http://x.org/a://b.com/de/", "http://É.COM/de/", "http://user@h.com:80/de/",
]


def pages_of(spark, urls):
    rows = [(i, u, "h", "old", "x") for i, u in enumerate(urls)]
    rows += rows[3:6] + [(None, urls[5], "h", "old", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, tokens string")


def test_given_rules(spark):
    pages = pages_of(spark, URLS)
    labels = spark.createDataFrame([(None, 1, 0), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = url_filter.judge_urls(pages, labels, RULES).collect()
    assert len(rows) == pages.count()
    for r in rows:
        host, path = brute_parts(r["url"])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == ((rule[1], rule[0]) if rule else (None, "allow"))
    assert url_filter.judge_urls(pages.limit(0), labels, RULES).collect() == []


def brute_mine(baskets, support, confidence):
    found, n = {}, len(baskets)
    tokens = sorted({t for b, _ in baskets for t in b})
    for size in range(1, 7):
        for items in combinations(tokens, size):
            has = [v for b, v in baskets if set(items) <= set(b)]
            for verdict in url_filter.VERDICTS:
                k = has.count(verdict)
                if k and k >= support * n - 1e-9 and k >= confidence * len(has) - 1e-9:
                    found[items, verdict] = (k / len(has), k / n)
    return {
        (items, v): c
        for (items, v), c in found.items()
        if not any((items[:i] + items[i + 1 :], v) in found and found[items[:i] + items[i + 1 :], v][0] >= c[0] for i in range(len(items)))
    }


def test_mining_and_matching_equal_brute_force(spark):
    draw = random.Random(8)
    urls = []
    for i in range(240):
        host = draw.choice(("a", "b", "spam")) + "." + draw.choice(("net", "io"))
        urls.append(f"http://{host}/{draw.choice(('x', 'y', 'win'))}/{i}" + draw.choice(("", "#f")))
    bad = [("spam" in u and "win" in u) or draw.random() < 0.15 for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    tokens = dict(pages.select("url", url_filter.tokens_of(F.col("url"))).collect())
    baskets = [(i, tokens[u], "block" if b else "allow") for i, (u, b) in enumerate(zip(urls, bad))]
    labelled = spark.createDataFrame(baskets, "page long, tokens array<string>, verdict string")
    least = 10 + math.ceil(math.sqrt(240))
    classes = url_filter.token_classes(labelled, least)
    class_of = dict(map(tuple, classes.collect()))
    pages_of_token = {}
    for i, b, _ in baskets:
        for t in b:
            pages_of_token.setdefault(t, set()).add(i)
    same = {t: min(x for x, p in pages_of_token.items() if p == pages_of_token[t]) for t in pages_of_token}
    assert class_of == {t: c for t, c in same.items() if len(pages_of_token[t]) >= least} and len(set(class_of.values())) < len(class_of)
    confidence = 0.6
    expected = brute_mine([(b, v) for _, b, v in baskets], least / 240, confidence)
    got = {(tuple(r["items"]), r["verdict"]): r["confidence"] for r in url_filter.mine(labelled, classes, least, confidence).collect()}
    in_classes = {(tuple(sorted({class_of[t] for t in items})), v): c[0] for (items, v), c in expected.items()}
    assert got.keys() == in_classes.keys() and all(abs(got[k] - in_classes[k]) < 1e-9 for k in got)
    verdicts = {r["url"]: r["verdict"] for r in url_filter.judge_urls(pages, labels, ()).collect()}
    for u in urls:
        best = max(((c, s, v) for (items, v), (c, s) in expected.items() if set(items) <= set(tokens[u])), default=(0, 0, "allow"))
        assert verdicts[u] == best[2]
    assert {v for u, v in verdicts.items() if "spam" in u and "win" in u} == {"block"}


def test_tokens_that_always_come_together_are_one_item(spark):
    """Forty pages with the same thirty query names: two to the thirtieth combinations, were they mined one by one."""
    names = "&".join(f"name{k}=1" for k in range(30))
    urls = [f"http://site{i % 7}.net/p/x{i % 9}" + (f"?{names}" if i < 40 else "") for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i < 40 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    start = time.time()
    rows = url_filter.judge_urls(pages, labels, ()).collect()
    assert time.time() - start < 60
    assert {r["page_id"] for r in rows if r["verdict"] == "block"} == set(range(40))
    # Any of the names is a sign of the rule, as each was mined on the same pages.
    new = spark.createDataFrame([(1, "http://new.org/q?name7=2"), (2, "http://new.org/q?nameless=2")], "page_id long, url string")
    both = pages.union(new.withColumn("page_id", F.col("page_id") + 1000))
    assert {r["verdict"] for r in url_filter.judge_urls(both, labels, ()).filter("page_id = 1001").collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.judge_urls(both, labels, ()).filter("page_id = 1002").collect()} == {"allow"}


def test_planted_spam_is_found(spark):
    """Spam hosts and paths with noisy labels: nearly all of their pages are blocked, hardly any other."""
    draw = random.Random(3)
    words, urls, spam = [f"w{k}" for k in range(200)], [], []
    for i in range(6000):
        kind = draw.random()
        host = f"deals{draw.randint(1, 3)}.biz" if kind < 0.04 else f"h{draw.randint(1, 300)}.{draw.choice(('org', 'net'))}"
        path = ["casino", "win"] if 0.04 <= kind < 0.07 else [draw.choice(words), draw.choice(words + ["casino", "win"])]
        urls.append(f"https://{host}/{'/'.join(path)}/{i}")
        spam.append(kind < 0.07)
    bad = [draw.random() < (0.9 if s else 0.1) for s in spam]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    labelled = [(i, 0 if b else 1, 0) for i, b in enumerate(bad) if i % 2]
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    blocked = {r["page_id"] for r in url_filter.judge_urls(pages, labels, ()).filter("verdict = 'block'").collect()}
    held_out = [i for i in range(6000) if i % 2 == 0]
    caught = sum(i in blocked for i in held_out if spam[i]) / sum(spam[i] for i in held_out)
    false = sum(i in blocked for i in held_out if not spam[i]) / sum(not spam[i] for i in held_out)
    assert caught > 0.9 and false < 0.01, (caught, false)


def test_a_very_long_url(spark):
    long = "http://x.org/" + "a/" * 50_000 + "?" + "&".join(f"k{i}=v" for i in range(5000))
    pages = spark.createDataFrame([(1, long), (2, "http://y.org/")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages, labels, RULES).collect()}
    assert rows[1]["host"] == "x.org" and rows[1]["path"] == "/" + "a/" * 50_000 and rows[2]["verdict"] == "allow"
