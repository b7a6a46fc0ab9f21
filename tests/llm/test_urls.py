"""URL parts and rules against a plain version, segmentation against all splits, and learned verdicts."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from tidemark.llm import urls as U
from tidemark.llm.queries import op6_url_filter

URLS = [
    None, "", "no scheme", "http://", "http://Example.COM", "https://www.example.com/en/x?q=/net/", "http://a.example.com/en/", "http://example.com/en", "http://notexample.com/en/1",
    "ftp://x.net/es/a#b", "http://x.net/fr/", "http://x.net?/es/", "a://b://c/d", "http://É.com/A?b", "http://com/x", "http://www.example.com/en/../", "://h/p", "http://x.org/\n/y",
]


def plain(url):
    rest = (url or "").partition("://")[2]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best, verdict = None, None
    for v, rule in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best or ""):
            best, verdict = rule, v
    return host, path, best, verdict


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>some words</p>", "x") for i, u in enumerate(URLS)] + [(None, URLS[4], None, "x")], "page_id long, url string, html string, host string")
    rows = U.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = plain(URLS[r["page_id"] if r["page_id"] is not None else 4])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["odds"] > 0 else "allow"))


def test_segmentation_finds_the_likeliest_split():
    rnd = random.Random(1)
    words = {w: rnd.randint(1, 50) for w in "a an ana na nab ban bana b n".split()}
    own = U.Segmenter(words)

    def cost(parts):
        return sum(own.cost.get(p, own._unknown(len(p))) for p in parts)

    def splits(name):
        return [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in splits(name[k:])] if name else [[]]

    for _ in range(60):
        name = "".join(rnd.choices("abnx", k=rnd.randint(1, 9)))
        assert math.isclose(cost(own.split(name)), min(map(cost, splits(name)))) and "".join(own.split(name)) == name
    assert own.split("") == ()


def test_word_counts(spark):
    html = ["<p>The the</p><script>no('p')</script><style>no{}</style><!-- no -->end<br/>x2y", None, ""]
    got = dict(map(tuple, U.word_counts(spark.createDataFrame([(h,) for h in html], "html string")).collect()))
    assert got == {"the": 2, "end": 1, "x": 1, "y": 1}


def test_without_evidence_all_is_allowed(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a", None), (2, None, "")], "page_id long, url string, html string")
    assert {r["verdict"] for r in U.judge(pages).collect()} == {"allow"}
    assert U.judge(pages.limit(0)).collect() == []


def test_bayes_agrees_with_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    words = U.vocabulary(pages)
    segmenter = U.Segmenter(words)
    rows = pages.select(*U.host_and_path(F.col("url"))).collect()
    n = {v: [0] * U.SLOTS for v in ("allow", "block")}
    seen = {"allow": 0, "block": 0}
    for host, path in rows:
        verdict = U.rule_for(host, path, U.ByHost(U.RULES))[1]
        if verdict:
            seen[verdict] += 1
            for s in U.url_slots(host, path, segmenter):
                n[verdict][s] += 1
    size = sum(a + b > 0 for a, b in zip(n["allow"], n["block"], strict=True))
    model = U.fit(pages.select(*(c.alias(x) for c, x in zip(U.host_and_path(F.col("url")), ("host", "path"), strict=True))), words)
    assert math.isclose(model.prior, math.log(seen["block"] / seen["allow"]))
    for s in range(0, U.SLOTS, 97):
        told = math.log((n["block"][s] + 1) / (sum(n["block"]) + size)) - math.log((n["allow"][s] + 1) / (sum(n["allow"]) + size))
        assert math.isclose(model.weights[s], told, abs_tol=1e-5)


def test_query_on_all_pages(spark):
    sf = "/root/testdata/sf0.001"
    rows = op6_url_filter(spark, sf).collect()
    told = {r["page_id"]: plain(r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(told)
    for r in rows:
        assert (r["host"], r["path"], r["rule"]) == told[r["page_id"]][:3] and r["verdict"] in (told[r["page_id"]][3],) if r["rule"] else r["verdict"] in ("allow", "block")


def test_all_words_split_hosts(spark):
    rnd = random.Random(7)
    rare = {"".join(rnd.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(60_000)}  # each once, as the words of the hosts
    html = f"<p>{' '.join(sorted(rare))} zebra finch donaudampfschifffahrt museum</p>"
    pages = spark.createDataFrame([(1, "http://zebrafinch.org/a", html), (2, "http://donaudampfschifffahrtmuseum12.de/", ""), (3, "http://12.34/", None), (4, None, "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["host_words"] for r in U.judge(pages).collect()}
    assert got == {1: "zebra finch org", 2: "donaudampfschifffahrt museum 00 de", 3: "00 00", 4: ""}


def test_hosts_are_split_as_by_the_whole_vocabulary(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    segmenter = U.Segmenter(U.vocabulary(pages))
    for r in U.judge(pages).select("host", "host_words").distinct().collect():
        assert r["host_words"] == " ".join(U.host_words(r["host"], segmenter))


def test_visible_text_is_found_in_one_pass():
    rnd = random.Random(2)
    pattern = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    parts = ["<", ">", "<!--", "-->", "<script", "<script>", "</script>", "</SCRIPT >", "<style a=b>", "</style", "</style\n>", "a", " ", "<b>", "--", "!", "<scripts>"]
    for _ in range(3000):
        html = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert U.visible(html) == pattern.sub(" ", html), html
    start = time.time()
    for part in ("<!--", "<", "<script>", "<style", "<!-- >", "</script"):
        U.visible(part * (1_000_000 // len(part)))
    assert time.time() - start < 20


def test_hostile_hosts(spark):
    long = "ab" * 20_000
    words = "word " * 3 + "w" * 40 + " " + "w" * 41 + " " + "x" * 33
    pages = spark.createDataFrame([
        (1, f"http://{long}.com/", words), (2, "http://" + "a." * 20_000 + "net/es/", words), (3, f"http://{'w' * 40}word{'x' * 33}.org/", words),
    ], "page_id long, url string, html string")
    start = time.time()
    rows = {r["page_id"]: r for r in U.judge(pages).collect()}
    assert time.time() - start < 120 and rows[2]["verdict"] == "block" and rows[3]["host_words"].split()[:3] == ["w" * 40, "word", "x" * 33]
