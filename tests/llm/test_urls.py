"""URL filter: splitting, rules, features, learnt verdicts, edge cases."""

import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from linden.llm import urls
from linden.llm.queries import QUERIES, URL_RULES
from tests.conftest import SMALL


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host)), default=None)


def test_split_and_rules_against_python(spark):
    samples = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(st.none() | st.lists(st.sampled_from(["http", "://", "example.com", "www.", "net", "org", "com", "/", "en/", "es/", "?", "#", "A.É", "\n", ":80", ".", "İ"]),
                               max_size=8).map("".join))
    def gather(url):
        samples.append(url)

    gather()
    samples += ["http://WWW.Example.COM/en/x", "http://com/", "http://com", "http://xcom/", "http://a.net/es/", "http://a.net/ES/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(samples)], "page_id long, url string, host string")
    rows = urls.with_rule(urls.split_url(pages), URL_RULES).collect()
    for r in rows:
        host, path = split(samples[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.rule_verdict) == ((rule.text, rule.verdict) if rule else (None, None))


def test_query_whole_table(spark):
    got = QUERIES["op6_url_filter"](spark, SMALL).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path = split(pages[r.page_id])
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == rule.verdict)
        assert 0 <= r.model_score <= 1


def test_model_learns_the_labels(spark):
    rows = [(f"http://h{i % 40}.example.net/{'es' if i % 3 else 'en'}/{i}{'?a=1&b=2' if i % 5 == 0 else ''}", int(bool(i % 3))) for i in range(400)]
    pages = urls.split_url(spark.createDataFrame(rows, "url string, label int"))
    model = urls.train(pages.where("hash(url) % 4 <> 0"), trees=5)
    judged = model.judge(pages.where("hash(url) % 4 = 0")).collect()
    right = [(r.model_verdict == "block") == (r.label == 1) for r in judged]
    assert len(right) > 50 and sum(right) / len(right) > 0.95


def test_features_against_python(spark):
    texts = ["https://a.b.com/x1/y22?q=1&r=2#f", "http://x", None, "", "aaaa", "http://é.com/𝄞"]
    pages = urls.split_url(spark.createDataFrame([(t,) for t in texts], "url string"))
    empty = spark.createDataFrame([], "kind string, key string, blocked double")
    for r in urls.with_features(pages, empty).collect():
        t = r.url or ""
        p = [n / len(t) for n in Counter(t).values()]
        assert math.isclose(r.entropy, -sum(x * math.log2(x) for x in p), abs_tol=1e-9)
        assert r.url_length == len(t) and r.path_depth == r.path.count("/")
        assert math.isclose(r.digit_ratio, sum(c in "0123456789" for c in t) / max(len(t), 1))
        q = t.split("?", 1)[1].split("#")[0] if "?" in t else ""
        assert r.parameters == (q.count("&") + 1 if q else 0)
        assert r.suffix_blocked == 0.5


def test_nulls_repeats_one_label_and_empty(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "no scheme", "y")], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "url string, host string, path string, label int")
    for labelled, verdict in ((none, "allow"), (spark.createDataFrame([("u", "h", "/", 1)], none.schema), "block")):
        rows = urls.filter_urls(pages, URL_RULES, urls.train(labelled)).collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [("", "", None, verdict)] * 3
    assert urls.filter_urls(pages.limit(0), URL_RULES, urls.train(none)).count() == 0


def test_statistics_count_every_labelled_url(spark):
    rows = [(f"http://h.site{i % 60}.net/p{i % 90}/{i}", int(i % 60 < 20)) for i in range(600)]
    pages = urls.split_url(spark.createDataFrame(rows + rows[:100], "url string, label int"))
    got = {(r.kind, r.key): r.blocked for r in urls.train(pages, most=50, trees=2).statistics.collect()}
    counts = Counter()
    for u, y in rows:
        for key in (("suffix", "net"), ("site", f"{u.split('/')[2][2:]}"), ("section", f"net/{u.split('/')[3]}")):
            counts[key, y] += 1
    keys = {k for k, _ in counts}
    assert got.keys() == keys and len(keys) == 151
    for k in keys:
        assert math.isclose(got[k], (counts[k, 1] + 2) / (counts[k, 0] + counts[k, 1] + 4))
