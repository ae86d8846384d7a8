import random
import re

from callboard.llm import url_filter

from frames import multiset

URLS = [
    "https://www.example.org/es/1?x=://a.com/",
    "http://example.org/en/17#top",
    "HTTP://Sub.EXAMPLE.org/en/2",
    "http://example.org",
    "http://example.org?/es/",
    "http://notexample.org/es/",
    "https://A.B.com/fr/x",
    "https://a.com/de/x?y=1&z=2",
    "https://a.com/FR/x",
    "https://a.com.net/de/",
    "://com/de/#x",
    "no scheme example.org/es/",
    "",
    None,
    "ftp://xn--é.org/ü?q#f",
    "http://a.com:80/de/",
    "http://org/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(h + p), h + p, action)
        for action, h, p in [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
                             ("allow", "com", "/fr/"), ("block", "com", "/de/")]
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, rule, action = max(fits, default=(0, None, None))
    return host, path, rule, action


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def labelled(spark, n=600):
    random.seed(2)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        name = "".join(random.choices("abcdefgh", k=8))
        tail = "".join(random.choices("0123456789", k=12)) if bad else name
        rows.append((f"http://{name}.{'biz' if bad else 'net'}/{tail}", int(bad)))
    return spark.createDataFrame([*rows, (None, 1), ("http://x.net/", None)], "url string, block int")


def test_hosts_paths_and_rules(spark):
    rows = url_filter.verdicts(pages(spark, URLS), labelled(spark)).collect()
    assert len(rows) == len(URLS)
    for row in rows:
        host, path, rule, action = brute(URLS[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == action if action else row.verdict in ("allow", "block")


def test_trees_learn_what_the_labels_show(spark):
    train, held = labelled(spark), labelled(spark, 900).where("block is not null and url is not null")
    judge = url_filter.fit(train)
    judged = judge(url_filter.split_url(held)).collect()
    right = sum((r.judged == "block") == bool(r.block) for r in judged)
    assert right / len(judged) > 0.95


def test_sample_counts_copies_and_is_the_same_for_any_order(spark):
    urls = [f"http://h{i}.net/" for i in range(5000)]
    rows = [(u, i % 2) for i, u in enumerate(urls)] + [("http://hot.net/", 1)] * 3000 + [("http://hot.net/", 0)] * 10
    df = spark.createDataFrame(rows, "url string, block int")
    found = {(r.url, r._label): r._weight for r in url_filter.sampled(df, sample=100).collect()}
    order = df.distinct().selectExpr("url", "cast(block AS double) AS b").selectExpr("url", "b", "xxhash64(url, b) AS h").orderBy("h").limit(100)
    assert found.keys() == {(r.url, r.b) for r in order.collect()}
    assert found == {(r.url, r._label): r._weight for r in url_filter.sampled(df.orderBy("url"), sample=100).collect()}
    whole = {(r.url, r._label): r._weight for r in url_filter.sampled(df).collect()}
    assert len(whole) == 5002 and sum(whole.values()) == len(rows) and whole["http://hot.net/", 1.0] == 3000


def test_without_labels_or_rows(spark):
    none = labelled(spark).limit(0)
    assert {r.verdict for r in url_filter.verdicts(pages(spark, ["http://a.net/"]), none).collect()} == {"allow"}
    assert url_filter.verdicts(pages(spark, URLS).limit(0), labelled(spark)).collect() == []


def test_clashing_columns_and_repeated_rows(spark):
    df = pages(spark, ["http://a.net/x"] * 3).selectExpr("*", "1 AS Host", "2 AS path")
    rows = url_filter.split_url(df).collect()
    assert multiset((r.host, r.path) for r in rows) == multiset([("a.net", "/x")] * 3)


def test_features(spark):
    df = url_filter.lexical(url_filter.split_url(pages(spark, ["http://a-b.c0.net/x/y1?p=1&q=2#f", "", None, "aaaa"])))
    rows = {r.page_id: r for r in df.collect()}
    first = rows[0]
    assert (first._depth, first._labels, first._parameters, first._hyphens, first._suffix) == (2, 3, 2, 1, "net")
    assert abs(first._digits - 4 / 32) < 1e-9 and 3 < first._entropy < 5
    assert rows[1]._entropy == rows[2]._entropy == rows[3]._entropy == 0


def test_statistics_cover_rows_outside_the_sample(spark):
    tails = ["net", "com", "info"]
    rows = [(f"http://h{i}.{tails[i % 3]}/", int(i % 5 == 0)) for i in range(3000)] + [("http://x.biz/1", 1)] * 7 + [("http://y.biz/", 0)]
    df = spark.createDataFrame(rows, "url string, block int")
    judge = url_filter.fit(df, sample=40)
    assert judge.overall == 607 / 3008
    found = {r._suffix: (r._suffix_count, r._suffix_rate) for r in judge.suffixes.collect()}
    for tail in [*tails, "biz"]:
        own = [block for url, block in rows if f".{tail}/" in url]
        count, rate = found.pop(tail)
        assert count == len(own) and abs(rate - (sum(own) + 20 * 607 / 3008) / (len(own) + 20)) < 1e-12
    assert not found


def test_rare_labels_are_in_the_sample(spark):
    allowed = [(f"http://h{i}.net/", 0) for i in range(5000)]
    df = spark.createDataFrame([*allowed, *[(f"http://h{i}.biz/", 1) for i in range(8)]], "url string, block int")
    chosen = url_filter.sampled(df, sample=100).collect()
    assert len(chosen) == 100 and sum(r._label == 1 for r in chosen) == 5
    new = pages(spark, ["http://new.biz/", "http://new.net/"])
    assert [r.verdict for r in url_filter.verdicts(new, df).orderBy("page_id").collect()] == ["block", "allow"]
    judge = url_filter.fit(df, sample=100)
    assert judge.model is not None and judge.overall == 8 / 5008
    judged = {r.page_id: r.judged for r in judge(url_filter.split_url(new)).collect()}
    assert judged == {0: "block", 1: "allow"}


def own_suffixes(spark, first, n):
    """Urls with a suffix of their own each; digits in the path say block in four of five."""
    rng = random.Random(first)
    rows = []
    for i in range(first, first + n):
        digits = rng.random() < 0.5
        block = digits if rng.random() < 0.8 else not digits
        path = "".join(rng.choices("0123456789" if digits else "abcdefgh", k=8))
        rows.append((f"http://host.s{i:06}x/{path}", int(block)))
    return spark.createDataFrame(rows, "url string, block int")


def test_a_suffix_of_its_own_proves_nothing(spark):
    judge = url_filter.fit(own_suffixes(spark, 0, 2000))
    trees = judge.model.stages[-1]
    importance = dict(zip(url_filter.FEATURES, trees.featureImportances.toArray()))
    assert importance["_suffix_rate"] + importance["_suffix_count"] < 0.1
    judged = judge(url_filter.split_url(own_suffixes(spark, 10_000, 500))).collect()
    assert sum((r.judged == "block") == bool(r.block) for r in judged) / len(judged) >= 0.75


def test_statistics_of_fitted_urls_leave_out_their_fold(spark):
    rows = [(f"http://h{i}.{'net' if i % 3 else 'com'}/", int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "url string, block int")
    folds = {r.url: r.f for r in df.select("url", url_filter.fold_of("url").alias("f")).collect()}
    found = {(r._suffix, r._fold): r for r in url_filter.of_other_folds(url_filter.suffix_counts(df), 0.25).collect()}
    for suffix in ("net", "com"):
        for fold in range(url_filter.FOLDS):
            others = [block for url, block in rows if f".{suffix}/" in url and folds[url] != fold]
            row = found[suffix, fold]
            assert row._suffix_count == len(others) and abs(row._suffix_rate - (sum(others) + 5) / (len(others) + 20)) < 1e-12


def test_columns_named_like_features_stay(spark):
    judge = url_filter.fit(labelled(spark))
    names = ["_features", "_suffix_rate", "_prediction", "_kept", "_url", "_suffix", "judged"]
    df = pages(spark, URLS).selectExpr("*", *(f"'{n}!' AS `{n}`" for n in names))
    out = judge(url_filter.split_url(df))
    rows = {r.page_id: r for r in out.collect()}
    plain = {r.page_id: r.judged for r in judge(url_filter.split_url(pages(spark, URLS))).collect()}
    assert {i: r.judged for i, r in rows.items()} == plain and len(rows) == len(URLS)
    assert all(r[n] == f"{n}!" for r in rows.values() for n in names[:-1])


def test_equal_rules_are_decided_by_name_and_action(spark):
    rules = [url_filter.Rule("block", "net", "/a"), url_filter.Rule("allow", "net", "/a"), url_filter.Rule("block", "net", "/")]
    rows = url_filter.verdicts(pages(spark, ["http://x.net/ab", "http://x.net/b"]), labelled(spark), rules).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [("net/a", "allow"), ("net/", "block")]
