from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from sightline.llm import grace_dedup, sharding, url_reputation

SCHEMA = "doc_id long, text string, kept string, gid int, `row` string"


def _docs(spark, n=400, seed=1):
    r = random.Random(seed)
    pool = ["", None, "Abc", "aBC", "ABC é", "abc É", "x" * 50_000, "tail\n", " tail"] + [f"w{i % 60} Text" for i in range(90)]
    rows = [(None if r.random() < 0.05 else r.randrange(200), r.choice(pool), "k", i, "r") for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def _expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").encode().lower()].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


def test_groups_equal_brute_force_even_when_everything_spills(spark):
    rows, df = _docs(spark)
    want, n_groups = _expected(rows)
    for window, table in ((1 << 20, 1 << 20), (2_000, 300)):
        got = grace_dedup.exact_groups(df.repartition(5), window_bytes=window, table_bytes=table).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
        assert sum(r.kept for r in got) == n_groups
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_kept_rows_have_the_columns_of_the_input(spark):
    rows, df = _docs(spark)
    kept = grace_dedup.drop_exact_duplicates(df, table_bytes=500)
    assert kept.columns == df.columns
    assert kept.count() == _expected(rows)[1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert grace_dedup.exact_groups(empty).count() == 0
    assert grace_dedup.drop_exact_duplicates(empty).count() == 0
    assert sharding.shuffle_into_shards(empty).count() == 0


def test_recursion_splits_by_digest_and_not_by_copies(tmp_path):
    records = [(hashlib.sha256(t).digest(), t, [(i, i, 1)]) for i, t in enumerate([b"same" * 100] * 50 + [bytes([i]) * 400 for i in range(60)])]
    parts = list(grace_dedup.grace_groups(iter(records), 2_000, 0, str(tmp_path)))
    sizes = sorted(len(m) for _, groups in parts for m in groups)
    assert sizes == [1] * 60 + [50] and len(parts) > 3


def test_shards_are_a_permutation_with_equal_counts(spark):
    rows, df = _docs(spark, 503)
    got = sharding.shuffle_into_shards(df.repartition(3), n_shards=7, bucket_bytes=20_000).collect()
    assert sorted((r.row.gid for r in got)) == list(range(503))
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r["size"] == len((r.row.text or "").encode()) + 8
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_shuffle_mixes(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    at = {r.row.doc_id: r.shard for r in sharding.shuffle_into_shards(df, 10).collect()}
    first = sum(at[i] == 0 for i in range(200))
    assert 5 < first < 45  # about 20 of the first 200 rows in any shard
    assert sum(abs(at[i] - at[i + 1]) for i in range(1999)) / 1999 > 2.5


def test_fewer_rows_than_shards(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "doc_id long, text string")
    got = sharding.shuffle_into_shards(df, 24).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (1, 0), (2, 0)]
    assert zlib.crc32(b"") == 0


def test_urls(spark):
    urls = [None, "", "nowhere", "https://A.Example.com/en/7x", "http://b.example.com/en/1?q", "http://x.net/de/1#f", "http://x.example.net/de/81", "ftp://org/es/", "http://exampleXcom/en/7", "http://b.example.com", "http://b.example.com/fr/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_reputation.judge_urls(df).collect()}
    assert [(got[i].host, got[i].path) for i in range(5)] == [("", ""), ("", ""), ("", ""), ("a.example.com", "/en/7x"), ("b.example.com", "/en/1")]
    assert [got[i].rule for i in range(3, 9)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None]
    assert [got[i].verdict for i in range(3, 8)] == ["allow", "block", "allow", "block", "block"]
    assert got[9].path == "" and got[9].rule is None
    assert url_reputation.judge_urls(df.limit(0)).count() == 0


def test_reputation_shrinks_small_hosts_towards_their_domain(spark):
    rows = [("big.bad.com", 1)] * 60 + [("new.bad.com", None)] + [("a.good.org", 0)] * 60 + [("one.good.org", 1)] + [(None, None)]
    got = {r.site: r for r in url_reputation.site_reputation(spark.createDataFrame(rows, "site string, outcome int").fillna({"site": ""})).collect()}
    assert got["big.bad.com"].lower_bound > 0.5 and got["a.good.org"].block_probability < 0.1
    assert got["new.bad.com"].block_probability > 0.5 > got["one.good.org"].lower_bound


def test_reputation_keeps_registered_domains_apart(spark):
    bad, good = [("x.bad.co.uk", 1)] * 40, [("y.good.co.uk", 0)] * 40
    rows = [*bad, *good, ("new.bad.co.uk", None), ("new.good.co.uk", None), *[("10.0.0.1", 1)] * 40, ("10.0.0.2", None)]
    got = {r.site: r for r in url_reputation.site_reputation(spark.createDataFrame(rows, "site string, outcome int")).collect()}
    assert got["new.bad.co.uk"].block_probability > 0.6 > 0.4 > got["new.good.co.uk"].block_probability
    assert got["10.0.0.1"].block_probability > got["10.0.0.2"].block_probability
    hosts = ["u:p@A.com:80", "a.com.", "[::1]:80", "a.com:", "b@c@d.com", ""]
    sites = url_reputation.with_site(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert [r.site for r in sites] == ["A.com", "a.com", "[::1]", "a.com", "d.com", ""]


def test_urls_equal_the_sql(spark):
    urls = [None, "nowhere", "http://u@a.co.uk:80/en/x", "http://b.co.uk/de/", "http://10.1.2.3:8080/x", "http://[::1]:9/x", "http://x.net/de/1#f", "http://x.example.net/de/81", "http://b.example.com./en/1", "http://" + "a." * 3000 + "com/en/" + "p" * 5000]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls * 3)] + [(None, urls[2], "h")], "page_id long, url string, host string")
    got = url_reputation.judge_urls(df)
    pages = df.toPandas()  # noqa: F841
    want = duckdb.sql(url_reputation.ORACLE).fetchall()
    columns = [c[0] for c in duckdb.sql(url_reputation.ORACLE).description]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(((None if x[0] != x[0] else x[0], *x[1:]) for x in want), key=repr)
