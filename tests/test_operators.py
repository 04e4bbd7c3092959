"""Edge cases of operators and functions that the test tables don't show."""

import json

import numpy as np
import pandas as pd
import pytest
import itertools

from pyspark.sql import functions as F

from mailsieve.functions import distance, scores, text, urls
from mailsieve.operators import domains
from mailsieve.operators import relational as r
from mailsieve.operators import similarity
from mailsieve.operators import rules
from mailsieve.sources import mime, sinks
from mailsieve.streaming import stateful


def one(spark, schema, row, col):
    return spark.createDataFrame([row], schema).select(col).first()[0]


@pytest.mark.parametrize(("u", "want"), [("HTTP://A.com/", "http://a.com"), ("a.com:8080/x?q#f", "http://a.com:8080/x?q#f"), ("//a.com", "http://a.com"), ("", None), ("http://", None), (" https://X.Y/Z ", "https://x.y/Z"), (None, None)])
def test_normalize_url(spark, u, want):
    assert one(spark, "u string", (u,), urls.normalize_url(F.col("u"))) == want


@pytest.mark.parametrize(("channels", "want"), [((None,) * 4, 0.0), ((100, None, None, None), 100.0), ((0, 0, 0, 0), 0.0), ((50, 100, None, None), (0.35 * 50 + 0.3 * 100) / 0.65)])
def test_weighted_average(spark, channels, want):
    c = dict(zip(("url", "header", "nlp", "attachment"), map(F.col, "uhna"), strict=True))
    assert one(spark, "u int, h int, n int, a int", channels, scores.weighted_average(c)) == pytest.approx(want)


def test_calibrated_or_keeps_bounds(spark):
    df = spark.createDataFrame([(u, h, n, a) for u in (None, -5, 150) for h in (None, 0, 80) for n in (None, 3, 100) for a in (None, 0, 100)], "u int, h int, n int, a int")
    c = dict(zip(("url", "header", "nlp", "attachment"), map(F.col, "uhna"), strict=True))
    assert df.where(~scores.calibrated_or(c).between(0, 100)).count() == 0
    assert df.where(~scores.noisy_or(c).between(0, 100)).count() == 0


def test_osa_known_vectors():
    assert [distance.osa(*x, 9) for x in (("ca", "abc"), ("kitten", "sitting"), ("", "abc"), ("abcd", "abdc"))] == [3, 3, 3, 1]
    assert distance.osa("aaaa", "bbbb", 2) == 3


@pytest.mark.parametrize("logic", ["", "[]", '{"all": []}', '{"signal": "x"}', '{"signal": "x", "op": "like"}', '{"category": "auth"}', "{"])
def test_bad_rules_are_errors(spark, logic):
    signals = rules.Signals(spark.createDataFrame([(1,)], "x int"), {"x": "x"})
    with pytest.raises(rules.RuleError):
        rules.compiled(logic, signals)


def test_rule_semantics(spark):
    df = spark.createDataFrame([("Fail", 5, True, None)], "s string, n int, b boolean, m string")
    signals = rules.Signals(df, {c: c for c in df.columns})
    cases = [("s", "eq", "FAIL", True), ("s", "gte", 3, True), ("s", "gt", 3, False), ("b", "gte", 1, True), ("n", "in", [1, 5], True), ("m", "neq", "x", False), ("m", "missing", None, True), ("zz", "missing", None, True), ("n", "eq", "5", False)]
    for s, op, v, want in cases:
        p, _ = rules.compiled(json.dumps({"signal": s, "op": op, "value": v}), signals)
        assert df.select(p).first()[0] is want, (s, op, v)


def test_tenant_view_fails_closed(spark):
    df = spark.createDataFrame([(1, True), (2, False), (None, True)], "org_id int, g boolean")
    assert r.tenant_view(df, None).count() == 0
    assert r.tenant_view(df, 0).count() == 0
    assert r.tenant_view(df, 2, shared="g").count() == 3


def test_upsert_null_keys_and_empty(spark):
    old = spark.createDataFrame([(None, 1), (1, 5)], "k int, v int")
    new = spark.createDataFrame([(None, 9), (2, 7)], "k int, v int")
    out = {(x.k, x.v, x.action) for x in r.upsert(old, new, ["k"], {"v": lambda o, n: F.greatest(o, n)}).collect()}
    assert out == {(None, 9, "updated"), (1, 5, "kept"), (2, 7, "inserted")}
    assert r.upsert(old.limit(0), new, ["k"], {}).count() == 2


def test_running_mean_rounds_each_step(spark):
    assert one(spark, "a array<bigint>", ([10, 11, 10],), r.running_mean(F.col("a"))) == 11
    mean, n = 0, 0
    for v in [10, 11, 10, 97, 3]:
        mean, n = int((mean * n + v) / (n + 1) + 0.5), n + 1
    assert one(spark, "a array<bigint>", ([10, 11, 10, 97, 3],), r.running_mean(F.col("a"))) == mean


def test_stream_folds():
    assert stateful.quota_fold(2, 3, 3) == (5, [True, False, False])
    assert stateful.limit_fold(None, [0, 10, 3600, 3700, 7300], 3600)[1] == [True, False, True, False, True]
    b = stateful.bucket_fold({}, {"component": "url", "score": 5.0, "payload": None})
    b = stateful.bucket_fold(b, {"component": "plan", "score": None, "payload": '["url", "nlp"]'})
    b = stateful.bucket_fold(b, {"component": "url", "score": 9.0, "payload": None, "degraded": True})
    assert stateful.missing(b) == ["nlp"]
    assert stateful.packaged(b, True) | {} == {"url_score": 5.0, "header_score": None, "nlp_score": None, "attachment_score": None, "missing": ["nlp"], "degraded": ["url"], "partial": True, "timed_out": True}


def test_mime_survives_garbage():
    assert mime.parsed("x", None)["attachments"] == []
    assert mime.parsed("x", b"\xff\xfe not mail")["id"] == "x"


def test_webhook_retries():
    calls = []

    def send(u, data):
        calls.append(data)
        if len(calls) < 3:
            raise OSError
        return True

    assert sinks.post("http://x", {"a": 1}, wait=0, send=send) and len(calls) == 3


def test_webhook_batch_posts_each_row(spark):
    """Over a local server: rows without recipients; a 5xx is tried again, a 4xx isn't."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            got.append(body)
            self.send_response(500 if body["id"] == 1 and got.count(body) == 1 else 404 if body["id"] == 2 else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = spark.createDataFrame([(i, ["a@b.c"]) for i in (1, 2, 3)], "id long, recipients array<string>")
        sinks.webhook_batch(f"http://127.0.0.1:{server.server_port}")(rows, 0)
    finally:
        server.shutdown()
    assert sorted(b["id"] for b in got) == [1, 1, 2, 3] and all(set(b) == {"id"} for b in got)


def test_closed_buckets(spark):
    plan = '["url", "header"]'
    rows = [(1, "whole", 0, "plan", plan), (1, "whole", 9, "url", None), (1, "whole", 20, "header", None), (1, "whole", 21, "url", None), (1, "late", 0, "url", None), (1, "late", 30, "plan", plan), (1, "late", 31, "header", None), (2, "whole", 0, "header", None), (2, "whole", 40, "plan", plan), (2, "none", 5, "plan", None)]
    m = spark.createDataFrame(rows, "org_id long, email_id string, s long, component string, payload string").withColumn("at", F.timestamp_seconds("s"))
    got = {(r.org_id, r.email_id): (r.status, r.missing, r.late) for r in stateful.closed_buckets(m, "at").collect()}
    assert got == {(1, "whole"): ("complete", [], 1), (1, "late"): ("partial", ["header"], 1), (2, "whole"): ("dropped", [], 1), (2, "none"): ("complete", [], 0)}


def test_looked_up_and_referenced(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    cache = spark.sql("SELECT * FROM VALUES ('a', 0, TIMESTAMP '2024-01-01 12:00:00'), ('a', 3, TIMESTAMP '2024-01-01 10:00:00'), ('b', 5, TIMESTAMP '2023-12-01 00:00:00') t(k, v, at)")
    answers = spark.createDataFrame([("a", 9), ("b", 0)], "k string, v int")
    got = r.looked_up(keys, "k", cache, answers, "v", "at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert {tuple(x) for x in got.collect()} == {("a", False, "cached"), ("b", False, "asked"), ("c", False, "skipped"), (None, False, "skipped")}
    kinds = spark.createDataFrame([("Phish",), ("odd",), (None,)], "kind string")
    got = r.referenced(kinds, "kind", spark.createDataFrame([("PHISH",), ("phish",)], "value string"))
    assert {tuple(x) for x in got.collect()} == {("phish", False), ("odd", True), (None, False)}


RULES = ["// list", "", "com", "uk", "co.uk  note", "*.ck", "!www.ck", "jp", "*.kawasaki.jp", "!city.kawasaki.jp"]
APEXES = {"a.b.example.com": "example.com", "Shop.Example.CO.UK": "example.co.uk", "x.uk": "x.uk", "co.uk": "co.uk", "a.b.www.ck": "www.ck", "a.b.c.ck": "b.c.ck", "c.ck": "c.ck", "x.city.kawasaki.jp": "city.kawasaki.jp", "x.y.z.kawasaki.jp": "y.z.kawasaki.jp", "no.rule.here": "rule.here", "localhost": "localhost", "10.1.2.3": "10.1.2.3", None: None}


def test_apex_by_suffix(spark):
    rules = domains.suffix_rules(spark.createDataFrame([(x,) for x in RULES], "value string"))
    rows = spark.createDataFrame([(h, 7) for h in [*APEXES, "x.uk"]], "host string, suffix int")
    got = domains.apex_by_suffix(rows, "host", rules).collect()
    assert len(got) == len(APEXES) + 1 and all(g.suffix == 7 for g in got)
    assert {g.host: g.apex for g in got} == APEXES


def test_containment_join_equals_nested_loop(spark):
    points = spark.range(0, 300000, 997).select(F.col("id").alias("ip"))
    ranges = spark.createDataFrame([(0, 10), (65530, 131080), (200000, 200000), (250000, 299999)], "low long, high long")
    want = points.join(ranges, F.col("ip").between(F.col("low"), F.col("high"))).count()
    assert r.containment_join(points, ranges, "ip", "low", "high").count() == want


def test_text_normalisation(spark):
    t = F.col("t")
    for f, cases in {
        text.fold_leet: {"p4ss w0rd 365": "pass word 365", "a10b 1a a$s p@$$": "a10b 1a ass p@$$", "": ""},
        text.join_spaced: {"v e r i f y it, U S A": "verify it, U S A", "a b c d": "abcd", "a b c": "a b c", "a\tb c\td e": "abcde", "x a b, c d e f g!": "x a b, cdefg!", "a  b c d": "a  b c d", "é à ü ö": "éàüö", "ab c d e f": "ab cdef", "I a m b o b": "Iambob"},
        text.normalize: {"": "", "ｖ ｅ ｒ ｉ f y": "verify", " a\u200b\n\u00a0b ": "a b", "p\u0430yp\u0430l l0gin": "paypal login"},
    }.items():
        for raw, want in cases.items():
            assert one(spark, "t string", (raw,), f(t)) == want, (f.__name__, raw)
    assert one(spark, "t string", (None,), text.normalize(t)) is None


def test_simhash_pairs_by_brute_force(spark):
    import random

    r_ = random.Random(3)
    base = [r_.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(80):
        h = r_.choice(base)
        for _ in range(r_.choice([0, 1, 2, 3, 5])):
            h ^= 1 << r_.randrange(64)
        rows.append((i, i % 2, h - (1 << 64) if h >> 63 else h))
    got = {(x.a, x.b): x.distance for x in similarity.simhash_pairs(spark.createDataFrame(rows, "id long, org int, h long"), "id", "org", "h").collect()}
    bits = {i: h & (1 << 64) - 1 for i, _, h in rows}
    assert all(a < b and d == (bits[a] ^ bits[b]).bit_count() <= 3 for (a, b), d in got.items())
    group = {i: i for i in bits}  # copies are linked with their smallest only, so groups are compared

    def find(x):
        return x if group[x] == x else find(group[x])

    want = dict(group)
    for (i, o, _), (j, q, _) in itertools.combinations(rows, 2):
        if o == q and (bits[i] ^ bits[j]).bit_count() <= 3:
            if bits[i] != bits[j] and (min(k for k, p, _ in rows if p == o and bits[k] == bits[i]), min(k for k, p, _ in rows if p == o and bits[k] == bits[j])) == (i, j):
                assert (i, j) in got
            want[find2(want, max(find2(want, i), find2(want, j)))] = min(find2(want, i), find2(want, j))
    for a, b in got:
        group[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: find(i) for i in group} == {i: find2(want, i) for i in want}


def find2(group, x):
    return x if group[x] == x else find2(group, group[x])


def test_packaged_batch_takes_first_scores(spark):
    from mailsieve.plans.streams import packaged_batch

    rows = [(1, "e", "plan", None, 1), (1, "e", "url", 9, 2), (1, "e", "url", 3, 3), (1, "f", "url", 5, 1), (2, "g", "plan", None, 4), (2, "g", "header", 7, 2), (2, "g", "url", 1, 9)]
    got = {x.email_id: (x.url_score, x.header_score, x.missing, x.partial) for x in packaged_batch(spark.createDataFrame(rows, "org_id int, email_id string, component string, score int, at int"), "at").collect()}
    assert got == {"e": (9, None, ["header"], True), "g": (1, 7, [], False)}


def test_campaign_upsert(spark):
    old = spark.createDataFrame([(1, 50, 3), (2, 10, 1)], "id int, risk_score int, email_count int")
    new = spark.createDataFrame([(1, 1, 90), (1, 2, 10), (3, 1, 7), (3, 2, 8)], "id int, at int, risk int")
    got = {x.id: (x.is_new, x.risk_score, x.email_count) for x in r.campaign_upsert(old, new, "id", "risk", ["at"]).collect()}
    assert got == {1: (False, 50, 5), 2: (False, 10, 1), 3: (True, 8, 2)}


def test_char_noise(spark):
    raw = "plain text with some letters " * 20
    noisy = lambda seed: one(spark, "t string", (raw,), text.char_noise(F.col("t"), F.lit(seed), 10, {"e": "3"}))
    assert noisy(1) == noisy(1) != noisy(2)
    assert 5 <= noisy(1).count("3") <= 40 and 0.9 * len(raw) < len(noisy(1)) < 1.1 * len(raw)
    assert one(spark, "t string", (None,), text.char_noise(F.col("t"), F.lit(1), 10, {"e": "3"})) is None


def test_locked_rows_and_cascades(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")
    changes, used = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string"), spark.createDataFrame([(2,), (2,), (None,)], "id int")
    assert {(x.id, x.name, x.refused) for x in r.refuse_locked(rows, changes, used, "id").collect()} == {(1, "x", False), (2, "b", True), (None, "c", False)}
    left = r.cascade_delete({"names": rows, "changes": changes}, used, "id")
    assert {x.id for x in left["names"].collect()} == {1, None} and {x.id for x in left["changes"].collect()} == {1}


def test_rate_limit_over_batches_cut_anywhere(spark, tmp_path):
    """Each user's rows lie in several files and Arrow batches, later ones first; the SQL's fold orders them all."""
    import __spark_entry__ as entry

    rows = [(i, (i * 7919) % 997 * 700, i % 3) for i in range(300)]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(5, "event_id")
    e.write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {tuple(r) for r in entry.queries()["X15_rate_limit_stream"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for user in range(3):
        mine = sorted((s, i) for i, s, u in rows if u == user)
        want |= set(zip([i for _, i in mine], stateful.limit_fold(None, [s for s, _ in mine], 3600)[1], strict=True))
    assert got == want


@pytest.mark.parametrize("run_rows", [4, 10, 1000])
def test_in_order_merges_runs_from_disk(run_rows):
    rng = np.random.default_rng(1)
    parts = [pd.DataFrame({"at": pd.to_datetime(rng.integers(0, 9, 6), unit="s"), "k": pd.array(rng.integers(0, 99, 6), "Int64")}) for _ in range(8)]
    parts[2].loc[1, "at"], parts[3].loc[2, "k"] = pd.NaT, pd.NA
    got = [tuple(x) for a in stateful.in_order(iter(parts), "at", "k", run_rows) for x in a.tolist()]
    every = pd.concat(parts)
    want = sorted((stateful.NO_KEY if pd.isna(t) else int(t.timestamp()) * 10**6, stateful.NO_KEY if pd.isna(k) else k) for t, k in zip(every["at"], every["k"], strict=True))
    assert got == want and list(stateful.in_order(iter([]), "at", "k")) == []
