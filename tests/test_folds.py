"""The request upgrade as minima and maxima, batch and stream, and greedy matching in rounds, against loops."""

import random
from collections import defaultdict

from wardline.operators import access, evaluate
from wardline.streaming import access as streaming

REQUEST = "role string, page string, ts int, event int, method string, n_params int, seen int"


def upgraded(rows):
    kept = {}
    for role, page, _, _, method, n, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        old = kept.get((role, page))
        method = method.upper()
        if old is None or old[0] == "GET" != method or not old[1] and n > 0:
            kept[role, page] = (method, n, (old[2] if old else 0) + 1)
        else:
            kept[role, page] = (*old[:2], old[2] + 1)
    return kept


def requests(rng, n):
    out = []
    for event in range(n):
        quiet = rng.random() < 0.7  # else a request that ends the matter
        method, params = rng.choice([("get", 0), ("GET", rng.randrange(1, 4)), ("POST", 0)]) if quiet or event % 3 else ("PUT", rng.randrange(1, 3))
        out.append((rng.choice(["u", "v", None]), f"p{rng.randrange(9)}", event // 3, event, method, params, 9))
    return out


def test_request_upgrade_equals_the_fold(spark):
    rng = random.Random(3)
    for n in (0, 9, 60, 200):
        rows = requests(rng, n)
        got = access.request_upgrade(spark.createDataFrame(rows, REQUEST), ["role", "page"], ["ts", "event"]).collect()
        assert {(r.role, r.page): (r.method, r.n_params, r.seen) for r in got} == upgraded(rows) and len(got) == len(upgraded(rows))
    turns = [("u", "p", i, i, *x, 0) for i, x in enumerate([("GET", 0), ("POST", 0), ("POST", 0), ("GET", 2), ("GET", 3), ("DELETE", 0), ("DELETE", 0), ("GET", 5), ("GET", 6)])]
    assert access.request_upgrade(spark.createDataFrame(turns, REQUEST), ["role", "page"], ["ts", "event"]).collect()[0][2:] == ("GET", 5, 9)


def test_streamed_upgrade_equals_the_batch(spark, tmp_path):
    rows = requests(random.Random(5), 150)
    for i in range(3):
        spark.createDataFrame(rows[i * 50 : i * 50 + 50], REQUEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.createDataFrame([], REQUEST).schema).parquet(f"{tmp_path}/in")
        out = streaming.upgraded_requests(stream, ["role", "page"], ["ts", "event"])
        seen = out.writeStream.outputMode("update").foreachBatch(streaming.upsert(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        seen.awaitTermination()
    last = {}
    for r in spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect():
        last[r.role, r.page] = (r.method, r.n_params, r.seen)
    assert last == upgraded(rows)


def by_turns(e, p):
    """Annotations in order take the best prediction left."""
    out, left = {}, defaultdict(list)
    for g, ord_, name, variants in sorted(p, key=lambda r: r[1]):
        left[g].append((ord_, name, name.lower(), variants))
    for g, ord_, name, key, variants in sorted(e, key=lambda r: r[1]):
        ranked = [(0 if h[2] == key else 1 if key in h[3] else 2 if set(variants) & set(h[3]) else 3, h[0], h) for h in left[g]]
        best = min(ranked, default=(3,), key=lambda r: r[:2])
        out[g, ord_, name] = best[2][1] if best[0] < 3 else None
        if best[0] < 3:
            left[g].remove(best[2])
    return out


def test_matching_in_rounds_equals_turns(spark):
    rng = random.Random(6)
    e, p = [], []
    for g, n in (("a", 12), ("b", 30), (None, 9), ("hot", 150)):
        word = lambda n=n: f"w{rng.randrange(n // 2 + 2)}"
        e += [(g, i, (x := word()), x, [word() for _ in range(rng.randrange(3))]) for i in range(n)]
        p += [(g, i, word(), [word() for _ in range(rng.randrange(3))]) for i in range(n)]
    got = evaluate.greedy_match(spark.createDataFrame(e, "app string, ord int, name string, key string, variants array<string>"), spark.createDataFrame(p, "app string, ord int, name string, variants array<string>"), ["app"])
    assert got.columns == ["app", "ord", "name", "prediction"]
    assert {(r.app, r.ord, r.name): r.prediction for r in got.collect()} == by_turns(e, p)


def test_matching_without_predictions(spark):
    e = spark.createDataFrame([("a", 1, "x", "x", ["x"])], "app string, ord int, name string, key string, variants array<string>")
    none = spark.createDataFrame([], "app string, ord int, name string, variants array<string>")
    assert [tuple(r) for r in evaluate.greedy_match(e, none, ["app"]).collect()] == [("a", 1, "x", None)]
    assert evaluate.greedy_match(e.limit(0), none, ["app"]).count() == 0
