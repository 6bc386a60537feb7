"""Each stage of the pipeline on its own input."""

import random

import corpus_pipeline
from llm_data import words
from wardline.llm import common


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    bad, passage = ["grumpfel", "snarkle"], words(rng, 60)
    docs, labels = [], []
    for i in range(300):
        w = words(rng, rng.randrange(20, 90))
        if i % 10 == 7:
            w[::4] = [rng.choice(bad) for _ in w[::4]]
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 10 == 7)))
    docs += [(400, docs[5][1], "en", "s0", 0), (401, docs[5][1] + " more", "en", "s1", 0), (402, " ".join(words(rng, 30) + passage), "en", "s2", 0), (403, " ".join(passage + words(rng, 40)), "en", "s2", 0), (404, None, None, None, None), (None, "no id", "en", "s1", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = common.table(spark, str(tmp_path), "documents")
    columns, kept = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(now.collect())
        assert k == 4 or now.columns == columns
    toxic, near, cut, mixed, packed = kept
    ids = [{r.doc_id for r in some} for some in kept]
    assert {d for d, *_ in docs} - ids[0] == set(range(7, 300, 10))
    assert ids[0] - ids[1] == {400, 401} and len(near) == len(toxic) - 2
    assert ids[2] == ids[1] and len({r.doc_id: r.text for r in cut}[403].split()) == 40
    assert ids[3] <= ids[2] and len(mixed) > 0
    assert {r.doc_id for r in packed} == ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_without_rows_and_with_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.createDataFrame([], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/none{k}")
        now = spark.read.schema(out.schema).parquet(f"{tmp_path}/none{k}")
        assert now.count() == 0
    rng = random.Random(4)
    a, b = " ".join(words(rng, 40)), " ".join(words(rng, 40))
    rows = [(1, a, "en", "s", 2), (1, a, "de", "s", 1), (2, b, "en", "s", 3), (2, a + " x", "en", "s", 3), (3, b, None, None, None), (4, None, "en", "s", 0), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (None, a, "en", "s", 7)]
    for n in (1, 4):
        got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(n), "").collect()
        assert sorted(map(str, got)) == sorted(map(str, [r for r in spark.createDataFrame([rows[1], rows[5], rows[7], rows[8]], schema).collect()]))
