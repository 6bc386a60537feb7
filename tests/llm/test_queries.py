"""The registered queries of media, toxicity, search, packing and archives against brute force, and on empty tables."""

import hashlib
import math
import random
import statistics
import zlib

import numpy as np
from llm_data import words
from wardline.llm import ann, media, packing, toxicity, warc


def documents(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, media string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def cosine_hash(payload):
    """The low cosine coefficients by their sums, for rows of 64 samples; bits above the median without the constant one."""
    pixels = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    h = len(pixels)
    if h >= 32:
        edges = [i * h // 32 for i in range(32)] + [h]
        tall = [[sum(pixels[r][x] for r in range(a, b)) / (b - a) for x in range(64)] for a, b in zip(edges, edges[1:], strict=False)]
    else:
        tall = [list(map(float, pixels[i * h // 32])) for i in range(32)]
    small = [[(row[2 * x] + row[2 * x + 1]) / 2 for x in range(32)] for row in tall]
    weight = lambda k: math.sqrt((1 if k == 0 else 2) / 32)
    wave = [[weight(k) * math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return f"{int(''.join('1' if c > middle else '0' for c in low), 2):016x}"


def test_media_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = ["", None, "a", "b" * 64, "c" * 65, "é" * 40, " ".join(words(rng, 300)), " ".join(words(rng, 30)), " ".join(words(rng, 4000)), "y" * 200_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, texts[6]), (None, "a")]
    got = {(r.doc_id, r.n_bytes): r for r in media.op2_query(spark, documents(spark, tmp_path, rows)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert len(payload) > 60_000 or r.feature == cosine_hash(payload)


def test_toxicity_query(spark, tmp_path):
    rng = random.Random(2)
    bad = ["idiot", "scum", "trash"]
    rows = [(i, " ".join(words(rng, 30) + (["you", rng.choice(bad)] * 3 if i % 2 else []))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, rows[1][1]), (1003, rows[1][1]), (None, rows[1][1]), (1004, " ".join(words(rng, 60_000)))]
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = toxicity.op3_query(spark, documents(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    tested = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == r.doc_id % 2 for r in tested) >= 0.95 * len(tested)
    assert len({r.score for r in got if r.doc_id in (1, 1003)}) == 1 and len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1


def test_toxicity_query_without_rows_or_labels(spark, tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "a" / "labels.parquet"))
    assert [r.score for r in toxicity.op3_query(spark, documents(spark, tmp_path / "a", [(1, "x"), (2, None)])).collect()] == [0.0, 0.0]
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "b" / "labels.parquet"))
    assert toxicity.op3_query(spark, documents(spark, tmp_path / "b", [])).count() == 0


def test_search_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (720, [0.0] * 8), (740, [float("nan")] + [1.0] * 7), (741, [float("inf")] * 8), (760, [None] + [1.0] * 7), (None, [1.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {}
    for r in ann.op5_query(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = x.astype(np.float32).astype(np.float64)
    found = 0
    assert set(got) == set(range(0, 600, 20))
    for q, rows_ in got.items():
        score = x @ x[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:20]
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21)) and all(math.isclose(s, score[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, s in rows_)
        assert [(-s, i) for _, i, s in rows_] == sorted((-s, i) for _, i, s in rows_)
        found += len({i for _, i, _ in rows_} & set(best))
    assert found >= 0.9 * 20 * len(got)


def test_packing_query_is_whole(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 120)))) for i in range(60)] + [(100, None), (101, ""), (102, " ".join(words(rng, 3000))), (103, "é ü 你好 x")]
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*full.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    pieces, sequences = {}, {}
    for r in packing.op6_query(spark, documents(spark, tmp_path, rows)).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at, whole in [(pieces, {i: len(x) for i, x in ids.items()}), (sequences, None)]:
        for key, spans in at.items():
            end = 0
            for start, length in sorted(spans):
                assert start == end and length > 0
                end += length
            assert end == whole[key] if whole else end <= 4096
    assert set(pieces) == set(ids)


def test_archive_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    same, short = "<p>" + "same " * 60, "<p>short"
    rows = [(i, f"http://h/{i}", rng.choice([same, short, same + "!", f"<p>{' '.join(words(rng, 40))}"])) for i in range(80)]
    rows += [(900, None, same), (901, "u", None), (902, "u", ""), (903, "u", "é" * 49), (904, "u", "é" * 50), (905, "u", "é" * 50)]
    spark.createDataFrame([(*r, 1, b"p") for r in rows], "page_id long, url string, html string, first int, payload binary").write.parquet(str(tmp_path / "pages.parquet"))
    first, want = {}, []
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        body = (h or "").encode()
        to = first.setdefault(body, i) if len(body) >= 100 else i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    assert sorted(map(tuple, warc.op9_query(spark, str(tmp_path)).collect())) == want


def test_archive_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op9_query(spark, str(tmp_path)).count() == 0
