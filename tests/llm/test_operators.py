"""Operators against brute force, round trips and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_data import words
from wardline.llm import ann, html, media, mixing, packing, rollups, substring, toxicity, warc
from wardline.llm.common import connected_components, scratch, stored

# ---------------------------------------------------------------- connected components


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(20, 40)] + [(3, 7), (1, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys([3, 7, *range(20, 40)], 3)}


# ---------------------------------------------------------------- media


def test_png_filters_round_trip():
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (9, 64), dtype=np.uint8)
    kinds = np.array([4, 1, 2, 2, 3, 0, 4, 1, 3], np.uint8)
    lines = np.empty_like(pixels)
    for r, kind in enumerate(kinds):
        up = pixels[r - 1].astype(int) if r else np.zeros(64, int)
        left, corner = np.append(0, pixels[r, :-1]).astype(int), np.append(0, up[:-1])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines[r] = (pixels[r].astype(int) - [0, left, up, (left + up) // 2, paeth][kind]) % 256
    assert (media.unfilter(kinds, lines) == pixels).all()


def test_png_rejects_damage():
    png = media.encode_png(b"a" * 128)
    assert media.decode_png(png).tobytes() == b"a" * 128
    for at in (3, 20, len(png) // 2, len(png) - 3):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(png[:-12])


def test_media_columns(odd_docs, no_docs):
    for r in media.decode(media.encode(odd_docs)).collect():
        assert len(r.payload) % 64 == 0 and len(r.payload) > 0 and not any(r.payload[r.n_bytes :])
    got = Counter(bytes(r.payload[: r.n_bytes]).decode() for r in media.decode(media.encode(odd_docs)).collect())
    assert got == Counter(r.text or "" for r in odd_docs.collect())
    assert media.decode(media.encode(no_docs)).count() == 0


# ---------------------------------------------------------------- packing


def test_piece_encoder_is_the_tokenizer(odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    from wardline.llm.common import text_buffer

    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    full, made = Tokenizer.from_file(path), packing.PieceEncoder(path)
    texts = [r.text or "" for r in odd_docs.collect()] + ["It's A<|endoftext|>b x1y22z ''s 'S can't-stop?! \x1c\x7f Ünï ﬁ Å", "THE the The,the 10,000.5 <|STARTOFTEXT|>"]
    for _ in range(2):
        assert [x.tolist() for x in made.encode(*text_buffer(pa.array(texts)))] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_encoder_beyond_its_memory(monkeypatch):
    """Texts with more distinct pieces than a worker remembers."""
    import public_tokenizers
    from tokenizers import Tokenizer
    from wardline.llm.common import text_buffer

    import pyarrow as pa

    monkeypatch.setattr(packing, "MOST_KNOWN", 100)
    path = public_tokenizers.path("word_bpe_49k.json")
    full, made = Tokenizer.from_file(path), packing.PieceEncoder(path)
    rng = random.Random(6)
    texts = [" ".join(words(rng, 700)), "a b a b", " ".join("é" + w for w in words(rng, 300)), ""]
    assert [x.tolist() for x in made.encode(*text_buffer(pa.array(texts)))] == [full.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(made.known) <= 100


def test_sum_of_squares_rule():
    levels, counts = packing.LevelArray(10), Counter()
    rng = random.Random(2)
    for _ in range(300):
        size = rng.randrange(1, 11)
        options = {0: 0} | {h: 0 for h in counts if counts[h] and h + size <= 10}

        def after(h, size=size):
            c = Counter(counts)
            if h:
                c[h] -= 1
            if h + size < 10:
                c[h + size] += 1
            return sum(v * v for v in c.values())

        _, h = levels.place(size)
        assert h in options and after(h) == min(after(x) for x in options)
        if h:
            counts[h] -= 1
        if h + size < 10:
            counts[h + size] += 1


def test_packing_is_whole(odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    items = stored(packing.pieces(odd_docs, path), "pieces")
    rows = packing.pack(items, part_items=4).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for r in odd_docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            part = np.array(ids[s : s + 4096], "<u4")
            want[(r.doc_id, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for some in by.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(stored(packing.pieces(no_docs, path), "none")).count() == 0


def test_packing_pads_little(spark):
    rng = random.Random(4)
    rows = [(i, 0, n, 0, n) for i in range(4000) for n in [rng.randrange(1, 3000)]]
    items = spark.createDataFrame(rows, "id long, start long, length long, ids_crc32 long, doc_tokens long")
    got = packing.pack(items, part_items=500).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in got) == sum(r[2] for r in rows)
    assert len(got) * 4096 < 1.03 * sum(r[2] for r in rows)


# ---------------------------------------------------------------- mixing


def test_mixing_targets_by_resharing(spark, odd_docs):
    rng = random.Random(9)
    sizes = {f"s{i:02}": rng.choice([0, 3, 50, 4000, 90000]) + rng.randrange(50) for i in range(9)} | {None: 70}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, total, free = {}, float(sum(sizes.values())), set(sizes)
    while True:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    assert got == pytest.approx(target)


def test_mixing_takes_the_budget(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    assert None in by
    for some in by.values():
        assert sum(r.taken for r in some) == int(some[0].target)
        cut = [r for r in some if r.size and r.taken % r.size]
        assert len(cut) <= 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs.repartition(3)).collect()))
    assert mixing.mix(no_docs).count() == 0


def test_mixed_copies(odd_docs):
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    taken = sum(r.taken for r in mixing.mix(odd_docs).collect())
    out = mixing.copies(mixing.mix(odd_docs, keep=True), odd_docs.columns)
    assert out.columns == odd_docs.columns
    assert sum(n(r.text) for r in out.collect()) == taken


# ---------------------------------------------------------------- WARC

PAGES = [(3, "http://a/x", "p" * 200), (1, "http://a/y", "p" * 200), (2, None, None), (9, "u", ""), (4, "u\r\nv", "short"), (5, "u", "short"), (6, "ü", "é" * 60), (7, "u", "é" * 60), (7, "u", "é" * 60), (None, "u", "p" * 200)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1, b"x") for p in PAGES] + [(100 + i, f"http://b/{i}", f"<html><body>page {i} " + "and so on " * 30, 1, b"y") for i in range(60)], "page_id long, url string, html string, digest int, payload binary")
    root = scratch(spark, "warc")
    written = stored(warc.write(warc.plan_records(pages), root), "archives")
    got = warc.read(written, root, payloads=True).collect()
    source = pages.collect()
    first = {}
    for r in source:
        b = (r.html or "").encode()
        if len(b) >= 100 and r.page_id is not None:
            first[b] = min(first.get(b, r.page_id), r.page_id)
    want = Counter()
    for r in source:
        b = (r.html or "").encode()
        other = first.get(b) if len(b) >= 100 and first.get(b) != r.page_id else None
        want[(r.page_id, len(b), hashlib.sha256(b).hexdigest(), "response" if other is None else "revisit", other, b if other is None else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want


def test_warc_dictionary_frame():
    records = [warc.record(i, f"http://a/{i}", f"<p>text {i * 7919} with a common frame</p>".encode() * 8, "d", 8, 0 if i else None, "d") for i in range(400)]
    parts = list(warc.archive(records))
    assert parts[0][:4] == bytes.fromhex("5d2a4d18") and len(parts) == 401 and len(parts[0]) > 1000
    assert all(p[:4] == bytes.fromhex("28b52ffd") for p in parts[1:])
    plain = list(warc.archive(records[:3]))
    assert len(plain[0]) == 8


def test_warc_detects_damage():
    data = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None, "d")
    assert warc.parse(data)["payload"] == b"payload"
    for broken in (data[:-1], data.replace(b"payload\r", b"paylosd\r")):
        with pytest.raises(ValueError):
            warc.parse(broken)


# ---------------------------------------------------------------- token rollups


def test_rollup_deltas_are_idempotent(spark):
    schema = "doc_id long, source string, lang string, version string, tokens long, op string, seq int, docs int"
    state = rollups.TokenRollup(spark, scratch(spark, "rollup"))
    e = lambda *rows: spark.createDataFrame([(*r, 0) for r in rows], schema)
    assert state.totals().count() == 0
    one = e((1, "a", "en", "v1", 10, "insert", 0), (2, "a", None, "v1", 5, "insert", 0), (None, None, "en", "v1", None, "insert", 0), (2, "a", None, "v1", 7, "revise", 1))
    assert state.apply("b1", one) and not state.apply("b1", one)
    assert state.apply("b2", e((1, "b", "en", "v1", 4, "revise", 0), (2, "x", "x", "v1", 0, "delete", 0), (9, "a", "en", "v1", 3, "delete", 0), (1, "a", "en", "v2", 11, "insert", 0)))
    assert state.apply("b3", e())
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in state.totals().collect()}
    assert got == {("b", "en", "v1"): (1, 4), (None, "en", "v1"): (1, 0), ("a", "en", "v2"): (1, 11)}
    assert {(r.level, r.version): r.tokens for r in state.rollup().collect() if r.level == "version"} == {("version", "v1"): 4, ("version", "v2"): 11}


EVENTS = "doc_id long, source string, lang string, version string, tokens long, op string, seq int"


def test_rollup_leaves_a_dead_batch(spark):
    state = rollups.TokenRollup(spark, scratch(spark, "rollup"))
    e = spark.createDataFrame([(1, "a", "en", "v1", 10, "insert", 0)], EVENTS)
    state._attempt(1, state._last(e))  # written, never committed
    assert state.totals().count() == 0
    assert state.apply("b/1", e) and not state.apply("b/1", e)
    assert [tuple(r) for r in state.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_rollup_commit_appears_whole_or_not_at_all(spark):
    """A writer stops between writing its commit and putting it in place, while another has looked and goes on."""
    root = scratch(spark, "rollup")
    e = spark.createDataFrame([(1, "a", "en", "v1", 10, "insert", 0)], EVENTS)
    stopped, other = rollups.TokenRollup(spark, root), rollups.TokenRollup(spark, root)
    publish, seen = stopped._publish, []

    def between(aside, place):
        seen.append((other.committed(), [r.docs for r in other.totals().collect()]))
        raise InterruptedError

    stopped._publish = between
    with pytest.raises(InterruptedError):
        stopped.apply("b", e)
    assert seen == [([], [])] and other.committed() == []
    assert other.apply("b", e) and not other.apply("b", e)
    stopped._publish = publish
    assert not stopped.apply("b", e)
    assert [tuple(r) for r in stopped.totals().collect()] == [("a", "en", "v1", 1, 10)]
    assert other.compact() and [tuple(r) for r in stopped.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_rollup_numbers_are_given_once(spark):
    """Of two renames to one number the first stays, also where both found it free."""
    root = scratch(spark, "rollup")
    one, two = rollups.TokenRollup(spark, root), rollups.TokenRollup(spark, root)
    publish = two._publish

    def late(aside, place):
        assert one._create("commits", 1, "first", "x")
        two._fs.rename(two._path(aside), two._path(place))

    two._publish = late
    assert not two._create("commits", 1, "second", "y")
    two._publish = publish
    assert not two._create("commits", 1, "third", "z") and two._create("commits", 2, "fourth", "z")
    assert one.committed() == two.committed() == [(1, "x"), (2, "z")]


def test_rollup_writers_at_once(spark):
    """Both work out their change from the empty state; the one that loses the number starts again."""
    root = scratch(spark, "rollup")
    e = spark.createDataFrame([(1, "a", "en", "v1", 11, "insert", 0)], EVENTS)
    slow, fast = rollups.TokenRollup(spark, root), rollups.TokenRollup(spark, root)
    attempt, ran = slow._attempt, []

    def late(number, new):
        made = attempt(number, new)
        if not ran:
            ran.append(fast.apply("other", e))
        return made

    slow._attempt = late
    assert slow.apply("one", e) and ran == [True]
    assert slow.committed() == [(1, "other"), (2, "one")]
    assert [tuple(r) for r in slow.totals().collect()] == [("a", "en", "v1", 1, 11)]
    assert slow.ledger().count() == 1


def test_rollup_compaction_keeps_the_state(spark):
    rng = random.Random(3)
    state = rollups.TokenRollup(spark, scratch(spark, "rollup"), buckets=4)
    truth = {}
    for batch in range(5):
        rows = []
        for seq in range(30):
            doc, v, op, n = rng.randrange(12), rng.choice(["v1", "v2"]), rng.choice(["insert", "revise", "delete"]), rng.randrange(50)
            source = rng.choice(["a", "b", None])
            rows.append((doc, source, "en", v, n, op, seq))
            if op == "delete":
                truth.pop((doc, v), None)
            else:
                truth[doc, v] = (source, n)
        assert state.apply(f"b{batch}", spark.createDataFrame(rows, EVENTS))
        if batch in (1, 3):
            assert state.compact() and not state.compact()
        want = defaultdict(lambda: [0, 0])
        for (_, v), (source, n) in truth.items():
            want[source, "en", v][0] += 1
            want[source, "en", v][1] += n
        assert {(r.source, r.lang, r.version): [r.docs, r.tokens] for r in state.totals().collect()} == want
    assert not state.apply("b0", spark.createDataFrame([], EVENTS))


def test_token_counts_query(spark, odd_docs, tmp_path):
    """The registered query against the tokenizer itself, copies left out."""
    import public_tokenizers
    from tokenizers import Tokenizer

    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, first, want = [r for r in odd_docs.collect()], {}, Counter()
    ids = Counter(r.doc_id for r in texts)
    for r in texts:
        if r.doc_id is not None and r.text is not None:
            first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in rollups.op10_query(spark, str(tmp_path)).where("level = 'source_lang'").collect()}
    once = [r for r in texts if r.doc_id is not None and ids[r.doc_id] == 1 and r.text and first[r.text] == r.doc_id]
    assert len(once) > 8
    counts = {r.doc_id: r.tokens for r in rollups.token_counts(odd_docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).collect()}
    for r in once:
        assert counts[r.doc_id] == len(full.encode(r.text, add_special_tokens=False).ids)
        want[r.source, r.lang] += counts[r.doc_id]
    assert all(got[key][1] >= n for key, n in want.items())


def test_rollup_query_without_rows(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rollups.op10_query(spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------------- HTML

BODY = "<p>First paragraph &amp; some words that go on for a while, as they do.</p><p>Second<br>paragraph, with a <a href=x>link</a> and <b>bold</b>er text in it.</p>"
TEXT = "First paragraph & some words that go on for a while, as they do.\n\nSecond paragraph, with a link and bolder text in it."


@pytest.mark.parametrize(
    "source, want",
    [
        (f"<html><head><title>T</title><script>var t='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><article>{BODY}</article><footer>Foot</footer></body></html>", TEXT),
        (f"<body><div class='page'><div class='sidebar-left'><p>{'side ' * 9}</p></div><div id=main>{BODY}</div><div class='comments'><p>{'comment ' * 90}</p></div></div>", TEXT),
        (f"<body><article>{BODY}<div class=ad>buy</div><form><p>name</p></form><!-- <p>x</p> --></article><foot", TEXT),
        (f"<BODY><ARTICLE>{BODY.replace('</p>', '')}", TEXT),
        ("", ""), ("<nav>only</nav>", ""), ("plain &lt;text&gt;\n here", "plain <text> here"), ("<p>a<div>b</div>c", "a\n\nb\n\nc"), ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"), ("x <a title='1>2'>y</a> <", "x y <"),
    ],
)
def test_extract(source, want):
    assert html.extract(source, None) == want


def test_article_parts_keep_their_text():
    """Words that name surroundings elsewhere do not cost an article its sections."""
    part = "<section id='side-effects' class='legal'>" + BODY + "</section>"
    assert html.extract(f"<article><h2 id=search class=search>Head</h2>{part}<div class='related'><a href=x>see that</a> <a href=y>and that</a></div></article>", None) == f"Head\n\n{TEXT}"
    assert html.extract(f"<div class=legal><p>{'small print ' * 9}</p></div><article>{BODY}</article>", None) == TEXT


@pytest.mark.parametrize("start, end", [("<svg/>", ""), ("<svg-icon>", "</svg-icon>"), ("<select-box>", ""), ("<template-x>", ""), ("<object>", ""), ("<svg><title>no</title></svg>", ""), ("<SCRIPT>no", "</script >"), ("</b></div></i>", "")])
def test_elements_that_swallow_nothing(start, end):
    assert html.extract(f"<article>{start}{end}{BODY}</article>", None) == TEXT


def test_deep_pages_in_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert html.extract("<div>" * n + BODY + "</div>" * n, html.vote("<div>" * n + BODY)) == TEXT
        assert html.extract("<b>" * n + BODY + "</i>" * n, None) == TEXT
        return time.perf_counter() - began

    small = min(seconds(5000) for _ in range(3))
    assert seconds(100_000) < 60 * max(small, 0.05)


def test_html_query_of_odd_rows(spark, tmp_path):
    rows = [(1, "http://h/a", f"<article>{BODY}</article>")] * 2 + [(None, "http://h/b", f"<article>{BODY}</article>"), (2, None, None), (3, "no host", "<div>" * 3000 + BODY), (4, "http://h/c", "")]
    spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in html.op4_query(spark, str(tmp_path)).collect())
    assert got == Counter((i, u, TEXT if h else "", len(TEXT) if h else 0) for i, u, h in rows)


def test_consensus_with_salted_hosts(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}/x", f"<article>{BODY}</article>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, html.extract_pages(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    assert sorted(map(str, html.extract_pages(df).collect())) == want


def test_consensus_overrules_a_page(spark):
    page = lambda main, side: f"<body><div class='post-{len(main)}'><div class=c1>{main}</div></div><div class=x>{side}</div>"
    long, short = "<p>" + "word " * 80 + "</p>", "<p>few words</p>"
    rows = [(i, "http://h.org/a", page(long, short)) for i in range(5)] + [(5, "http://H.org:80/b", page(short, long)), (6, None, None), (7, "http://other", page(short, long))]
    got = {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, path string")).collect()}
    assert got[5] == "few words" and got[6] == "" and got[7] == " ".join(["word"] * 80)
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- nearest neighbours


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0, None] * 12), (5004, [1.0] * 5), (None, [1.0] * 24), (5020, [float("inf")] * 24)]
    df = spark.createDataFrame([(*r, 3, 4.0) for r in rows], "vec_id long, embedding array<float>, q int, score double").repartition(3)
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        s = (x.astype(np.float64) * x[q].astype(np.float64)).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hit += len({v for v, _ in found} & set(best.tolist()))
        assert [f[1] for f in found] == pytest.approx([s[f[0]] for f in found], abs=1e-12)
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len(found) == 20
    assert hit / (20 * len(got)) >= 0.95


def test_ann_recall_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BYTES", 1500 * 16 * 8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16)) * rng.uniform(0.5, 1.5, 6000)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(found) & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 300 and hit / 6000 >= 0.9


def test_ann_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.25, 0.5]), (3, [0.0, 1.0]), (20, [0.0, 1.0]), (20, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (41, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 20, 1.0), (2, 1, 0.5), (3, 2, 0.25), (4, 3, 0.0), (5, 20, 0.0)]
    assert sorted(got[20]) == sorted([(1, 3, 1.0), (2, 1, 0.5), (3, 2, 0.5), (4, 0, 0.0), (5, 0, 0.0), (1, 0, 1.0), (2, 0, 1.0), (3, 1, 1.0), (4, 3, 1.0), (5, 2, 0.75)])
    assert got[40] == [(1, 41, 1.0)]


def test_ann_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in ann.search(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_collision_index_verifies_a_part():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    made = ann.CollisionIndex(np.arange(4000), x, float(np.sqrt((x**2).sum(1).max())))
    for q in range(20):
        made.search(q, x[q], 20)
    assert made.verified < 20 * 4000 / 2


# ---------------------------------------------------------------- substring dedup


def test_chains_against_all_pairs():
    rng = random.Random(6)
    for _ in range(20):
        points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        a, b = [p[0] for p in points], [p[1] for p in points]
        best = []
        for i in range(len(a)):
            options = [best[j] - substring.GAP * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i]]
            best.append(8 + max([0, *options]))
        got = substring.chains(a, b, 8, most_gap=1000)
        assert sorted(i for c in got for i in c) == list(range(len(a)))
        for c in got:
            assert all(a[x] < a[y] and b[x] < b[y] for x, y in zip(c, c[1:]))
        first = got[0]
        value = 8 * len(first) - substring.GAP * sum(a[y] - a[x] + b[y] - b[x] for x, y in zip(first, first[1:]))
        assert value == pytest.approx(max(best))


def test_chains_inside_the_longest_gap():
    rng = random.Random(9)
    reach = substring.MOST_GAP + 8
    for size in (60, 400):
        for _ in range(20):
            points = sorted({(rng.randrange(size), rng.randrange(size)) for _ in range(size)})
            a, b = [p[0] for p in points], [p[1] for p in points]
            best = []
            for i in range(len(a)):
                options = [best[j] - substring.GAP * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if 0 < a[i] - a[j] <= reach and 0 < b[i] - b[j] <= reach]
                best.append(8 + max([0, *options]))
            got = substring.chains(a, b, 8)
            assert sorted(i for c in got for i in c) == list(range(len(a)))
            for c in got:
                assert all(0 < a[y] - a[x] <= reach and 0 < b[y] - b[x] <= reach for x, y in zip(c, c[1:]))
            first = got[0]
            value = 8 * len(first) - substring.GAP * sum(a[y] - a[x] + b[y] - b[x] for x, y in zip(first, first[1:]))
            assert value == pytest.approx(max(best))
    # the far end of a long chain does not stand in the way of those behind a wide gap
    at = [*range(0, 600, 6), *range(660, 780, 6)]
    assert [len(c) for c in substring.chains(at, at)] == [100, 20]


def test_passages_exact_and_fuzzy(spark):
    rng = random.Random(8)
    passage, fuzzy = words(rng, 55), words(rng, 120)
    edited = fuzzy[:40] + ["new"] + fuzzy[41:80] + fuzzy[82:]
    rows = [(1, words(rng, 30) + passage + words(rng, 90)), (2, words(rng, 5) + [w.upper() for w in passage] + words(rng, 200)), (3, fuzzy + words(rng, 30)), (4, words(rng, 30) + edited), (5, words(rng, 300)), (6, passage), (7, passage[:40] + words(rng, 60))]
    df = spark.createDataFrame([(i, " ".join(w), "s") for i, w in rows], "doc_id long, text string, odoc string")
    got = {(r.doc_id, r.other_doc_id): (r.start_word, r.end_word, r.passage_start, r.passage_end) for r in substring.passages(df).collect()}
    assert set(got) == {(2, 1), (4, 3), (6, 1)}
    assert got[2, 1] == (5, 60, 5, 60) and got[6, 1] == (0, 55, 0, 55) and got[4, 3] == (30, 148, 30, 148)
    kept = {r.doc_id: r.text.split() for r in substring.cut(df).collect()}
    assert kept == {i: (w[:5] + w[60:] if i == 2 else w[:30] if i == 4 else w) for i, w in rows if i != 6}


def test_passages_of_a_filled_template(spark):
    # the first owner of both ends has other words between them, a second one owns the middle, the third has all of it
    rng = random.Random(10)
    rows, passages = [], {}
    for x in range(0, 60, 10):
        first, slot, last = words(rng, 25), words(rng, 30), words(rng, 25)
        rows += [(x + 1, words(rng, 20) + first + words(rng, 30) + last), (x + 2, words(rng, 20) + slot + words(rng, 20)), (x + 3, words(rng, 40) + first + slot + last + words(rng, 9)), (x + 4, words(rng, 15) + first + slot + last + words(rng, 35))]
        passages |= {x + 3: (40, 120), x + 4: (15, 95)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    assert {(r.doc_id, (r.passage_start, r.passage_end)) for r in substring.passages(df).collect()} == set(passages.items())
    kept = {r.doc_id: r.text.split() for r in substring.cut(df).collect()}
    assert kept == {i: w[: passages[i][0]] + w[passages[i][1] :] if i in passages else w for i, w in rows}


def test_passages_of_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.other_doc_id) for r in substring.passages(odd_docs).collect()}
    assert got == {(2, 1), (3, 1), (13, 1), (11, 10)}
    out = substring.cut(odd_docs)
    assert out.columns == odd_docs.columns
    kept = Counter(r.doc_id for r in out.collect())
    assert kept == Counter(r.doc_id for r in odd_docs.collect() if r.doc_id not in (2, 3, 13))
    assert substring.passages(no_docs).count() == 0 and substring.cut(no_docs).count() == 0


# ---------------------------------------------------------------- toxicity


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(2)
    s = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * s))).astype(float)
    x, p = toxicity.isotonic(s, y)
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all()
    assert abs(np.interp(s, x, p) - 1 / (1 + np.exp(-2 * s))).mean() < 0.05


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    bad = ["grumpfel", "snarkle", "blargh"]
    rows, labels = [], []
    for i in range(900):
        w, y = words(rng, rng.randrange(8, 60)), rng.random() < 0.25
        for _ in range(rng.randrange(2, 6) if y else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(y) if i % 50 else None))
    docs = spark.createDataFrame([*rows, (None, None, None), (2000, "", "x"), (1, rows[1][1], "en")], "doc_id long, text string, row string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    assert set(bad) <= model.words
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == 903 and all(0 <= r.score <= 1 for r in scores)
    truth = dict(labels)
    held = {r.id for r in toxicity.score(docs.where(toxicity.held_out()), model).collect()}
    pairs = [(r.score >= 0.5, bool(truth[r.id])) for r in scores if r.id in held and truth.get(r.id) is not None]
    assert len(pairs) > 100 and sum(a == b for a, b in pairs) / len(pairs) > 0.97
    assert toxicity.score(docs, model, keep=True).select("row.*").columns == docs.columns
    assert toxicity.train(docs.limit(0), known).score(np.zeros((2, len(toxicity.NAMES)))).tolist() == [0, 0]


def test_held_out_rule(spark):
    got = {r.doc_id for r in spark.range(500).withColumnRenamed("id", "doc_id").where(toxicity.held_out()).collect()}
    assert got == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
