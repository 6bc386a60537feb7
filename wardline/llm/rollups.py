"""Token counts as delta-maintained rollups.

A ``TokenRollup`` keeps append-only tables below one folder. An attempt to apply a batch writes the last count of each
(document, tokenizer version) the batch touches, dealt into hash buckets, and the batch's change of the totals by source,
language and version. It takes effect when its commit, which names the attempt and the batch, is renamed to the next
number, whole, unless the number is taken. Who loses a number works out the change anew from the state then at hand, so
that writers at the same time do not count a document twice. A batch that was committed is not applied again, and what a
dead attempt left behind, its commit included, is never read. The folder must lie where renaming a folder is one step
(HDFS, a local or mounted disk; not a bare object store). A batch reads the buckets that it touches only, and ``compact`` folds
all commits so far into one table of states and one of totals.

Defined results: events of one batch on one document and version apply in ``seq`` order, the last alone counting (of
equal ``seq`` a deletion loses, then the largest count, source and language win); an insert of a known document acts as a
revision, a delete of an unknown one as nothing and a revision of one as an insert; null sources and languages are groups
of their own; a null document id is one document; a null count is 0; any string is a batch id; an empty batch commits
with no change; further columns of events are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_words, scratch, stored, table, text_buffer
from .packing import PieceEncoder

KEYS = ["source", "lang", "version"]
LEDGER = "doc string, version string, source string, lang string, tokens long, live boolean, batch_no long, bucket int"
DELTA = "source string, lang string, version string, docs long, tokens long"
#: Buckets that the states of documents are dealt into by a hash of their id.
BUCKETS = 64


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._seen: dict[str, list[str]] = {}

    # commits: a numbered folder with one file, renamed into place whole

    def _lines(self, path) -> list[str]:
        source = self._fs.open(path)
        try:
            return bytes(source.readAllBytes()).decode().split("\n", 1)
        finally:
            source.close()

    def _records(self, kind: str) -> list[tuple[int, list[str]]]:
        """(number, lines) of the records of a kind, in order; each is read once."""
        at = self._path(kind)
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
        out = []
        for name in (n for n in names if n.isdigit()):
            key = f"{kind}/{name}"
            if key not in self._seen:
                self._seen[key] = self._lines(self._path(f"{key}/record"))
            out.append((int(name), self._seen[key]))
        return out

    def _create(self, kind: str, number: int, *lines: str) -> bool:
        """Make a numbered record; False if there is one. It is written aside and its folder renamed: a rename onto a folder
        that is there replaces nothing (the file system refuses, or moves it below), so that the first one stays, whole from
        the start. Whose record it is tells the first line, which no other attempt has."""
        aside, place = f"pending/{uuid.uuid4().hex}", f"{kind}/{number:012d}"
        self._fs.mkdirs(self._path(aside))
        self._fs.mkdirs(self._path(kind))
        out = self._fs.create(self._path(f"{aside}/record"), False)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        self._publish(aside, place)
        won = self._lines(self._path(f"{place}/record"))[0] == lines[0]
        if not won:
            for left in (aside, f"{place}/{aside.rsplit('/', 1)[1]}"):
                self._fs.delete(self._path(left), True)
        return won

    def _publish(self, aside: str, place: str) -> None:
        if self._fs.exists(self._path(place)):
            return
        try:
            self._fs.rename(self._path(aside), self._path(place))
        except Py4JJavaError:
            if not self._fs.exists(self._path(place)):
                raise

    def committed(self) -> list[tuple[int, str]]:
        """(number, id) of the batches in effect, in order."""
        return [(n, lines[1]) for n, lines in self._records("commits")]

    def _since(self) -> tuple[int, str | None, list[str]]:
        """Number and folder of the newest compaction, and the attempts committed after it."""
        done = [(n, lines[0]) for n, lines in self._records("compactions")]
        base, folder = done[-1] if done else (0, None)
        return base, folder, [lines[0] for n, lines in self._records("commits") if n > base]

    def _read(self, what: str, schema: str) -> DataFrame:
        _, folder, attempts = self._since()
        paths = [f"{self.root}/{what}/{a}" for a in [*([folder] if folder else []), *attempts]]
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = self.spark.createDataFrame([], schema)
        for f in frames:
            out = out.unionByName(f)
        return out

    # state

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The last state of every (document, version), of some buckets or of all."""
        rows = self._read("ledger", LEDGER)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        last = F.max_by(F.struct("source", "lang", "tokens", "live"), "batch_no").alias("x")
        return rows.groupBy("bucket", "doc", "version").agg(last).select("bucket", "doc", "version", "x.*")

    def apply(self, batch_id: str, events: DataFrame) -> bool:
        """Apply (doc_id, source, lang, version, tokens, op, seq); op: insert, revise, delete. False if it was committed before."""
        new = None
        while True:
            commits = self._records("commits")
            if batch_id in {lines[1] for _, lines in commits}:
                return False
            number = (commits[-1][0] if commits else 0) + 1
            new = self._last(events) if new is None else new
            if self._create("commits", number, self._attempt(number, new), batch_id):
                return True

    def _last(self, events: DataFrame) -> DataFrame:
        """The event of a batch that counts for each (document, version)."""
        order = F.struct("seq", "live", "tokens", "source", "lang")
        rows = events.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), *KEYS, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), (F.col("op") != "delete").alias("live"), "seq")
        last = rows.groupBy("doc", "version").agg(F.max_by(F.struct("source", "lang", "tokens", "live"), order).alias("new"))
        return stored(last.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(self.buckets)).cast("int")), "batch")

    def _attempt(self, number: int, new: DataFrame) -> str:
        """Write the change that a batch makes to the present state; the name of its folders."""
        attempt = uuid.uuid4().hex
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # a number below ``buckets`` each
        old = self.ledger(touched).withColumnsRenamed({"source": "old_source", "lang": "old_lang", "tokens": "old_tokens", "live": "old_live"})
        change = new.join(old, ["bucket", "doc", "version"], "left").where("new.live OR old_live")
        # a delete keeps the place the document was counted in
        row = change.select("doc", "version", F.expr("IF(new.live, new.source, old_source)").alias("source"), F.expr("IF(new.live, new.lang, old_lang)").alias("lang"), F.col("new.tokens").alias("tokens"), F.col("new.live").alias("live"), "old_source", "old_lang", "old_tokens", F.coalesce("old_live", F.lit(False)).alias("old_live"), F.lit(number).cast("long").alias("batch_no"), "bucket")
        where = f"{self.root}/ledger/{attempt}"
        row.repartition("bucket").write.partitionBy("bucket").parquet(where)
        row = self.spark.read.schema(row.schema).parquet(where)
        plus = row.where("live").select(*KEYS, F.lit(1).alias("d"), F.col("tokens").alias("t"))
        minus = row.where("old_live").select(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version", F.lit(-1).alias("d"), (-F.col("old_tokens")).alias("t"))
        delta = plus.union(minus).groupBy(*KEYS).agg(F.sum("d").cast("long").alias("docs"), F.sum("t").cast("long").alias("tokens"))
        delta.write.parquet(f"{self.root}/delta/{attempt}")
        return attempt

    def compact(self) -> bool:
        """Fold all commits so far into one table of the documents that live and one of totals; False if there is nothing
        new or another writer has done so. Older tables stay for readers that began before."""
        base, _, attempts = self._since()
        number = max([n for n, _ in self.committed()], default=0)
        if number <= base or not attempts:
            return False
        folder = uuid.uuid4().hex
        live = self.ledger().where("live").withColumn("batch_no", F.lit(number).cast("long"))
        live.select("doc", "version", "source", "lang", "tokens", "live", "batch_no", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/ledger/{folder}")
        self.totals().write.parquet(f"{self.root}/delta/{folder}")
        if number != max([n for n, _ in self.committed()], default=0):
            return False  # a batch came in between: its change may or may not be in what was read
        return self._create("compactions", number, folder)

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and version; groups that came to nothing are left out."""
        return self._read("delta", DELTA).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def rollup(self) -> DataFrame:
        """Totals at four levels: source-language-version, source-version, language-version, version."""
        level = F.expr("CASE grouping(source) * 2 + grouping(lang) WHEN 0 THEN 'source_lang' WHEN 1 THEN 'source' WHEN 2 THEN 'lang' ELSE 'version' END").alias("level")
        cols = [F.col(k) for k in KEYS]
        sets = [cols, [cols[0], cols[2]], [cols[1], cols[2]], [cols[2]]]
        return self.totals().groupingSets(sets, *cols).agg(level, F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``tokens``: the ids that the tokenizer gives for the whole text (null: 0)."""
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(*[docs[f"`{c}`"] for c in rest], docs[f"`{text_col}`"].cast("string").alias(text_col))

    def run(batches):
        encoder = PieceEncoder(tokenizer)
        for b in batches:
            buf, offsets = text_buffer(b.column(len(rest)))
            n = np.fromiter((len(ids) for ids in encoder.encode(buf, offsets)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n)], [*rest, "tokens"])

    from pyspark.sql.types import LongType, StructField, StructType

    return src.mapInArrow(run, StructType([*src.schema[:-1], StructField("tokens", LongType())]))


def _event(d: DataFrame, version: str, tokens, op: str, seq: int) -> DataFrame:
    return d.select("doc_id", "source", "lang", F.lit(version).alias("version"), tokens.cast("long").alias("tokens"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))


def _maintained(spark, counts: DataFrame, estimate, exact: str, version: str) -> DataFrame:
    """Four batches over all documents of (doc_id, source, lang, h, ...): estimated counts; the same batch again, which changes
    nothing; the exact counts of whole texts as revisions; and, after a compaction, deletions of later copies of a text."""
    state = TokenRollup(spark, scratch(spark, "rollup"))
    first = _event(counts, version, estimate, "insert", 0)
    state.apply("estimates", first)
    state.apply("estimates", first)
    state.apply("exact counts", _event(counts, version, F.col(exact), "revise", 1))
    state.compact()
    groups = stored(counts.groupBy("h").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1"), "groups")
    later = counts.join(groups, "h").where("doc_id > kept")
    state.apply("later copies", _event(later, version, F.lit(0), "delete", 2))
    return state.rollup()


def op10_query(spark, sf_dir):
    """Token counts of all documents by the tokenizer word_bpe_49k, but for later copies of a text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.octet_length("text").alias("n_bytes"), "text")
    counts = stored(token_counts(docs, public_tokenizers.path("word_bpe_49k.json")), "counts")
    return _maintained(spark, counts, F.coalesce(F.ceil(F.col("n_bytes") / 4), F.lit(0)), "tokens", "word_bpe_49k")


def rollup_words_query(spark, sf_dir):
    """The same with counts of words, which SQL can check."""
    docs = table(spark, sf_dir, "documents")
    counts = stored(docs.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.octet_length("text").alias("n_bytes"), n_words().alias("words")), "counts")
    return _maintained(spark, counts, F.coalesce(F.ceil(F.col("n_bytes") / 6), F.lit(0)), "words", "words-1")


ROLLUP_WORDS_SQL = r"""
WITH d AS (
  SELECT *, doc_id > min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS later FROM documents),
c AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS t FROM d WHERE NOT later)
SELECT source, lang, version,
       CASE WHEN grouping(source) = 0 AND grouping(lang) = 0 THEN 'source_lang' WHEN grouping(source) = 0 THEN 'source'
            WHEN grouping(lang) = 0 THEN 'lang' ELSE 'version' END AS level,
       CAST(count(*) AS BIGINT) AS docs, CAST(sum(t) AS BIGINT) AS tokens
FROM c GROUP BY GROUPING SETS ((source, lang, version), (source, version), (lang, version), (version))
"""
