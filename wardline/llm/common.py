"""Helpers shared by the operators of this package: scratch storage, text kernels, run grouping."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- scratch storage

_OPEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver see. Only a local master that names none (tests) gets one of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="wardline-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. ``discard`` and ``release`` remove it, or else the end of the application."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch/{uuid.uuid4().hex}/{name}"
    _OPEN.append(path.rsplit("/", 1)[0])
    folder = spark._jvm.org.apache.hadoop.fs.Path(_OPEN[-1])
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


#: Shuffle files of a query go as soon as it ends; its table in shared storage is what later steps read.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as Parquet to shared storage and read it back. The write's shuffle files are removed."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    global _WRITTEN
    _WRITTEN += 1
    if _WRITTEN % REST_EVERY == 0:
        rested(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path.rsplit("/", 1)[0]
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing reads any more: all their readers have been stored themselves."""
    for df in frames:
        path = df._scratch
        if path in _OPEN:
            _OPEN.remove(path)
            release(df.sparkSession, [path])


def opened() -> list[str]:
    """The scratch folders in use, for ``release``."""
    return _OPEN


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch folders. Call it only when what reads them has been written out."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables that ``stored`` writes from one collection of garbage to the next.
REST_EVERY = 8
_WRITTEN = 0


def rested(spark: SparkSession) -> None:
    """Have every executor collect its garbage, so that a long session's heaps go back to what lives. Short tasks, several for
    each core, meet all executors that are idle; one that is missed is only as large as it was. A local master has none."""
    if spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        return
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- Arrow helpers


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n+1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    col = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return whole[first : int(offsets[-1]) if len(offsets) else 0], offsets - first


def slices(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (one row at least), so that kernels need bounded memory."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal, adjacent keys from sorted batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        here = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(new).tolist(), t.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = here if a == 0 else tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(t.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


# ---------------------------------------------------------------- word kernel

#: White space as the inside of a character class.
WORD_CLASS = r"\x20\x09-\x0D"
#: White space of the word pattern [^\x20\x09-\x0D]+
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _POWER[:] = [np.cumprod(np.full(max(n, 1 << 20), b, np.uint64)) for b in (_BASE, inverse)]
    return _POWER[0][:n], _POWER[1][:n]


class Words:
    """Words of some rows: byte bounds, row of each, first word of each row, 64-bit hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = True):
        n = len(buf)
        self.rows = len(offsets) - 1
        word = ~_SPACE[buf]
        before = np.zeros(n + 1, bool)
        before[1:] = word
        after = np.zeros(n + 1, bool)
        after[:n] = word
        before[offsets[:-1]] = False
        after[offsets[1:]] = False
        self.start = np.flatnonzero(word & ~before[:n])
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)  # words before each row's first byte
        self.count = np.diff(self.first)
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    @staticmethod
    def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, case folded where ``lower`` is set."""
        power, inverse = _powers(len(buf) + 1)
        out = np.zeros(len(start), np.uint64)
        for table_, pick in ((_BYTE_LOWER, lower), (_BYTE, ~lower)):
            if pick.any():
                total = np.zeros(len(buf) + 1, np.uint64)
                np.cumsum(table_[buf] * power[: len(buf)], out=total[1:])
                out[pick] = (total[end[pick]] - total[start[pick]]) * inverse[start[pick]]
        return mix(out + (end - start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one row."""
        h, n = self.hash, len(self.hash)
        out = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            out += h[j : j + len(out)] * _STEP[j]
        ends = np.repeat(self.first[1:], self.count)
        return mix(out), np.arange(len(out)) + k <= ends[: len(out)]

    def sequence(self, row: int, k: int) -> np.uint64:
        """Hash of the whole row of fewer than k words, apart from every k-word shingle's by its length."""
        a, b = self.first[row], self.first[row + 1]
        with np.errstate(over="ignore"):
            total = np.uint64(b - a) * np.uint64(0xD6E8FEB86659FD93)
            for j in range(b - a):
                total = total + self.hash[a + j] * _STEP[j]
        return mix(np.array([total], np.uint64))[0]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row: k-word shingles; with fewer words the whole sequence; without words none."""
    out: list[np.ndarray] = []
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        w = Words(buf[part[0] : part[-1]], part - part[0])
        h, _ = w.shingles(k)
        for r in range(w.rows):
            n = w.count[r]
            if n >= k:
                s = np.sort(h[w.first[r] : w.first[r] + n - k + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif n:
                out.append(np.array([w.sequence(r, k)], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def n_words(col: str = "text"):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 of null, inside the JVM and without a list of them."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable. Alternates large-star and small-star until no edge changes.

    Every step is an aggregation whose groups are reduced by min before they are dealt out, and a join back of one row a
    node, whose hubs the adaptive skew join splits. Only the newest tables are kept. The round limit only guards against a
    defect: it raises.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    e = stored(e, "edges")
    if not e.take(1):
        return spark.createDataFrame([], "node long, component long")

    def mark(d: DataFrame):
        return d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()

    was = mark(e)
    for _ in range(most_rounds):
        # large star: every neighbour larger than u hangs on u's least neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, "large")
        discard(e, least)
        e = large
        # small star: u and its smaller neighbours hang on the least of them
        least = stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = e.join(least, "u")
        e = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        small = stored(e, "small")
        discard(large, least)
        e = small
        now = mark(e)
        if now == was:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        was = now
    raise RuntimeError("connected components did not settle")


ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20
#: Python workers live on from stage to stage: large blocks go back to the system as soon as they are freed.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304"}


def ready(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it (a cluster without shared code needs --py-files)."""
    import os

    # whole texts are large rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


# ---------------------------------------------------------------- bounded filters

#: Hash slots of a filter: at most 1024 bitmaps of 4 kB.
SLOTS = 1 << 25
_BITMAP = 1 << 15


def slot(col):
    return F.pmod(F.xxhash64(col), F.lit(SLOTS))


def slots_of(ids: DataFrame, col: str) -> DataFrame:
    """(bucket, bitmap): the hash slots of some ids, SLOTS / 8 bytes at most, whatever the input, so it may be broadcast."""
    at = ids.select(slot(F.col(col)).alias("slot"))
    parts_ = at.groupBy(F.floor(F.col("slot") / _BITMAP).alias("bucket"))
    return parts_.agg(F.bitmap_construct_agg(F.col("slot") % _BITMAP).alias("bitmap"))


def _met(df: DataFrame, id_col, slots: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with the bitmap that their id's slot is in, and whether the slot is set there."""
    of = F.floor(slot(id_col) / _BITMAP)
    bit = slot(id_col) % _BITMAP
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    power = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8).cast("int") + 1)
    hit = F.coalesce(byte.bitwiseAND(power) != 0, F.lit(False))
    return df.withColumn("bucket", of).join(F.broadcast(slots), "bucket", "left"), hit


def maybe_in(df: DataFrame, id_col, slots: DataFrame) -> DataFrame:
    """Rows whose id may be among those of ``slots``; spares most of the others a shuffle."""
    met, hit = _met(df, id_col, slots)
    return met.where(hit).select(*[met[f"`{c}`"] for c in df.columns])


def not_in(df: DataFrame, id_col, slots: DataFrame) -> DataFrame:
    """The other rows: those whose slot no id of ``slots`` has."""
    met, hit = _met(df, id_col, slots)
    return met.where(~hit).select(*[met[f"`{c}`"] for c in df.columns])
