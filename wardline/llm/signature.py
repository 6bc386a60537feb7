"""Word-shingle Jaccard join through signature trees.

1. Texts become sets of hashed shingles; rows with equal sets are one representative, their smallest id.
2. A representative is indexed under the tokens of its prefix: |s| - ceil(t |s|) + 1 of its shingles, the first in
   one global order. Sets of similarity t or more share a prefix token. The order goes by about how often a shingle occurs
   (a fixed-size table), so that common passages do not gather rows.
3. Tokens with two or more representatives get a leader, the one that shares most with others. First every representative
   joins the block of the strongest of its tokens' leaders; blocks of many shingles are cut by hash, the leader in each part.
4. Within a part, signature trees over small bitmaps drop the sets that no other can be similar enough to, so that few
   texts move. For what stays, a signature tree, whose nodes hold OR-combined token bitmaps and size ranges, is joined with
   itself: a pair of nodes is descended only if its largest possible overlap can reach the threshold and its sets are
   not all connected yet; pairs of sets are then compared exactly.
5. All representatives with tokens of one leader that are still in several components are compared in full, in the same
   way: the block's largest component in chunks against chunks of the others, and those against each other.
6. Links are a forest of each component; distributed star contraction gives every node its smallest id.

Defined results: null and empty texts have no shingles and are linked with nothing; fewer words than a shingle are one
sequence; a null id comes out with its size and a null component and is linked with nothing; rows that repeat an id are
one node, with the links of each; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, maybe_in, mix, not_in, runs, shingle_sets, slots_of, stored, table, text_buffer

#: Slots of the table of frequent shingles, and the most that are entered; least count in a batch.
FREQUENT_SLOTS, FREQUENT_MOST, OFTEN = 1 << 22, 1 << 18, 2
#: Shingles and sets in one part of a block; sets and shingles in a chunk of step 5.
PART_SHINGLES, PART_SETS, CHUNK, CHUNK_SHINGLES = 60_000, 256, 1024, 1_000_000
#: Bits for each shingle of the part's largest set, at most so many; sets in a leaf; children of a node.
BITS_EACH, BITS_MOST, LEAF, FAN = 4, 1 << 16, 8, 4


# ---------------------------------------------------------------- signature tree


def bitmap(s: np.ndarray, size: int) -> int:
    """Bit hash mod size for every element."""
    bits = np.zeros(size, np.bool_)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fold(bits: int, size: int, to: int) -> int:
    """The bitmap of the same set in fewer bits; both are powers of two."""
    while size > to:
        size //= 2
        bits = (bits >> size) | (bits & ((1 << size) - 1))
    return bits


def own_bits(n: int) -> int:
    """Bits of the bitmap that a set of n elements is stored with."""
    return 1 << max(6, (n - 1).bit_length())


class Node:
    """OR of the bitmaps below, sizes below, and the most elements that one set below has beyond its bits."""

    __slots__ = ("bits", "children", "high", "low", "one", "sets", "slack")

    def __init__(self, bits: int, low: int, high: int, slack: int, children: list[Node], sets: list[int]):
        self.bits, self.low, self.high, self.slack, self.children, self.sets = bits, low, high, slack, children, sets
        self.one = -1  # once all sets below are settled: one of them


class Signatures:
    """Bitmaps and sizes of sets, and trees over them for one threshold."""

    def __init__(self, sizes: list[int], maps: list[int], num: int, den: int):
        self.sizes, self.maps, self.num, self.den = sizes, maps, num, den

    def build(self, some: list[int]) -> Node | None:
        """Leaves of sets near in size and in their first bits, FAN nodes below each parent."""
        some = sorted(some, key=lambda i: (self.sizes[i].bit_length(), self.maps[i] & -self.maps[i], self.sizes[i], i))
        level = []
        for at in range(0, len(some), LEAF):
            own = some[at : at + LEAF]
            sizes = [self.sizes[i] for i in own]
            bits = 0
            for i in own:
                bits |= self.maps[i]
            level.append(Node(bits, min(sizes), max(sizes), max(n - self.maps[i].bit_count() for n, i in zip(sizes, own, strict=True)), [], own))
        while len(level) > 1:
            groups = [level[i : i + FAN] for i in range(0, len(level), FAN)]
            level = []
            for g in groups:
                bits = 0
                for n in g:
                    bits |= n.bits
                level.append(Node(bits, min(n.low for n in g), max(n.high for n in g), max(n.slack for n in g), g, []))
        return level[0] if level else None

    def _enough(self, overlap: int, total: int) -> bool:
        """overlap / (total - overlap) >= num / den"""
        return (self.num + self.den) * overlap >= self.num * total

    def possible(self, x: Node, y: Node) -> bool:
        """Whether a set below x and one below y can be similar enough. Common elements lie on common bits, and a set has
        at most ``slack`` more elements than bits."""
        if self.den * x.high < self.num * y.low or self.den * y.high < self.num * x.low:
            return False
        bound = min(x.high, y.high, (x.bits & y.bits).bit_count() + min(x.slack, y.slack))
        return self._enough(bound, x.low + y.low)

    def may_link(self, i: int, j: int) -> bool:
        """The same for two sets: each bit that only one has is an element that only it has."""
        a, b = self.sizes[i], self.sizes[j]
        if self.den * min(a, b) < self.num * max(a, b):
            return False
        x, y = self.maps[i], self.maps[j]
        return self._enough(min(a - (x & ~y).bit_count(), b - (y & ~x).bit_count()), a + b)

    def traverse(self, x: Node, y: Node, settled, pair) -> None:
        """Dual traversal; x may be y. ``settled(x, y)`` ends a branch, ``pair(i, j)`` gets the sets of leaves that meet."""
        stack = [(x, y)]
        while stack:
            x, y = stack.pop()
            if settled(x, y) or not self.possible(x, y):
                continue
            if x.sets and y.sets:
                for k, i in enumerate(x.sets):
                    for j in x.sets[k + 1 :] if x is y else y.sets:
                        pair(i, j)
            elif x is y:
                for k, c in enumerate(x.children):
                    stack += [(c, d) for d in x.children[k + 1 :]]
                stack += [(c, c) for c in x.children]
            elif x.sets or y.children and y.high > x.high:
                stack += [(x, c) for c in y.children]
            else:
                stack += [(c, y) for c in x.children]


class Prospects(Signatures):
    """Which sets have a partner of another component that their bitmaps allow."""

    def __init__(self, sizes: list[int], maps: list[int], known: list[int], num: int, den: int):
        super().__init__(sizes, maps, num, den)
        self.known = known
        self.marked = [False] * len(sizes)

    def _all(self, node: Node) -> bool:
        if node.one < 0 and all(self.marked[i] for i in node.sets) and all(self._all(c) for c in node.children):
            node.one = 1
        return node.one >= 0

    def join(self, x: Node, y: Node) -> None:
        def pair(i: int, j: int) -> None:
            if not (self.marked[i] and self.marked[j]) and self.known[i] != self.known[j] and self.may_link(i, j):
                self.marked[i] = self.marked[j] = True

        self.traverse(x, y, lambda x, y: self._all(x) and self._all(y), pair)


class SignatureTree(Signatures):
    """Exact joins; ``links`` are the similar pairs that connected two components."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        most = max((len(s) for s in sets), default=1)
        bits = 1 << min(BITS_MOST.bit_length() - 1, max(8, (BITS_EACH * most).bit_length()))
        super().__init__([len(s) for s in sets], [bitmap(s, bits) for s in sets], num, den)
        self.sets = sets
        self.up = list(range(len(sets)))
        self.links: list[tuple[int, int]] = []
        self.compared = 0

    # union-find

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def connect(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def similar(self, i: int, j: int) -> bool:
        if not self.may_link(i, j):
            return False
        self.compared += 1
        a, b = sorted((self.sets[i], self.sets[j]), key=len)
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        return self._enough(int(np.count_nonzero(b[at] == a)), self.sizes[i] + self.sizes[j])

    def _connected(self, node: Node) -> int:
        """The component of all sets below, or -1. Sets once connected stay so, so the answer is kept."""
        if node.one >= 0:
            return self.find(node.one)
        if node.sets:
            found = self.find(node.sets[0])
            if any(self.find(i) != found for i in node.sets[1:]):
                return -1
        else:
            found = -1
            for c in node.children:
                here = self._connected(c)
                if here < 0 or found >= 0 and here != found:
                    return -1
                found = here
        node.one = found
        return found

    def _settled(self, x: Node, y: Node) -> bool:
        same = self._connected(x)
        return same >= 0 and (x is y or same == self._connected(y))

    def join(self, x: Node, y: Node) -> None:
        def pair(i: int, j: int) -> None:
            if self.find(i) != self.find(j) and self.similar(i, j):
                self.connect(i, j)
                self.links.append((i, j))

        self.traverse(x, y, self._settled, pair)


# ---------------------------------------------------------------- Spark


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def frequent(src: DataFrame, k: int) -> np.ndarray:
    """A table of slots: about how often a shingle there occurs, as a power of two. A batch counts what it has OFTEN times or
    more. It only orders prefixes, so that any table gives the same links; at most FREQUENT_MOST counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_buffer(b.column(0))
            sets = shingle_sets(buf, offsets, k)
            value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            often = n >= OFTEN
            yield pa.record_batch([pa.array(value[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

    counts = src.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    slots = np.zeros(FREQUENT_SLOTS, np.uint8)
    top = stored(counts.orderBy(F.desc("n"), "h").limit(FREQUENT_MOST), "frequent").toArrow()
    at = (top["h"].to_numpy().view(np.uint64) & np.uint64(FREQUENT_SLOTS - 1)).astype(np.int64)
    np.maximum.at(slots, at, np.log2(top["n"].to_numpy().astype(np.float64)).astype(np.uint8))
    return slots


def index(src: DataFrame, k: int, num: int, den: int, slots: np.ndarray) -> DataFrame:
    """(doc_id, n, f1, f2, prefix, bits): size and fingerprint of the shingle set, its prefix tokens and bitmap."""
    packed = zlib.compress(slots.tobytes(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(zlib.decompress(packed), np.uint8)
        for b in batches:
            buf, offsets = text_buffer(b.column(1))
            size, prints, maps, prefixes = [], [], [], [np.zeros(0, np.uint64)]
            for s in shingle_sets(buf, offsets, k):
                late = often[(s & np.uint64(FREQUENT_SLOTS - 1)).astype(np.int64)]
                most = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                prefixes.append(s[np.argsort(late, kind="stable")[:most]])
                size.append(len(s))
                maps.append(bitmap(s, b_ := own_bits(len(s))).to_bytes(b_ // 8, "little") if len(s) else b"")
                prints.append((np.bitwise_xor.reduce(mix(s)), s.sum(dtype=np.uint64)))
            f = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefixes[1:])]), pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), lists, pa.array(maps, pa.binary())], ["doc_id", "n", "f1", "f2", "prefix", "bits"])

    return src.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix array<long>, bits binary")


def _prospects(num: int, den: int):
    """Of each part (block, part, side, component, rep, n, bits), sorted, the rows that have a possible partner there in another
    component, on the other side for sides 0 and 1. Sets of one power of two in size have a tree; trees are joined with
    those of the same and of the next size, whose bitmaps are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["block", "part"]):
            if t.num_rows < 2:
                continue
            sizes, sides, known = (t.column(c).to_pylist() for c in ("n", "side", "component"))
            raw = [int.from_bytes(x, "little") for x in t.column("bits").to_pylist()]
            classes: dict[int, list[int]] = {}
            for i, n in enumerate(sizes):
                classes.setdefault(own_bits(n), []).append(i)
            marked = np.zeros(len(sizes), bool)
            for size, some in sorted(classes.items()):
                both = some + classes.get(2 * size, [])
                made = Prospects([sizes[i] for i in both], [fold(raw[i], own_bits(sizes[i]), size) for i in both], [known[i] for i in both], num, den)
                of = lambda rows, side: made.build([k for k in rows if sides[both[k]] == side])  # noqa: B023, E731
                low, high = range(len(some)), range(len(some), len(both))
                own = of(low, 2)
                for x, y in ((own, own), (own, of(high, 2)), (of(low, 0), of(low, 1)), (of(low, 0), of(high, 1)), (of(low, 1), of(high, 0))):
                    if x and y:
                        made.join(x, y)
                marked[[i for i, m in zip(both, made.marked, strict=True) if m]] = True
            if marked.any():
                yield from t.filter(pa.array(marked)).drop_columns(["n", "bits"]).combine_chunks().to_batches()

    return run


def _join_parts(k: int, num: int, den: int):
    """Spanning links of each part (block, part, side, first, component, doc_id, text), sorted. Sides 0 and 1 are joined
    with each other; side 2 is joined with itself. Rows of equal components count as connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["block", "part"]):
            ids = t.column("doc_id").to_pylist()
            buf, offsets = text_buffer(t.column("text"))
            sets = shingle_sets(buf, offsets, k)
            sides, firsts, known = (t.column(c).to_pylist() for c in ("side", "first", "component"))
            tree = SignatureTree(sets, num, den)
            place: dict = {}
            for i, (d, c) in enumerate(zip(ids, known, strict=True)):
                for key in (("id", d), ("in", c)):
                    tree.connect(place.setdefault(key, i), i)
            use = [i for i in range(len(ids)) if len(sets[i])]
            head, rest = tree.build([i for i in use if firsts[i]]), tree.build([i for i in use if sides[i] == 2])
            if head and rest:
                tree.join(head, rest)
            if rest:
                tree.join(rest, rest)
            left, right = (tree.build([i for i in use if sides[i] == s]) for s in (0, 1))
            if left and right:
                tree.join(left, right)
            if tree.links:
                a, b = zip(*tree.links, strict=True)
                yield pa.record_batch([pa.array([ids[i] for i in a], pa.int64()), pa.array([ids[i] for i in b], pa.int64())], ["a", "b"])

    return run


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, for links of Jaccard similarity num / den or more."""
    src = _source(docs, id_col, text_col)
    base = stored(index(src, k, num, den, frequent(src, k)), "index")
    by = ["f1", "f2", "n"]
    usable = base.where("n > 0 AND doc_id IS NOT NULL")
    kept = stored(usable.groupBy(*by).agg(F.min("doc_id").alias("rep")), "kept")
    member = stored(base.select("doc_id", *by).join(kept, by, "left").select("doc_id", "n", "rep"), "member")
    # prefixes and bitmaps are shuffled of those rows alone that a filter takes for copies
    copies = stored(slots_of(member.where("doc_id <> rep"), "doc_id"), "copies")
    own = kept.withColumnRenamed("rep", "doc_id")
    first = not_in(usable, F.col("doc_id"), copies).unionByName(maybe_in(usable, F.col("doc_id"), copies).join(own, [*by, "doc_id"], "left_semi").select(*usable.columns))
    reps = first.withColumnRenamed("doc_id", "rep")
    tokens = reps.select("rep", "n", F.explode("prefix").alias("token"))
    # the widest shuffle: one number a token, and its count
    shared = stored(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    filters = stored(slots_of(shared, "token"), "filters")
    posts = stored(maybe_in(tokens, F.col("token"), filters).join(shared, "token").select("token", "rep", "n", "c").distinct(), "posts")
    discard(shared, filters)
    weight = stored(posts.groupBy("rep").agg(F.sum("c").alias("w")), "weight")
    leader = stored(posts.join(weight, "rep").groupBy("token").agg(F.max(F.struct("w", (-F.col("rep")).alias("r"))).alias("m")).select("token", (-F.col("m.r")).alias("block"), F.col("m.w").alias("w")), "leader")
    held = stored(posts.join(leader, "token").groupBy("block", "rep").agg(F.max("n").alias("n"), F.max("w").alias("w")), "held")
    discard(posts, weight, leader)
    best = stored(held.groupBy("rep").agg(F.max(F.struct("w", (-F.col("block")).alias("r"))).alias("m"), F.max("n").alias("n")).select("rep", "n", (-F.col("m.r")).alias("block")), "best")
    cuts = F.ceil(F.greatest(F.sum("n") / PART_SHINGLES, F.count("*") / PART_SETS)).cast("int")
    # a block of one is a leader that is in another's block
    sized = stored(best.groupBy("block").agg(cuts.alias("cuts"), F.count_if(F.col("rep") != F.col("block")).alias("others")).where("others > 0").drop("others"), "sized")
    part = F.when(F.col("rep") == F.col("block"), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")))
    led = best.select("block", "rep").union(sized.select("block", F.col("block").alias("rep"))).distinct().join(sized, "block")
    placed = led.select("block", "rep", F.explode(part).alias("part"), F.lit(2).alias("side"), F.col("rep").alias("component")).withColumn("part", F.col("part").cast("long"))
    bits = reps.select("rep", "n", "bits")
    links = stored(_links(placed, bits, src, k, num, den).union(_of_one_id(member)), "links")
    discard(best, sized)
    comps = connected_components(links)
    more = stored(_links(_across(held, comps), bits, src, k, num, den), "across")
    if more.take(1):
        comps = connected_components(links.union(more))
    comps = stored(comps, "comps")
    discard(base, kept, copies, held, links, more)
    out = member.join(comps, member.rep == comps.node, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _of_one_id(member: DataFrame) -> DataFrame:
    """Links between the representatives of an id whose rows have different texts, each with the smallest."""
    of = member.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    several = stored(of.where("least < most").select("doc_id", "least"), "several")
    return member.join(several, "doc_id").where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))


def _links(placed: DataFrame, bits: DataFrame, src: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links found in the parts of (block, part, side, component, rep): bitmaps first, then the texts of what they leave."""
    n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("block", "part", "side", "rep")
    rows = stored(placed, "parts").join(bits, "rep").select(*order, "component", "n", "bits")
    dealt = rows.repartition(n, "block", "part").sortWithinPartitions(*order)
    left = dealt.mapInArrow(_prospects(num, den), "block long, part long, side int, rep long, component long")
    left = stored(left.distinct(), "prospects")
    texts = maybe_in(src.where("doc_id IS NOT NULL"), F.col("doc_id"), stored(slots_of(left, "rep"), "slots"))
    rows = texts.join(left, F.col("doc_id") == F.col("rep")).select(*order[:3], (F.col("rep") == F.col("block")).alias("first"), "component", "doc_id", "text")
    dealt = rows.repartition(n, "block", "part").sortWithinPartitions("block", "part", "side", "doc_id")
    return dealt.mapInArrow(_join_parts(k, num, den), "a long, b long")


def _across(held: DataFrame, comps: DataFrame) -> DataFrame:
    """Parts that bring together every two members of a leader's block that are in different components."""
    seen = stored(held.join(comps, held.rep == comps.node, "left").select("block", "rep", "n", F.coalesce("component", "rep").alias("component")), "seen")
    counts = seen.groupBy("block", "component").agg(F.count("*").alias("n"), F.sum("n").alias("s"))
    of = counts.groupBy("block").agg(F.max(F.struct("n", "component", "s")).alias("m"), F.sum("n").alias("all"), F.sum("s").alias("long")).where("all > m.n")
    size = lambda c, s: F.ceil(F.greatest(c / CHUNK, s / CHUNK_SHINGLES)).cast("long")
    main, others = size(F.col("m.n"), F.col("m.s")), size(F.col("all") - F.col("m.n"), F.col("long") - F.col("m.s"))
    few = (F.col("all") <= CHUNK) & (F.col("long") <= CHUNK_SHINGLES)
    grid = stored(of.select("block", few.alias("few"), F.col("m.component").alias("main"), main.alias("gm"), others.alias("go")), "grid")
    j = seen.join(grid, "block").withColumn("h", F.xxhash64("rep"))
    # most blocks are small: one part
    small = j.where("few").select("block", F.lit(0).cast("long").alias("part"), F.lit(2).alias("side"), "component", "rep")
    j = j.where("NOT few")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("x")
    cell = lambda i, o: (i * F.col("go") + o).alias("part")
    i, o = F.pmod("h", "gm"), F.pmod("h", "go")
    main = j.where("component = main").select("*", upto(F.col("go"))).select("block", cell(i, F.col("x")), F.lit(0).alias("side"), "component", "rep")
    rest = j.where("component <> main")
    to_main = rest.select("*", upto(F.col("gm"))).select("block", cell(F.col("x"), o), F.lit(1).alias("side"), "component", "rep")
    side = F.when(o == F.col("x"), 2).when(o < F.col("x"), 0).otherwise(1)
    among = rest.select("*", upto(F.col("go"))).select("block", cell(F.col("gm") + F.least(o, F.col("x")), F.greatest(o, F.col("x"))), side.alias("side"), "component", "rep")
    return small.union(main).union(to_main).union(among)


def op1_query(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 3], ' ') END AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
