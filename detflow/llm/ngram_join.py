"""Exact n-gram Jaccard join with prefixes and a prefix tree (operator 7).

Sets.  A text's set holds the 64-bit hashes of its distinct word n-grams, in one
global order (by hash).  Equal sets are one class; all later work is on classes.

Candidates.  Let p(n) = n - ceil(t n) + 1, and call the first 2 p(n) hashes of a
set its head.  A pair that links shares at least I = t (n_x + n_y) / (1 + t)
hashes; of those all but n_x - I of x's head, and all but n_y - I of y's, lie in
the head, and the lesser of the two numbers lies in both heads.  With this number
o, the rarest hash (by its number of classes over the whole corpus) of both heads
is among the |head| - o + 1 rarest of each, so x probes with these, y is found
under these alone, and at a common hash at least o - 1 others must follow in
either.  Hashes that no other class has only need to be counted.  Common
passages are frequent, so they end up among the hashes left out on both sides.

Pairs.  All pairs of a large group of near copies are never made.  First every
class is compared with one centre that shares enough of its hashes, in a few
rounds with other centres, and linked classes become components.  Then only
pairs of classes in different components are left, and those are all compared.
Classes with one centre share blocks of bounded size; a probe's token brings two
blocks together instead of two classes, unless both hold one and the same
component, and a whole set is sent once to each pair of blocks.  A pair of blocks
gives back a spanning forest of its components, not its linked pairs.

Verification.  The sets of a block are sorted.  Rows in that order are a
depth-first walk of the prefix tree of the sets: the overlaps of the path shared
with the row before are kept, one for each probe of the other block, a row
continues below it, and a probe is left, and with the last one the subtree, when
its overlap so far plus what the remaining lengths allow is too small.

Defined results: null, empty and blank texts have an empty set and only
themselves as component; a null doc_id is linked with nothing and has a null
component; repeated rows get a row each; an empty table gives no rows; other
columns are ignored.  Sets are compared by 64-bit hashes of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detflow.llm.common import keep_rows, read, release, stage

N = 4
PERCENT = 85
ROUNDS = 2
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
KEPT_WORDS = 100_000
SETS_PER_BATCH = 128        # rows of whole sets that a Python worker reads at once
BLOCK_CLASSES = 64          # a block's classes and hashes, on average; larger groups get more blocks
BLOCK_HASHES = 100_000
SALTS = 32                  # tasks that a group of more than one block is dealt out to


class WordHashes(dict):
    """Word bytes to 64-bit hashes; looked-up words are kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def ngram_set(text: str | None, hashes: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * MULTIPLIER + h[i:len(h) - k + 1 + i]
    out ^= out >> np.uint64(31)
    out *= MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def spare(n: int | Column, percent: int):
    """p(n) = n - ceil(percent n / 100) + 1."""
    if isinstance(n, int):
        return n - (percent * n + 99) // 100 + 1
    return n - F.floor((F.lit(percent) * n + 99) / 100) + 1


def shared_least(percent: int) -> tuple[Fraction, Fraction]:
    """The least o of a pair that links, as a share of the size of its smaller
    and of its larger set.  o is the lesser of two functions that are linear in
    the other size, so it is least at an end of that size's range."""
    t = Fraction(percent, 100)
    head = min(2 * (1 - t), Fraction(1))                    # a head is no smaller share of its set
    equal = head - 1 + 2 * t / (1 + t)
    return min(equal, head, (head - 1 + t) / t), min(equal, head * t, head - 1 + t)


def at_least(share: Fraction, size: Column) -> Column:
    """ceil(share size), 1 at least."""
    return F.greatest(F.lit(1), F.floor((size * share.numerator + (share.denominator - 1)) / share.denominator))


def shared_of_pair(percent: int, x_least: Column, x_most: Column, y_least: Column, y_most: Column) -> Column:
    """A lower bound of o for sizes in these ranges."""
    t = percent / 100
    both, own = t / (1 + t), min(2 * (1 - t), 1.0) - 1 + t / (1 + t)
    of = lambda least, most, other: own * (most if own < 0 else least) + both * other
    return F.least(of(x_least, x_most, y_least), of(y_least, y_most, x_least)) - 1e-6


def set_rows(batches: Iterable[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, version to size, signature and first 2 p hashes."""
    hashes = WordHashes()
    for batch in batches:
        size, high, low, first = [], [], [], []
        for text in batch.column(1):
            s = ngram_set(text.as_py(), hashes, n)
            signature = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            size.append(len(s))
            high.append(signature[0])
            low.append(signature[1])
            first.append(s[:2 * spare(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
             pa.array(first, pa.list_(pa.int64()))], ["doc_id", "version", "size", "high", "low", "first"])


def whole_sets(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Columns class, high, low, text to (class, set as big-endian bytes, which
    sort like the hashes), for texts of that signature."""
    hashes = WordHashes()
    for batch in batches:
        classes, sets = [], []
        for c, high, low, text in zip(*(batch.column(i) for i in range(4))):
            s = ngram_set(text.as_py(), hashes, n)
            signature = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
            if signature[0] == high.as_py() and signature[1] == low.as_py():
                classes.append(c.as_py())
                sets.append(s.astype(">u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(sets, pa.binary())], ["class", "set"])


class BlockWalk:
    """Overlaps of sets, taken in lexicographic order, with every probe of a block."""

    STEP = 64

    def __init__(self, probes: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(p) for p in probes], np.int64)
        self.hashes = np.unique(np.concatenate(probes))
        # a row a hash, and a last one without members for hashes of no probe
        self.holds = np.zeros((len(self.hashes) + 1, len(probes)), np.uint8)
        for j, probe in enumerate(probes):
            self.holds[np.searchsorted(self.hashes, probe), j] = 1
        self.up_to = np.zeros(self.holds.shape, np.int32)       # at i: members among the first i hashes
        np.cumsum(self.holds[:-1], axis=0, out=self.up_to[1:])
        self.path = np.zeros(0, np.uint64)                      # the last set, as far as it was walked
        self.overlap = np.zeros((1, len(probes)), np.int64)     # at i: overlaps of the first i of the path

    def linked(self, own: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """Which of the wanted probes (None: of all) link with ``own``."""
        n = len(own)
        need = -(-self.percent * (n + self.sizes) // (100 + self.percent))
        alive = need <= np.minimum(n, self.sizes)
        if wanted is not None:
            alive &= wanted
        if not alive.any():
            return alive
        m = min(len(self.path), n)
        differs = np.flatnonzero(self.path[:m] != own[:m])
        at = int(differs[0]) if len(differs) else m             # depth of the common path
        parts, total = [self.overlap[:at + 1]], self.overlap[at]
        where = np.searchsorted(self.hashes, own)
        passed = where + (self.hashes[np.minimum(where, len(self.hashes) - 1)] == own)
        rows = np.where(passed > where, where, len(self.hashes))
        while True:
            # what is left of a probe lies above the last hash walked
            rest = self.sizes - self.up_to[passed[at - 1]] if at else self.sizes
            alive &= total + np.minimum(n - at, rest) >= need
            if at == n or not alive.any():
                break
            counts = total + np.cumsum(self.holds[rows[at:at + self.STEP]], axis=0, dtype=np.int64)
            parts.append(counts)
            total, at = counts[-1], at + len(counts)
        self.path, self.overlap = own[:at], np.concatenate(parts)
        return alive


class TreeWalk(BlockWalk):
    """Overlaps of sets with one probe."""

    def __init__(self, probe: np.ndarray, percent: int):
        super().__init__([probe], percent)

    def links(self, own: np.ndarray) -> bool:
        return bool(self.linked(own)[0])


def verify_rows(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Columns x, y, x_set, y_set sorted by (y, x_set): the pairs that link."""
    walk, current = None, None
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            y = batch.column(1)[i].as_py()
            if y != current:
                current = y
                walk = TreeWalk(np.frombuffer(batch.column(3)[i].as_buffer(), ">u8").astype(np.uint64), percent)
            keep.append(walk.links(np.frombuffer(batch.column(2)[i].as_buffer(), ">u8").astype(np.uint64)))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


class Forest:
    """Components joined so far, within a pair of blocks."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, node: int) -> int:
        while (up := self.parent.get(node, node)) != node:
            self.parent[node] = self.parent.get(up, up)
            node = up
        return node


def verify_units(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Columns low, high, side, class, component, set sorted by (low, high,
    side, set), side 0 the probes of a pair of blocks and side 1 the sets to
    walk, to pairs (a, b) of components: a spanning forest of those that a
    link joins within the pair of blocks."""
    unit, probes, groups, walk, forest = None, [], [], None, Forest()
    for batch in batches:
        a, b = [], []
        keys = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)))
        for i, (low, high, side, group) in enumerate(keys):
            if (low, high) != unit:
                unit, probes, groups, walk, forest = (low, high), [], [], None, Forest()
            own = np.frombuffer(batch.column(5)[i].as_buffer(), ">u8").astype(np.uint64)
            if side == 0:
                probes.append(own)
                groups.append(group)
                continue
            if walk is None:
                # a probe's tree: a set is not compared with those of its own
                walk, trees = BlockWalk(probes, percent), np.array(groups, np.int64)
            for j in np.flatnonzero(walk.linked(own, trees != forest.root(group))):
                one, other = forest.root(group), forest.root(groups[j])
                if one != other:
                    a.append(group)
                    b.append(groups[j])
                    forest.parent[other] = one
                    trees[trees == other] = one
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): least neighbours with
    pointer jumping on a graph that is contracted after every step."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    graph = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = None
    while labels is None or not graph.isEmpty():
        least = stage(spark, graph.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "least")
        jump = least.select(F.col("u").alias("to"), F.col("to").alias("next"))
        step = stage(spark, least.join(jump.hint("merge"), "to").select(F.col("u").alias("from"), F.col("next").alias("to")), "jumps")
        if labels is None:
            labels = step.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            labels = stage(spark, labels.join(step.hint("merge"), labels["component"] == step["from"], "left").select(
                "node", F.coalesce("to", "component").alias("component")), "labels")
        left = step.select(F.col("from").alias("u"), F.col("to").alias("u2"))
        right = step.select(F.col("from").alias("v"), F.col("to").alias("v2"))
        graph = stage(spark, graph.join(left.hint("merge"), "u").join(right.hint("merge"), "v").where("u2 <> v2")
                      .select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct(), "edges")
    return labels


class Join:
    """The join of one table; see the module's text."""

    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        self.spark, self.percent = spark, percent
        texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                            F.xxhash64(text_col).alias("version"))
        id_type = docs.schema[id_col].dataType.simpleString()
        self.sets = stage(spark, texts.mapInArrow(
            lambda b: set_rows(b, n, percent), f"doc_id {id_type}, version long, size long, high long, low long, first array<long>"), "sets")
        classes = (self.sets.where("size > 0 AND doc_id IS NOT NULL").groupBy("high", "low")
                   .agg(F.min(F.struct("doc_id", "version")).alias("row"), F.first("size").alias("size"), F.first("first").alias("first"))
                   .select("high", "low", "row.*", "size", "first").withColumn("class", F.monotonically_increasing_id()))
        self.classes = stage(spark, classes, "classes")
        entries = self.classes.select("class", F.col("size").cast("int").alias("size"), F.explode("first").alias("hash"))
        frequent = stage(spark, entries.groupBy("hash").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "frequent")
        shared = stage(spark, entries.join(frequent.hint("merge"), "hash"), "shared")
        size = F.col("size").cast("long")
        smaller, larger = (at_least(share, size) for share in shared_least(percent))
        able = (shared.groupBy("class", "size").agg(F.count("*").alias("n"))
                .where(F.col("n") >= F.least(smaller, larger)).select("class"))
        able = stage(spark, able, "able")
        self.shared = stage(spark, shared.join(able.hint("merge"), "class"), "able-shared")
        # the hashes of no other class come first in the order, so of the n others
        # all but the last o - 1 are among the |head| - o + 1 rarest
        by_class = Window.partitionBy("class")
        rarest = self.shared.select(
            "class", "size", "hash", F.count("*").over(by_class).alias("n"),
            F.row_number().over(by_class.orderBy("df", "hash")).alias("rank")).withColumn("rest", F.col("n") - F.col("rank") + 1)
        ranked = stage(spark, rarest.where(F.col("rest") >= F.least(smaller, larger)).select("class", "size", "hash", "rest"), "ranked")
        self.probes, self.index = ranked.where(F.col("rest") >= smaller), ranked.where(F.col("rest") >= larger)
        release(spark, frequent, shared)
        chosen = self.classes.select("class", "high", "low", "doc_id", "version").join(able.hint("merge"), "class")
        self.whole = stage(spark, chosen.join(texts.hint("merge"), ["doc_id", "version"]).select("class", "high", "low", "text")
                           .mapInArrow(lambda b: whole_sets(b, n), "class long, set binary")
                           .dropDuplicates(["class"]), "whole-sets")
        release(spark, able)
        self.centres: DataFrame | None = None       # each class and the centre it was first compared with
        self.edges: DataFrame | None = None
        self.labels: DataFrame | None = None

    def _labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("component", F.col("class"))
        return rows.join(self.labels.hint("merge"), rows["class"] == self.labels["node"], "left").drop("node").withColumn(
            "component", F.coalesce("component", "class"))

    def _near(self, a: Column, b: Column) -> Column:
        return F.lit(100) * F.least(a, b) >= F.lit(self.percent) * F.greatest(a, b)

    def _link(self, edges: DataFrame) -> None:
        """Take up edges (a, b), and bring the components up to date."""
        before, conf, key = self.edges, self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        usual = conf.get(key)
        conf.set(key, SETS_PER_BATCH)
        try:
            self.edges = stage(self.spark, edges if before is None else before.unionByName(edges), "links")
        finally:
            conf.set(key, usual)
        release(self.spark, *([before] if before is not None else []))
        self.labels = components(self.spark, self.edges)

    def centre_round(self, seed: int) -> None:
        own = [] if self.labels is None else [stage(self.spark, self._labelled(self.shared), "round")]
        rows = own[0] if own else self._labelled(self.shared)
        centre = rows.groupBy("hash").agg(F.min(F.struct(
            F.xxhash64("component", F.lit(seed)).alias("c"), F.xxhash64("class", F.lit(seed)).alias("k"),
            F.col("class").alias("y"), F.col("size").alias("y_size"), F.col("component").alias("y_component"))).alias("to"))
        centre = stage(self.spark, centre.select("hash", "to.y", "to.y_size", "to.y_component"), "centres")
        both = rows.join(centre.hint("merge"), "hash").where(
            (F.col("component") != F.col("y_component")) & self._near(F.col("size"), F.col("y_size")))
        counted = both.groupBy("class", "size", "y", "y_size").agg(F.count("*").alias("n")).where(
            F.col("n") > spare(F.least("size", "y_size").cast("long"), self.percent))
        best = counted.groupBy("class").agg(F.max(F.struct("n", "y")).alias("to"))
        pairs = stage(self.spark, best.select(F.col("class").alias("x"), F.col("to.y").alias("y")), "pairs")
        release(self.spark, centre, *own)
        if self.centres is None:
            self.centres = pairs
        percent = self.percent
        x = self.whole.select(F.col("class").alias("x"), F.col("set").alias("x_set"))
        y = self.whole.select(F.col("class").alias("y"), F.col("set").alias("y_set"))
        found = (pairs.join(x.hint("merge"), "x").join(y.hint("merge"), "y").select("x", "y", "x_set", "y_set")
                 .sortWithinPartitions("y", "x_set").mapInArrow(lambda b: verify_rows(b, percent), "x long, y long"))
        self._link(found.select(F.col("x").alias("a"), F.col("y").alias("b")))

    def _blocks(self) -> DataFrame:
        """(class, component, size, block): classes with the same first centre
        and, if they are linked with any, the same component share blocks."""
        classes = self.shared.select("class", "size").distinct()
        if self.centres is not None:
            heads = self.centres.select(F.col("y").alias("class"), F.col("y").alias("head")).distinct()
            follows = self.centres.select(F.col("x").alias("class"), F.col("y").alias("follows"))
            classes = classes.join(heads.hint("merge"), "class", "left").join(follows.hint("merge"), "class", "left")
            group = F.coalesce("head", "follows", "class")
        else:
            group = F.col("class")
        many = self.labels.select(F.col("node").alias("class"), F.col("component").alias("label")) if self.labels is not None else None
        classes = classes.withColumn("label", F.lit(None).cast("long")) if many is None else classes.join(
            many.hint("merge"), "class", "left")
        key = F.xxhash64(group, F.coalesce("label", F.lit(-1)))
        classes = stage(self.spark, classes.select(
            "class", "size", F.coalesce("label", "class").alias("component"), key.alias("key")), "keyed")
        parts = classes.groupBy("key").agg(F.ceil(F.greatest(
            F.count("*") / BLOCK_CLASSES, F.sum(F.col("size").cast("long")) / BLOCK_HASHES)).alias("parts")).where("parts > 1")
        # a large group's classes are dealt out by a salt as well
        parts = parts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        salted = classes.withColumn("salt", F.pmod(F.xxhash64("class", "key"), F.lit(SALTS).cast("long")))
        part = F.pmod(F.xxhash64("class"), F.coalesce("parts", F.lit(1)))
        blocks = salted.join(parts.hint("merge"), ["key", "salt"], "left").select(
            "class", "size", "component", F.xxhash64("key", part).alias("block"))
        return stage(self.spark, blocks, "blocks")

    def finish(self) -> None:
        """Compare all pairs of classes in different components that can link:
        tokens bring pairs of blocks together, and each pair of blocks is
        walked once."""
        blocks = self._blocks()

        def of_blocks(rows: DataFrame, name: str) -> DataFrame:
            rows = rows.select("hash", "class", "rest").join(blocks.hint("merge"), "class").groupBy("hash", "block").agg(
                F.min("component").alias("least"), F.max("component").alias("most"), F.max("rest").alias("rest"),
                F.min(F.col("size").cast("long")).alias("shortest"), F.max(F.col("size").cast("long")).alias("longest"))
            return stage(self.spark, rows, name)

        index, probes = of_blocks(self.index, "index"), of_blocks(self.probes, "asked")
        several = index.groupBy("hash").agg(
            F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("hash")
        several = stage(self.spark, several, "several")
        x, y = (rows.join(several.hint("merge"), "hash", "left_semi").select(
            "hash", *(F.col(c).alias(f"{side}_{c}") for c in rows.columns[1:])) for rows, side in ((probes, "x"), (index, "y")))
        units = x.join(y.hint("merge"), "hash").where(
            (F.least("x_least", "y_least") < F.greatest("x_most", "y_most")) & (F.col("x_shortest") <= F.col("y_longest"))
            & (F.lit(100) * F.col("x_longest") >= F.lit(self.percent) * F.col("y_shortest"))
            & (F.least("x_rest", "y_rest") >= shared_of_pair(
                self.percent, F.col("x_shortest"), F.col("x_longest"), F.col("y_shortest"), F.col("y_longest"))))
        units = stage(self.spark, units.select(
            F.least("x_block", "y_block").alias("low"), F.greatest("x_block", "y_block").alias("high")).distinct(), "units")
        release(self.spark, index, probes, several, self.shared, self.probes, self.index)
        members = stage(self.spark, blocks.select("class", "component", "block").join(self.whole.hint("merge"), "class"), "members")
        sides = [units.withColumn("side", F.lit(side)).join(members.withColumnRenamed("block", name).hint("merge"), name)
                 .select("low", "high", "side", "class", "component", "set") for side, name in enumerate(("low", "high"))]
        percent = self.percent
        found = (sides[0].unionByName(sides[1]).repartition("low", "high").sortWithinPartitions("low", "high", "side", "set")
                 .mapInArrow(lambda b: verify_units(b, percent), "a long, b long"))
        self._link(found.distinct())
        release(self.spark, units, members, blocks)


def joined(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, rounds: int) -> Join:
    work = Join(spark, docs, id_col, text_col, n, percent)
    for seed in range(rounds):
        work.centre_round(seed)
    work.finish()
    return work


def join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
         percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, version, n_shingles, component_id) of every row of ``docs``;
    ``version`` is the xxhash64 of the text."""
    work = joined(spark, docs, id_col, text_col, n, percent, rounds)
    named = work._labelled(work.classes.select("class", "high", "low", "doc_id"))
    least = stage(spark, named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least-ids")
    of_class = stage(spark, named.join(least.hint("merge"), "component").select("high", "low", "component_id"), "class-ids")
    rows = work.sets.select("doc_id", "version", "size", "high", "low").join(of_class.hint("merge"), ["high", "low"], "left")
    return rows.select("doc_id", "version", F.col("size").alias("n_shingles"), F.when(
        (F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one (the smallest doc_id) of each
    component; rows with a null doc_id or an empty set stay.  Components are told
    apart by their own number, so a doc_id that unlinked texts share joins none."""
    work = joined(spark, docs, id_col, text_col, N, PERCENT, ROUNDS)
    of_class = work._labelled(work.classes.select("class", "high", "low")).select("high", "low", "component")
    rows = work.sets.select("doc_id", "version", "size", "high", "low").join(of_class.hint("merge"), ["high", "low"], "left")
    rows = stage(spark, rows.select("doc_id", "version", F.when(
        (F.col("size") > 0) & F.col("doc_id").isNotNull(), F.col("component")).alias("component")), "components")
    linked = rows.where("component IS NOT NULL").groupBy("component").agg(
        F.min(F.struct("doc_id", "version")).alias("kept")).select("kept.*")
    kept = linked.unionByName(rows.where("component IS NULL").select("doc_id", "version"))
    return keep_rows(docs, stage(spark, kept, "kept-rows"), id_col, text_col)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, read(spark, sf_dir, "documents")).drop("version")
