"""Merkle manifest of a dataset by cogrouped subtree exchange (operator 13).

Leaves.  A row's leaf is the SHA-256 (lowercase hex, as all digests here) of its
columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value.
The leaves of a partition value (here: a language) ascend by id.  While there
are more, every two consecutive nodes become the digest of their concatenation
(a last single one: of itself).  The subroots, ordered by partition value, null
first, form one more such sequence; its root stands for the dataset.

Places.  Leaves are range-partitioned by (partition, id, leaf, row) and numbered
by task; counts by task, summed, give a leaf's place in its sequence.

Exchange.  A superblock is ``2 ** LEVELS`` consecutive nodes.  Upwards, each
superblock folds into one node, and the nodes of all superblocks are the next,
shorter table, until each sequence has one node.  Downwards, the nodes of a
superblock are cogrouped with the one outer path that they need: the siblings
between the superblock's own node and the root.  The group rebuilds its subtree
and gives every node its siblings inside followed by that path.  For the leaves
the same group joins the proof and folds the leaf, or a replacement for it, to a
root.  A group never holds more than one superblock and one path, whatever the
size of a language, and there are log(n) / LEVELS rounds.

Defined results: null and empty texts are columns as others (``-`` and ``0:``);
null ids come first; rows with one id are ordered by leaf, and equal rows are
leaves of their own; a lone leaf is its subroot; a lone subroot is the root; a
proof without siblings is the digest of the empty text; an empty table gives no
rows; columns that are not named take no part; texts of any length are digested
by Spark's ``sha2``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from detflow.llm.common import read, stage

LEVELS = 10
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(col: Column) -> Column:
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(columns: list[Column]) -> Column:
    """The leaf of a row."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def H(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- one superblock
def parents(nodes: list[str]) -> list[str]:
    return [H("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]


def height(n: int) -> int:
    """Levels between n nodes and their root."""
    return (n - 1).bit_length() if n > 1 else 0


def subtree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock and of the levels above them, up to its own node."""
    out = [nodes]
    for _ in range(levels):
        out.append(parents(out[-1]))
    return out


def siblings(tree: list[list[str]], i: int) -> list[str]:
    """One step a level: the sibling's side (L or R) and digest, or ``-``."""
    steps = []
    for level in tree[:-1]:
        j = i ^ 1
        steps.append(("L" if j < i else "R") + level[j] if j < len(level) else "-")
        i >>= 1
    return steps


def fold(node: str, steps: list[str]) -> str:
    for s in steps:
        node = H(s[1:] + node if s[0] == "L" else node + s[1:] if s[0] == "R" else node)
    return node


def proof(steps: list[str]) -> str:
    return H("".join(s[1:] for s in steps))


# ---------------------------------------------------------------- places in a sequence
def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, column 0 the sequence: adds the task and the place in it."""
    task, now, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for seq in batch.column(0).to_pylist():
            now, at = seq, at + 1 if seq == now else 0
            places.append(at)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([task] * len(places), pa.int64()), pa.array(places, pa.int64())],
            [*batch.schema.names, "task", "place"])


def sequence(spark: SparkSession, nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` (seq, ...) with pos, from 0 in the order of ``order``, and n, the
    length of the sequence; written as a stage table."""
    by = ["seq", *order]
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    rows = stage(spark, nodes.repartitionByRange(n_tasks, *by).sortWithinPartitions(*by).mapInArrow(
        numbered, schema + ", task long, place long"), f"{name}-places")
    counts = rows.groupBy("seq", "task").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("seq").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("seq", "task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
                           F.sum("rows").over(Window.partitionBy("seq")).alias("n"))
    return stage(spark, rows.join(counts, ["seq", "task"]).withColumn("pos", F.col("before") + F.col("place"))
                 .drop("task", "place", "before"), name)


# ---------------------------------------------------------------- up and down
def up(spark: SparkSession, nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (seq, pos, n, digest), each a node a superblock of the one before,
    the last with one node a sequence."""
    def node(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seq, block, n = key
        top = subtree(rows.sort_values("pos")["digest"].tolist(), min(levels, height(int(n))))[-1][0]
        return pd.DataFrame({"seq": [seq], "pos": [block], "n": [-(-int(n) // 2 ** levels)], "digest": [top]})

    tables = [nodes]
    longest = nodes.agg(F.max("n")).first()[0] or 0
    while longest > 1:
        block = F.shiftright(F.col("pos"), levels).alias("block")
        tables.append(stage(spark, tables[-1].select("seq", "pos", "n", "digest").groupBy("seq", block, "n")
                            .applyInPandas(node, "seq string, pos long, n long, digest string"), "nodes"))
        longest = -(-longest // 2 ** levels)
    return tables


def cogrouped(nodes: DataFrame, outer: DataFrame, levels: int, finish, schema: str) -> DataFrame:
    """Superblocks of ``nodes`` with the outer path of their own node (``outer``:
    seq, pos, path, subroot, root).  ``finish(rows, steps of each row, outer row)``
    makes the rows of ``schema``."""
    def group(rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree = subtree(rows["digest"].tolist(), min(levels, height(int(rows["n"].iloc[0]))))
        above = path["path"].iloc[0]
        above = above.split(",") if above else []
        return finish(rows, [siblings(tree, i) + above for i in range(len(rows))], path.iloc[0])

    block = F.shiftright(F.col("pos"), levels)
    return (nodes.withColumn("block", block).groupBy("seq", "block")
            .cogroup(outer.withColumnRenamed("pos", "block").groupBy("seq", "block"))
            .applyInPandas(group, schema))


PATH = "seq string, pos long, path string, subroot string, root string"


def down(spark: SparkSession, tables: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes of the first of ``tables``, from those of the last."""
    def paths(rows: pd.DataFrame, steps: list[list[str]], path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"seq": rows["seq"], "pos": rows["pos"], "path": [",".join(s) for s in steps],
                             "subroot": path["subroot"], "root": path["root"]})

    for nodes in reversed(tables[:-1]):
        outer = stage(spark, cogrouped(nodes, outer, levels, paths, PATH), "paths")
    return outer


@dataclass
class Manifest:
    """``leaves``: a row a leaf; ``subroots``: partition, subroot, root; ``tables``:
    the nodes between them; ``paths``: from each subroot to the root."""
    spark: SparkSession
    leaves: DataFrame
    tables: list[DataFrame]
    paths: DataFrame
    levels: int

    @property
    def subroots(self) -> DataFrame:
        return self.paths.select(F.expr("if(seq = '', null, substr(seq, 2))").alias("partition"), "subroot", "root")

    def proofs(self) -> DataFrame:
        """A row a leaf: its proof, and the root that its replacement, if it has
        one, else the leaf itself folds to."""
        def finish(rows: pd.DataFrame, steps: list[list[str]], path: pd.Series) -> pd.DataFrame:
            folded = [fold(new or old, s) for new, old, s in zip(rows["altered"], rows["digest"], steps)]
            return pd.DataFrame({
                "doc_id": rows["id"], "leaf": rows["digest"], "subroot": path["subroot"], "root": path["root"],
                "proof_sha256": [proof(s) for s in steps], "folded_root": folded, "verified": [f == path["root"] for f in folded]})

        leaves = self.leaves.withColumn("id", F.col("id").cast("string"))      # pandas has no null integers
        if len(self.tables) == 1:       # no sequence has two nodes: the paths of the subroots are those of the leaves
            out = cogrouped(leaves, self.paths, 0, finish, PROOF)
        else:
            out = cogrouped(leaves, down(self.spark, self.tables[1:], self.paths, self.levels), self.levels, finish, PROOF)
        return out.withColumn("doc_id", F.col("doc_id").cast(self.leaves.schema["id"].dataType))


def build(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id",
          part_col: str = "lang", altered: dict[str, Column] | None = None, where: Column | None = None,
          levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs``.  Where ``where`` holds, proofs are folded from the
    row with the columns of ``altered`` in place of its own."""
    part = F.col(part_col).cast("string")
    altered = altered or {}
    changed = digest([altered.get(c, F.col(c)) for c in columns])
    leaves = stage(spark, docs.select(
        F.coalesce(F.concat(F.lit("="), part), F.lit("")).alias("seq"), F.col(id_col).alias("id"),
        digest([F.col(c) for c in columns]).alias("digest"),
        (F.when(where, changed) if where is not None else F.lit(None).cast("string")).alias("altered"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    leaves = sequence(spark, leaves, ["id", "digest", "row"], "ordered-leaves")
    tables = up(spark, leaves, levels)
    # The subroots are one more sequence, ordered by partition value.
    subroots = tables[-1].select(F.lit("").alias("seq"), F.col("seq").alias("part"), "digest")
    top = sequence(spark, subroots, ["part"], "subroots")
    top_tables = up(spark, top, levels)
    root = top_tables[-1].select("seq", "pos", F.lit("").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    paths = down(spark, top_tables, root, levels)
    paths = stage(spark, top.select("pos", "part", "digest").join(paths, "pos").select(
        F.col("part").alias("seq"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"), "subroot-paths")
    return Manifest(spark, leaves, tables, paths, levels)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return build(spark, docs, altered={"n_chars": F.col("n_chars") + 1}, where=tampered).proofs()


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
fields AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS altered
  FROM fields),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
up AS (
  SELECT lang, CAST(0 AS BIGINT) AS lvl, CAST(pos AS BIGINT) AS pos, leaf AS h, CAST(n AS BIGINT) AS n FROM seq
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM up WHERE n > 1
  GROUP BY lang, lvl, pos // 2, n),
subs AS (
  SELECT lang, lvl AS tall, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT CAST(0 AS BIGINT) AS lvl, CAST(pos AS BIGINT) AS pos, subroot AS h, CAST(n AS BIGINT) AS n FROM subs
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
root AS (SELECT lvl AS tall, h AS root FROM top WHERE n = 1),
steps AS (
  SELECT s.lang, s.pos, u.lvl AS step, o.h, o.pos < u.pos AS on_left
  FROM seq s JOIN up u ON u.lang IS NOT DISTINCT FROM s.lang AND u.pos = s.pos >> CAST(u.lvl AS INT) AND u.n > 1
  LEFT JOIN up o ON o.lang IS NOT DISTINCT FROM u.lang AND o.lvl = u.lvl AND o.pos = xor(u.pos, 1)
  UNION ALL
  SELECT s.lang, s.pos, b.tall + u.lvl, o.h, o.pos < u.pos
  FROM seq s JOIN subs b ON b.lang IS NOT DISTINCT FROM s.lang
  JOIN top u ON u.pos = b.pos >> CAST(u.lvl AS INT) AND u.n > 1
  LEFT JOIN top o ON o.lvl = u.lvl AND o.pos = xor(u.pos, 1)),
paths AS (
  SELECT lang, pos, coalesce(string_agg(h, '' ORDER BY step), '') AS siblings,
         list({'h': h, 'on_left': on_left} ORDER BY step) AS path FROM steps GROUP BY lang, pos),
folded AS (
  SELECT s.*, coalesce(p.siblings, '') AS siblings, p.path, CAST(1 AS BIGINT) AS i, coalesce(s.altered, s.leaf) AS f
  FROM seq s LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM s.lang AND p.pos = s.pos
  UNION ALL
  SELECT doc_id, lang, leaf, altered, pos, n, siblings, path, i + 1,
         sha256(CASE WHEN path[i].h IS NULL THEN f WHEN path[i].on_left THEN path[i].h || f ELSE f || path[i].h END)
  FROM folded WHERE i <= coalesce(len(path), 0))
SELECT f.doc_id, f.leaf, b.subroot, r.root, sha256(f.siblings) AS proof_sha256, f.f AS folded_root, f.f = r.root AS verified
FROM folded f JOIN subs b ON b.lang IS NOT DISTINCT FROM f.lang, root r
WHERE f.i = coalesce(len(f.path), 0) + 1
"""
