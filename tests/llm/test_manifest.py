import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from detflow.llm import manifest as M
from detflow.llm.common import read


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root and, per node, its siblings as (digest, left) or None, a level each."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append((nodes[j], j < i) if j < len(nodes) else None)
            at[k] = i // 2
        nodes = [H("".join(nodes[i:i + 2])) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) to the contract's rows."""
    by = {}
    for r in rows:
        new = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
            new = (*r[:3], r[3] + 1, r[4])
        by.setdefault(r[2], []).append((r[0], leaf(r), leaf(new)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    sub = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        sub[lang] = tree([x[1] for x in by[lang]])
    root, tops = tree([sub[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, tops):
        for (i, old, new), path in zip(by[lang], sub[lang][1]):
            steps, node = path + top, new
            for s in steps:
                node = H(node if s is None else s[0] + node if s[1] else node + s[0])
            out.append((i, old, sub[lang][0], root, H("".join(s[0] for s in steps if s)), node, node == root))
    return out


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def run(spark, df, levels):
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return M.build(spark, df, altered={"n_chars": F.col("n_chars") + 1}, where=tampered, levels=levels).proofs()


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_against_brute_force(spark, levels):
    langs = [None, "", "en", "EN", "é", "\U0001f600", ""]
    rows = [(i, f"s{i % 3}" if i % 5 else None, langs[i * i % 7 if i % 4 else 2], i * 7 if i % 6 else None,
             [None, "", "x\ny", "ä" * i][i % 4]) for i in range(150)]
    rows += [(None, "a", "en", 1, "t"), (None, None, None, None, None), (3, "a", "en", 1, "t"), (3, "a", "en", 1, "t"),
             (2 ** 60 + 1, "b", "en", 2, "u"), (500, "b", "only", 2, "long " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"seq": F.lit("x"), "pos": F.lit(1), "path": F.lit("y"), "row": F.lit(2)})
    assert got(run(spark, df.repartition(5), levels)) == sorted(brute(rows), key=repr)


def test_lone_rows_and_empty_table(spark):
    rows = [(1, "a", "en", 3, "one")]
    assert got(run(spark, spark.createDataFrame(rows, SCHEMA), 10)) == brute(rows)
    rows += [(7, "a", "de", 3, "one")]
    assert got(run(spark, spark.createDataFrame(rows, SCHEMA), 10)) == sorted(brute(rows), key=repr)
    empty = run(spark, spark.createDataFrame([], SCHEMA), 10)
    assert empty.columns == COLS and empty.count() == 0


def test_subroots(spark):
    rows = [(i, "a", "en" if i % 2 else None, i, str(i)) for i in range(9)]
    m = M.build(spark, spark.createDataFrame(rows, SCHEMA), levels=2)
    want = {r[2] for r in brute(rows)}
    assert {r["subroot"] for r in m.subroots.collect()} == want
    assert {r["partition"] for r in m.subroots.collect()} == {None, "en"}


def test_op13_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    out = got(M.op13_manifest(spark, sf))
    assert out == sorted(brute(rows), key=repr) and 0 < sum(not r[-1] for r in out) < len(out) / 4
