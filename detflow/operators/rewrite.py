"""Rewrite parent sentences so determiners agree with the assigned noun types
(R1-R4, J1, J4, A10).

Plan (all variants at once):
  1. explode only the <= 3-token windows after each a/the determiner (narrow);
  2. join window tokens to the noun map on the lowercase word  [J1], one row per
     noun with its types of every variant;
  3. regroup by sentence and determiner: first two typed words -> decision per variant;
  4. conflicts draw a replacement exclusive noun by an equi-join on
     (model_type, type, idx)  [J4];
  5. the outcome is an edit log (``editlog.py``), not text.
Windows always read the original tokens, so determiners are independent; when
two determiners adapt the same word the later one wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detflow.functions import text as T
from detflow.functions.draws import h
from detflow.functions.tagger import tag_tokens
from detflow.operators import editlog as EL
from detflow.operators import pairing as D
from detflow.operators.assign import exclusive_nouns
from detflow.operators.joins import join_checked
from detflow.sources.tables import VARIANTS

LOOKAHEAD = 3
REWRITE_VARIANTS = [v for v in VARIANTS if v[0] != 100]


def _type_word(c) -> F.Column:
    return F.when(c == "A", F.lit("a")).otherwise(F.lit("the"))


def windows(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, det_idx, det_type, j, word) for the tokens after each a/the DET."""
    j = [F.col("det_idx") + k for k in range(1, LOOKAHEAD + 1)]
    after = F.array(*[F.when(i < F.size("_t"), F.struct(i.alias("j"), F.get("_t", i)["word"].alias("word"))) for i in j])
    kind = F.when(F.col("det") == "a", F.lit("A")).otherwise(F.lit("B")).alias("det_type")
    x = D.determiners(df, keys).select(*keys, "det_idx", kind, F.explode(after).alias("w"))
    return x.where("w IS NOT NULL").select(*keys, "det_idx", "det_type", "w.*")


def type_codes(noun_types: DataFrame, variants: list[int]) -> DataFrame:
    """(noun, codes): one row per noun with its types per variant, in the order of
    ``variants``: 1 A, 2 B, 3 both, 0 none."""
    code = (F.when(F.array_contains("types", "A"), 1).otherwise(0) + F.when(F.array_contains("types", "B"), 2).otherwise(0))
    each = [F.max(F.when(F.col("model_type") == m, code).otherwise(0)).alias(f"c{m}") for m in variants]
    return noun_types.groupBy("noun").agg(*each).select("noun", F.array(*[F.col(f"c{m}") for m in variants]).alias("codes"))


def _first_typed() -> tuple[F.Column, F.Column]:
    """Places in ``all`` of the first two words that variant ``v`` has a type for.  A window is
    at most LOOKAHEAD words; only where a ``uid`` repeats are there more, and a lambda is run."""
    typed = lambda i: F.get(F.get("all", i)["codes"], F.col("v")) > 0
    a, b, c = (F.coalesce(typed(F.lit(i)), F.lit(False)) for i in range(3))
    every = F.filter(F.sequence(F.lit(0), F.size("all") - 1), typed)
    few = F.size("all") <= 3
    return (F.when(few, F.when(a, 0).when(b, 1).when(c, 2)).otherwise(F.get(every, F.lit(0))),
            F.when(few, F.when(a & b, 1).when((a | b) & c, 2)).otherwise(F.get(every, F.lit(1))))


def decisions(df: DataFrame, noun_types: DataFrame, variants=REWRITE_VARIANTS) -> DataFrame:
    """One row per (model_type, uid, det_idx) with >= 1 typed word in its window.

    A window is looked up and grouped once for all variants: a noun carries its
    types of every variant, the rows are brought together by ``uid``, and the
    variants are made from the group.  Grouping by (uid, det_idx) and everything
    that follows per sentence needs no further exchange.  ``df`` with a
    ``model_type`` column (later passes) keeps to the codes of its variant."""
    own = "model_type" in df.columns
    keys = ["model_type", "uid"] if own else ["uid"]
    variants = [m for m, _ in variants]
    w = windows(df, keys).withColumn("noun", F.lower("word"))
    # the noun map is one row per noun: broadcast after a size check, else a
    # shuffle join on noun with salts for hot nouns
    typed = join_checked(w, type_codes(noun_types, variants), ["noun"])
    g = typed.repartition("uid").groupBy(*keys, "det_idx", "det_type").agg(
        F.sort_array(F.collect_list(F.struct("j", "word", "codes"))).alias("all"))
    number = F.array_position(F.array(*[F.lit(m) for m in variants]), F.col("model_type")).cast("int") - 1
    if own:
        g = g.withColumn("v", number).where("v >= 0")
    else:
        g = g.select("*", F.posexplode(F.array(*[F.lit(m) for m in variants])).alias("v", "model_type"))
    one, two = _first_typed()
    g = g.select("*", one.alias("_one"), two.alias("_two")).where("_one IS NOT NULL")
    first, second = F.get("all", F.col("_one")), F.get("all", F.col("_two"))
    g = g.withColumns({"_c1": F.get(first["codes"], F.col("v")), "_c2": F.coalesce(F.get(second["codes"], F.col("v")), F.lit(0))})
    n, c1, c2 = F.when(F.col("_two").isNull(), 1).otherwise(2), F.col("_c1"), F.col("_c2")
    letter = lambda c: F.when(c == 1, "A").otherwise("B")
    final = (F.when(c1 != 3, letter(c1)).when((n > 1) & (c2 != 3), letter(c2)).otherwise(F.col("det_type")))
    conflict = (n >= 2) & (c1 != 3) & (c2 != 3) & (c1 != c2)
    return g.select(
        "model_type", "uid", "det_idx", "det_type", final.alias("final_type"), conflict.alias("conflict"),
        F.lower(first["word"]).alias("word1"), second["j"].alias("j2"))


def swap_edits(dec: DataFrame, noun_types: DataFrame, pass_no: int = 1) -> DataFrame:
    """For each conflict, a uniform draw among the exclusive nouns of the
    target type other than word 1 (word 1 is always in that list, so the draw is
    ``r = h % (n-1)``, shifted past word 1's index).  No candidate -> no edit."""
    ex = exclusive_nouns(noun_types)
    c = dec.where("conflict").select("model_type", "uid", "det_idx", "j2", "word1",
                                     F.col("final_type").alias("type"))
    w1 = ex.select("model_type", "type", F.col("noun").alias("word1"), F.col("idx").alias("idx1"), "n")
    c = c.join(w1, ["model_type", "type", "word1"]).where(F.col("n") > 1)
    r = h("uid", "det_idx", F.lit("swap"), "model_type", F.lit(pass_no)) % (F.col("n") - 1)
    c = c.withColumn("idx", F.when(r >= F.col("idx1"), r + 1).otherwise(r))
    c = c.join(ex.select("model_type", "type", "idx", F.col("noun").alias("new_word")), ["model_type", "type", "idx"])
    return c.select("model_type", "uid", F.col("j2").alias("pos"), "new_word", F.col("det_idx").alias("prio"))


def edit_log(dec: DataFrame, noun_types: DataFrame, remove_conflicts: bool, pass_no: int = 1) -> DataFrame:
    """(model_type, uid, edits, dropped): a row per touched sentence and variant."""
    changed = F.col("final_type") != F.col("det_type")
    if remove_conflicts:    # one edit per position: the determiners themselves
        log = dec.groupBy("model_type", "uid").agg(
            F.map_from_entries(F.collect_list(F.when(changed, F.struct(
                F.col("det_idx").alias("pos"), _type_word(F.col("final_type")).alias("new_word"))))).alias("edits"),
            F.max("conflict").alias("dropped"))
        return log.where("dropped OR size(edits) > 0")
    edits = dec.where(changed).select(
        "model_type", "uid", F.col("det_idx").alias("pos"), _type_word(F.col("final_type")).alias("new_word"),
        F.col("det_idx").alias("prio"))
    edits = edits.unionByName(swap_edits(dec, noun_types, pass_no)).repartition("uid")
    edits = edits.groupBy("model_type", "uid", "pos").agg(F.max_by("new_word", "prio").alias("new_word"))
    return edits.groupBy("model_type", "uid").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "new_word"))).alias("edits"), F.lit(False).alias("dropped"))


def rewrite(df: DataFrame, noun_types: DataFrame, remove_conflicts: bool, pass_no: int = 1,
            variants=REWRITE_VARIANTS) -> tuple[DataFrame, DataFrame]:
    """R1 (adapt) / R2 (remove) one pass over sentences that are the same in every
    variant.  Returns (rewritten rows with ``model_type`` and new ``utt``, empties
    dropped (P10); decisions)."""
    nt = noun_types.where(F.col("model_type").isin([m for m, _ in variants]))
    dec = decisions(df, nt, variants)
    out = EL.texts(df, edit_log(dec, nt, remove_conflicts, pass_no), [m for m, _ in variants])
    return out.where(F.trim("utt") != ""), dec


def merged_logs(first: DataFrame, then: DataFrame) -> DataFrame:
    """One log for two passes: later edits of a position win."""
    return first.unionByName(then.select(first.columns)).groupBy("model_type", "uid").agg(
        F.collect_list(F.struct("pass_no", "edits", "dropped")).alias("p")).select(
        "model_type", "uid",
        F.aggregate(F.sort_array(F.transform("p", lambda x: F.struct(x["pass_no"].alias("k"), F.map_entries(x["edits"]).alias("e")))),
                    F.map_from_entries(F.array().cast("array<struct<key:int,value:string>>")),
                    lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: ~F.exists(x["e"], lambda e: e["key"] == k)),
                                              F.map_from_entries(x["e"]))).alias("edits"),
        F.exists("p", lambda x: x["dropped"]).alias("dropped"))


def retag(df: DataFrame) -> DataFrame:
    """Tag the text from scratch (for inputs that carry only ``utt``)."""
    return df.withColumn("tagged", tag_tokens(T.tokens("utt")))


def iterated_log(df: DataFrame, noun_types: DataFrame, remove_conflicts: bool, num_passes: int = 2,
                 variants=REWRITE_VARIANTS, cut=lambda log, name: log) -> DataFrame:
    """Unrolled passes; one pass in remove mode.  A later pass reads the
    sentences with the log so far applied and adds to the log; ``cut`` writes the
    log of a pass, which is all that is kept between passes."""
    nt = noun_types.where(F.col("model_type").isin([m for m, _ in variants]))
    log = edit_log(decisions(df, nt, variants), nt, remove_conflicts)
    for p in range(2, 1 + (1 if remove_conflicts else num_passes)):
        log = cut(log, f"edits_pass{p - 1}")
        now = EL.texts(df, log, [m for m, _ in variants])
        more = edit_log(decisions(now, nt, variants), nt, remove_conflicts, p)
        log = merged_logs(log.withColumn("pass_no", F.lit(p - 1)), more.withColumn("pass_no", F.lit(p)))
    return log


def rewrite_iterate(df: DataFrame, noun_types: DataFrame, remove_conflicts: bool, num_passes: int = 2,
                    variants=REWRITE_VARIANTS, cut=lambda log, name: log) -> DataFrame:
    """The text that ``iterated_log`` leads to."""
    out = EL.texts(df, iterated_log(df, noun_types, remove_conflicts, num_passes, variants, cut), [m for m, _ in variants])
    return out.where(F.trim("utt") != "")


def conflict_counts(dec: DataFrame) -> DataFrame:
    """A10: conflicts per variant: all windows (adapt mode) and sentences (remove mode)."""
    return dec.where("conflict").groupBy("model_type").agg(
        F.count(F.lit(1)).alias("conflicts_adapt"), F.countDistinct("uid").alias("conflicts_remove"))
