"""Determiner -> noun pairing (D1-D6): one row per sentence, array HOFs only.

Each preset returns an ARRAY<STRUCT<det_idx, det, noun_idx, noun>> column for a
``tagged`` ARRAY<STRUCT<word,pos>>; ``explode_pairs`` turns it into rows after
the filtering, so the only data growth is the pairs themselves.  Indices are
0-based token positions; det and noun are lowercase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detflow.functions.text import DETERMINERS

PAIR_TYPE = "array<struct<det_idx:int,det:string,noun_idx:int,noun:string>>"


def _t(tagged) -> Column:
    return F.col(tagged) if isinstance(tagged, str) else tagged


def positions(tagged) -> Column:
    t = _t(tagged)
    return F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))


def is_det_word(x: Column) -> Column:
    return F.lower(x["word"]).isin(*DETERMINERS)


def is_det_tagged(x: Column) -> Column:
    return (x["pos"] == "DET") & is_det_word(x)


def _pair(t: Column, i: Column, j: Column) -> Column:
    return F.struct(i.cast("int").alias("det_idx"), F.lower(F.get(t, i)["word"]).alias("det"),
                    j.cast("int").alias("noun_idx"), F.lower(F.get(t, j)["word"]).alias("noun"))


def _compact(arr: Column) -> Column:
    return F.filter(arr, lambda p: p.isNotNull()).cast(PAIR_TYPE)


def pair_first(tagged, det_pred, target_pred, lookahead: int | None = None,
               skip_pred=None) -> Column:
    """For each determiner at i, the first target within the next ``lookahead``
    tokens (to the end when None).  With ``skip_pred``, tokens that are not
    skippable stop the search unless they are the target."""
    t = _t(tagged)

    def at(i):
        win = F.slice(t, i + 2, F.lit(lookahead) if lookahead else F.greatest(F.size(t), F.lit(1)))
        if skip_pred is None:
            off = F.array_position(F.transform(win, target_pred), True)
            ok = off > 0
        else:
            off = F.array_position(F.transform(win, lambda y: ~skip_pred(y)), True)
            ok = (off > 0) & F.coalesce(target_pred(F.get(win, (off - 1).cast("int"))), F.lit(False))
        return F.when(det_pred(F.get(t, i)) & ok, _pair(t, i, i + off))

    return _compact(F.transform(positions(t), at))


def pair_assign(tagged, lookahead: int = 4) -> Column:
    """DET a/the -> first NOUN within ``lookahead``, anything skipped."""
    return pair_first(tagged, is_det_tagged, lambda y: y["pos"] == "NOUN", lookahead)


def pair_checking(tagged, lookahead: int = 4) -> Column:
    """a/the by text -> first NOUN*, skipping ADJ*/VERB*, others stop."""
    return pair_first(tagged, is_det_word, lambda y: y["pos"].startswith("NOUN"), lookahead,
                      skip_pred=lambda y: y["pos"].startswith("ADJ") | y["pos"].startswith("VERB"))


def pair_unbounded(tagged) -> Column:
    """D3: DET a/the -> first NOUN or PROPN up to the end of the sentence."""
    return pair_first(tagged, is_det_tagged, lambda y: y["pos"].isin("NOUN", "PROPN"), None)


def pair_train2(tagged) -> Column:
    """DET a/the -> first NOUN within two tokens (training side of R6)."""
    return pair_first(tagged, is_det_tagged, lambda y: y["pos"] == "NOUN", 2)


def _pos_at(t: Column, j: Column) -> Column:
    return F.get(t, j.cast("int"))["pos"]


def pair_eval(tagged) -> Column:
    """a/the by text; NOUN* at +1, else NOUN* at +2 when +1 is not NOUN."""
    t = _t(tagged)

    def at(i):
        p1, p2 = _pos_at(t, i + 1), _pos_at(t, i + 2)
        c1 = F.coalesce(p1.startswith("NOUN"), F.lit(False))
        c2 = F.coalesce((p1 != "NOUN") & p2.startswith("NOUN"), F.lit(False))
        j = F.when(c1, i + 1).when(c2, i + 2)
        return F.when(is_det_word(F.get(t, i)) & j.isNotNull(), _pair(t, i, j))

    return _compact(F.transform(positions(t), at))


def pair_flex(tagged) -> Column:
    """Any DET; NOUN at +1 and, independently, NOUN at +2 (up to two pairs)."""
    t = _t(tagged)

    def at(i, off):
        return F.when((F.get(t, i)["pos"] == "DET") & F.coalesce(_pos_at(t, i + off) == "NOUN", F.lit(False)),
                      _pair(t, i, i + off))

    return _compact(F.flatten(F.transform(positions(t), lambda i: F.array(at(i, 1), at(i, 2)))))


def determiners(df: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, _t, det_idx, det): a row for each a/the DET of ``tagged``, with the sentence as ``_t``,
    in which what follows is looked up: compiled code, where a lambda a token is interpreted."""
    x = df.select(*keep, F.col("tagged").alias("_t")).select(*keep, "_t", F.posexplode("_t").alias("det_idx", "_d"))
    return x.where(is_det_tagged(F.col("_d"))).select(*keep, "_t", "det_idx", F.lower("_d.word").alias("det"))


def noun_rows(df: DataFrame, keep: list[str], lookahead: int) -> DataFrame:
    """(*keep, det, noun): the pairs of ``pair_assign`` (D1, D4) as rows."""
    off = None
    for k in range(1, lookahead + 1):
        noun = F.get("_t", F.col("det_idx") + k)["pos"] == "NOUN"
        off = F.when(noun, F.lit(k)) if off is None else off.when(noun, F.lit(k))
    x = determiners(df, keep).select(*keep, "_t", "det_idx", "det", off.alias("_off")).where("_off IS NOT NULL")
    return x.select(*keep, "det", F.lower(F.get("_t", F.col("det_idx") + F.col("_off"))["word"]).alias("noun"))


def explode_pairs(df: DataFrame, pairs: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")
