"""Import cleaning and utterance normalisation (P1-P10, T1-T7) as narrow projections.

The steps are per-row Column expressions, so one stage reads the corpus and the
whole chain is one projection; only the drawn names (T5, T6) are a join, and only
the places that need one go to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detflow.functions import text as T
from detflow.functions.draws import h

# Suffix rules of the stand-in lemmatiser, tried in order on
# lowercase alphabetic tokens longer than three letters.
LEMMA_SUFFIXES = [("sses", "ss"), ("ies", "y"), ("s", "")]
LEMMA_KEEP_BEFORE_S = ("s", "u", "i")   # "glass", "bus", "axis" keep their s


def wide_corpus(rc: DataFrame) -> DataFrame:
    """S1 stand-in: the wide two-speaker layout (subject, age_months, p_utts, c_utts)."""
    return rc.where(F.col("role").isin("assistant", "user")).select(
        "uid", "subject", "age_months",
        F.when(F.col("role") == "assistant", F.col("utt")).alias("p_utts"),
        F.when(F.col("role") == "user", F.col("utt")).alias("c_utts"))


def drop_null_utts(wide: DataFrame, utt_col: str) -> DataFrame:
    """P1."""
    return wide.dropna(subset=[utt_col, "age_months"])


def drop_only_mask(df: DataFrame, utt_col: str = "utt") -> DataFrame:
    """P2."""
    return df.where(~T.is_only_mask(utt_col))


def split_speakers(wide: DataFrame) -> DataFrame:
    """Unpivot the two speaker columns into (speaker, utt)."""
    long = wide.unpivot(["uid", "subject", "age_months"], ["p_utts", "c_utts"], "speaker", "utt")
    return long.where(F.col("utt").isNotNull()).withColumn(
        "speaker", F.when(F.col("speaker") == "p_utts", "parent").otherwise("child"))


def import_clean(wide: DataFrame) -> DataFrame:
    """P3 -> P1 -> P2 -> P4 -> P5 -> P6 for both speakers in one pass
    (the unpivot is a single Expand over the scan, not two scans + union)."""
    long = split_speakers(wide).where(F.col("age_months").isNotNull())
    long = drop_only_mask(long, "utt")
    return long.select("uid", "subject", "age_months", "speaker", T.import_clean("utt").alias("utt"))


def lemma(w):
    """T2 (stand-in): rule lemma of one token; non-alphabetic, short and
    capitalised tokens stay.  The rules see lowercase words only, so nothing is
    lowered, and a token that stays is tested once; every rule needs an s at the end."""
    out = F.when(~w.endswith("s") | ~w.rlike("^[a-z]{4,}$"), w)
    for suf, rep in LEMMA_SUFFIXES:
        cond = w.endswith(suf)
        if suf == "s":
            for keep in LEMMA_KEEP_BEFORE_S:
                cond = cond & ~w.endswith(keep + "s")
        out = out.when(cond, F.concat(F.substring(w, F.lit(1), F.length(w) - len(suf)), F.lit(rep)))
    return out.otherwise(w)


def lemmatize(tokens_col):
    return F.transform(F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col, lemma)


def _drawn_names(places: DataFrame, names: DataFrame, n_names: int, tag: str) -> DataFrame:
    """(uid, reps): the names drawn for the places (uid, k) of a sentence, in order.
    The join is left to Spark: names are as many as the names table has."""
    draws = places.withColumn("idx", (h("uid", "k", F.lit(tag)) if tag == "name" else h("uid", F.lit(tag), "k")) % F.lit(n_names))
    return draws.join(names.select("idx", "name"), "idx").groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("k", "name"))).alias("_r"))


def _interleave(parts, reps):
    """Text parts with the replacements between them."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(reps, i)["name"], F.lit("")))), "")


def _replace_runs(df: DataFrame, text_col: str, pattern: str, names: DataFrame, n_names: int, tag: str,
                  may: Column | None = None) -> DataFrame:
    """Every match of ``pattern`` becomes a drawn name, by a join on the drawn index.
    Null texts stay.  ``may``: a cheap test that every text with a match passes; the
    other sentences then pass as they are and are not shuffled."""
    may = None if may is None else F.coalesce(may, F.lit(False))
    some = df if may is None else df.where(may)
    hits = some.where(F.col(text_col).rlike(pattern)).select(
        "uid", F.explode(F.sequence(F.lit(0), F.size(F.split(F.col(text_col), pattern, -1)) - 2)).alias("k"))
    reps = _drawn_names(hits, names, n_names, tag)
    out = some.join(reps, "uid", "left")
    text = F.when(F.col("_r").isNull(), F.col(text_col)).otherwise(_interleave(F.split(F.col(text_col), pattern, -1), F.col("_r")))
    out = out.withColumn(text_col, text).select(df.columns)
    return out if may is None else out.unionByName(df.where(~may))


MASK_WORD = rf"(?<!{T.WORD_CHAR})MASK(?!{T.WORD_CHAR})"


def replace_mask_names(df: DataFrame, text_col: str, names: DataFrame, n_names: int, may: Column | None = None) -> DataFrame:
    """T5: the k-th whole word MASK of a sentence becomes the name of its own draw."""
    return _replace_runs(df, text_col, MASK_WORD, names, n_names, "name", may)


def replace_at_names(df: DataFrame, text_col: str, names: DataFrame, n_names: int) -> DataFrame:
    """Every ``\\b\\w*@\\w*\\b`` run is replaced by a drawn name (the k-th
    occurrence of a sentence uses draw ``h(uid, 'at', k)``)."""
    return _replace_runs(df, text_col, rf"{T.WORD_CHAR}*@{T.WORD_CHAR}*", names, n_names, "at")


def normalize_utts(cleaned: DataFrame, names: DataFrame, n_names: int, cut=lambda df, name: df) -> DataFrame:
    """Tokens (markers kept) -> lemma -> [xN] expansion -> '+' removal and
    join -> MASK names.  Returns (uid, subject, age_months, speaker, utt).
    ``cut`` writes the text before the names are drawn, which the draw reads."""
    t = cleaned.withColumn("_tok", T.tokens_with_markers("utt")).withColumn("_may", F.replace(F.col("utt"), F.lit("+"), F.lit("")).contains("MASK"))
    t = t.withColumn("_tok", T.expand_repeats(lemmatize("_tok")))
    t = cut(t.withColumn("utt", T.strip_plus_join("_tok")).drop("_tok"), "lemmas")
    return replace_mask_names(t, "utt", names, n_names, F.col("_may")).drop("_may")


def drop_empty(df: DataFrame, text_col: str = "utt") -> DataFrame:
    """P10."""
    return df.where(F.trim(F.col(text_col)) != "")
