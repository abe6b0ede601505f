"""Rewritten corpora as base sentences plus an edit log, and counting by difference.

The sentences are stored once.  What a rewrite does to them is a row per touched
(variant, sentence): ``edits`` (token position -> new word) and ``dropped``.  A
variant's text is the base with its edits applied; it is made only where text is
asked for.

Counts over a variant are the counts over the base plus a small difference: the
touched places with sign -1 as they were and, unless dropped, with sign +1 as
they are.  Base rows carry a null ``model_type``; ``per_variant`` adds them to
every variant after the aggregation, so no stage holds a copy of the text per
variant and no token is counted five times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detflow.functions.tagger import pos_of
from detflow.sources.tables import UNFILTERED, VARIANTS

# Sentences and log lie in the same uid buckets; a bucket of the log, a row per touched
# sentence and variant, is hashed, and the sentences stream past without a sort.
HASHED = "shuffle_hash"

CLS, SEP = "[CLS]", "[SEP]"
EVERY = [m for m, _ in VARIANTS]


def edited(tagged: Column, edits: Column) -> Column:
    """``tagged`` with the edits applied.  Positions never move and a tag depends
    only on (word, position > 0), so only edited tokens are tagged again."""
    def one(x, i):
        w = F.element_at(edits, i)
        return F.when(w.isNull(), x).otherwise(F.struct(w.alias("word"), pos_of(w, i).alias("pos")))
    return F.when(F.coalesce(F.size(edits), F.lit(0)) > 0, F.transform(tagged, one)).otherwise(tagged)


def texts(base: DataFrame, log: DataFrame, variants: list[int]) -> DataFrame:
    """``base`` rows per variant with edits applied (``utt``, the words joined by one
    blank, and ``tagged``), dropped sentences left out; the unfiltered variant keeps
    its text.  The log is packed per sentence, so one join serves all."""
    if variants == [UNFILTERED] and "utt" in base.columns:       # has no edits
        return base.withColumn("model_type", F.lit(UNFILTERED))
    packed = log.where(F.col("model_type").isin(variants)).groupBy("uid").agg(F.collect_list(F.struct("model_type", "edits", "dropped")).alias("_log"))
    out = base.join(packed.hint(HASHED), "uid", "left").withColumn("model_type", F.explode(F.array(*[F.lit(m) for m in variants])))
    mine = F.filter(F.coalesce(F.col("_log"), F.array()), lambda e: e["model_type"] == F.col("model_type"))
    out = out.withColumn("_mine", F.get(mine, 0)).where("_mine IS NULL OR NOT _mine.dropped")
    out = out.withColumn("tagged", edited(F.col("tagged"), F.col("_mine.edits")))
    words = F.array_join("tagged.word", " ")
    own = F.col("utt") if "utt" in base.columns else words
    return out.withColumn("utt", F.when(F.col("model_type") == UNFILTERED, own).otherwise(words)).drop("_log", "_mine")


def _triples(word_at, at: Column, sign: int) -> Column:
    """Triples at the token positions ``at``; ``word_at(i)`` is null beyond the sentence."""
    return F.transform(at, lambda i: F.struct(
        F.coalesce(word_at(i - 1), F.lit(CLS)).alias("prev"), word_at(i).alias("word"),
        F.coalesce(word_at(i + 1), F.lit(SEP)).alias("next"), F.lit(sign).alias("sign")))


def _zipped(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, prev, word, next): a row a token.  The words are zipped with themselves, one
    off to either side, and lowered as rows, so no token runs a lambda."""
    w = F.col("tagged.word")
    zipped = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), w).alias("prev"), w.alias("word"),
                          F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("next"))
    x = rows.select(*keep, F.explode(zipped).alias("x")).where("x.word IS NOT NULL")     # the row past the last token
    return x.select(*keep, F.coalesce(F.lower("x.prev"), F.lit(CLS)).alias("prev"), F.lower("x.word").alias("word"),
                    F.coalesce(F.lower("x.next"), F.lit(SEP)).alias("next"))


def base_triples(base: DataFrame) -> DataFrame:
    """(model_type null, band_hi, prev, word, next, sign): every token of the base."""
    t = _zipped(base, ["band_hi"])
    return t.select(F.lit(None).cast("int").alias("model_type"), "band_hi", "prev", "word", "next", F.lit(1).alias("sign"))


def _packed() -> Column:
    """Aggregate: the variants of a group as bits, in the order of ``EVERY``."""
    bit = F.when(F.col("model_type") == EVERY[0], 1)
    for i, m in enumerate(EVERY[1:], 1):
        bit = bit.when(F.col("model_type") == m, 1 << i)
    return F.bit_or(bit).alias("of")


def unpacked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``model_type`` for the variants ``of``, a row each."""
    each = F.array(*[F.when(F.col("of").bitwiseAND(F.lit(1 << i)) > 0, F.lit(m)) for i, m in enumerate(EVERY)])
    return rows.select("*", F.explode(each).alias("model_type")).where("model_type IS NOT NULL").drop("of")


def packed_changes(base: DataFrame, log: DataFrame) -> DataFrame:
    """The differences of the log, (of, band_hi, prev, word, next, sign): a row for all variants
    ``of`` that change a sentence alike.  An edit changes the triples of its own and the
    neighbouring tokens only, and no other token is looked at; a dropped sentence loses all of its."""
    b = base.select("uid", "band_hi", "tagged")
    gone = log.where("dropped").groupBy("uid").agg(_packed())
    gone = _zipped(b.join(gone.hint(HASHED), "uid"), ["of", "band_hi"]).withColumn("sign", F.lit(-1))
    alike = log.where("NOT dropped").select("uid", "model_type", F.sort_array(F.map_entries("edits")).alias("_e"))
    alike = alike.groupBy("uid", "_e").agg(_packed())
    t = b.join(alike.hint(HASHED), "uid")
    t = t.select("of", "band_hi", F.size("tagged").alias("_n"), F.map_from_entries("_e").alias("edits"), "tagged.word")
    old = lambda i: F.lower(F.get("word", i))
    new = lambda i: F.coalesce(F.lower(F.element_at("edits", i)), old(i))
    near = F.array_distinct(F.filter(F.flatten(F.transform(F.map_keys("edits"), lambda p: F.array(p - 1, p, p + 1))),
                                     lambda i: (i >= 0) & (i < F.col("_n"))))
    t = t.withColumn("_at", near)
    changed = F.concat(_triples(old, F.col("_at"), -1), _triples(new, F.col("_at"), 1))
    t = t.select("of", "band_hi", F.explode(changed).alias("x")).select("of", "band_hi", "x.*")
    return t.unionByName(gone)


def changed_triples(base: DataFrame, log: DataFrame) -> DataFrame:
    """The differences of the log, columns as ``base_triples``."""
    return unpacked(packed_changes(base, log)).select("model_type", "band_hi", "prev", "word", "next", "sign")


def packed_triples(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Like ``signed_triples``, with the variants ``of`` a row (null: the base), which are
    made rows of after the rows that are looked up have been found."""
    changes = changes.withColumn("of", F.coalesce("of", F.lit(0)))      # never null: not read for the base
    return base_triples(base).withColumn("of", F.lit(None).cast("int")).drop("model_type").unionByName(changes)


def signed_triples(base: DataFrame, log: DataFrame | None) -> DataFrame:
    """(model_type, band_hi, prev, word, next, sign): every token of the base with a
    null model_type, and the differences of the log."""
    one = base_triples(base)
    return one if log is None else one.unionByName(changed_triples(base, log))


def signed_pairs(base: DataFrame, log: DataFrame, pairs) -> DataFrame:
    """(model_type, band_hi, noun, det, sign) of the determiner-noun pairs that
    ``pairs(tagged)`` finds; a touched sentence is looked at as a whole."""
    def both(old: Column, new: Column) -> Column:
        signed = lambda p, s: F.transform(p, lambda x: F.struct(x["noun"].alias("noun"), x["det"].alias("det"), F.lit(s).alias("sign")))
        return F.concat(signed(old, -1), F.when(~F.col("dropped"), signed(new, 1)).otherwise(F.array()))

    one = base.select(F.lit(None).cast("int").alias("model_type"), "band_hi", F.explode(pairs("tagged")).alias("x"))
    one = one.select("model_type", "band_hi", "x.noun", "x.det", F.lit(1).alias("sign"))
    t = base.select("uid", "band_hi", "tagged").join(log.hint(HASHED), "uid")
    t = t.withColumn("_new", edited(F.col("tagged"), F.col("edits")))
    t = t.select("model_type", "band_hi", "dropped", pairs("tagged").alias("_p"), pairs("_new").alias("_q"))
    t = t.select("model_type", "band_hi", F.explode(both(F.col("_p"), F.col("_q"))).alias("x")).select("model_type", "band_hi", "x.*")
    return one.unionByName(t)


def signed_rows(base: DataFrame, log: DataFrame) -> DataFrame:
    """(model_type, band_hi, sign): sentences of the base, and the dropped ones."""
    one = base.select(F.lit(None).cast("int").alias("model_type"), "band_hi", F.lit(1).alias("sign"))
    gone = base.select("uid", "band_hi").join(log.where("dropped").select("uid", "model_type").hint(HASHED), "uid")
    return one.unionByName(gone.select("model_type", "band_hi", F.lit(-1).alias("sign")))


def per_variant(counts: DataFrame, by: list[str], variants: list[int] = EVERY) -> DataFrame:
    """(model_type, *by, n) from sums ``n`` of signs: base plus difference; what a
    variant no longer has is left out."""
    of = F.when(F.col("model_type").isNull(), F.array(*[F.lit(m) for m in variants])).otherwise(F.array("model_type"))
    rows = counts.withColumn("model_type", F.explode(of))
    return rows.groupBy("model_type", *by).agg(F.sum("n").alias("n")).where("n > 0")


def count_by(signed: DataFrame, by: list[str], variants: list[int] = EVERY) -> DataFrame:
    """Signed rows to counts per variant: aggregated before the base goes to every variant."""
    return per_variant(signed.groupBy("model_type", *by).agg(F.sum("sign").alias("n")), by, variants)
