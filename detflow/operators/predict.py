"""Masked-determiner prediction as count jobs.

The reference trains a masked language model per (variant, band), warm-started
from the previous band, and asks it for the token at ``[MASK]``.  Here the
"model" of (variant, band L) is the table of neighbour counts over the
training bands <= L (cumulative, like the warm start): the prediction is the
most frequent middle word for the (prev, next) context, backing off to next-only,
prev-only and unigram counts (ties: word ascending).

Only contexts that occur in the queries are counted: up to BROADCAST_MAX_ROWS of
them go to the training triples before aggregating; of more, the counts are
joined.  The large aggregation is keyed by (context, word, variant) with a column a
band and partial aggregation, so frequent contexts do not concentrate in one task;
the variants' words that equal the base's are never repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detflow.operators.editlog import CLS, EVERY, HASHED, SEP, unpacked
from detflow.operators.joins import BROADCAST_MAX_ROWS, join_checked
from detflow.sources.stages import Stages
from detflow.sources.tables import BAND_LIMITS


def mask_context(tagged: Column, det_idx: Column) -> tuple[Column, Column]:
    """(prev, next) lowercase neighbours of the masked position."""
    prev = F.when(det_idx > 0, F.lower(F.get(tagged, (det_idx - 1).cast("int"))["word"])).otherwise(F.lit(CLS))
    nxt = F.coalesce(F.lower(F.get(tagged, (det_idx + 1).cast("int"))["word"]), F.lit(SEP))
    return prev, nxt


NONE = "\u0000"   # join-key stand-in for "this level ignores that neighbour"
KEYS = ["level", "kp", "kn"]
BAND_COUNTS = [f"n{b}" for b in BAND_LIMITS]
ANY = -1              # stands for every variant that does not change a word
MOST_ROWS = 200_000   # rows of largest counts, a dozen numbers each, that go to every task


def _keys(level: F.Column, prev: F.Column, nxt: F.Column) -> list[F.Column]:
    kp = F.when(level.isin(1, 3), prev).otherwise(F.lit(NONE))
    kn = F.when(level.isin(1, 2), nxt).otherwise(F.lit(NONE))
    return [kp.alias("kp"), kn.alias("kn")]


def _by_band(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n14 .. n58): sums of signs, a column a band, so that a word of a context
    is one row whatever bands it is in."""
    return rows.groupBy(*by).agg(
        *[F.sum(F.when(F.col("band_hi") == b, F.col("sign")).otherwise(0)).alias(c) for b, c in zip(BAND_LIMITS, BAND_COUNTS)])


def _counted(tri: DataFrame, by: list[str], counted) -> DataFrame:
    """(*by, counts): ``counts`` is an array of (model_type, n), n an array of a number a band:
    that of the base with a null model_type, and those of the variants that change the row.

    ``counted(triples, keys)`` has a row per ``keys`` with a column a band.  The base, of which
    a row is one row, is shuffled once, as counts; the much fewer rows that a variant changes
    are the hashed side of the join to it."""
    n = F.array(*BAND_COUNTS).alias("n")
    which = "of" if "of" in tri.columns else "model_type"
    base = counted(tri.where(f"{which} IS NULL"), by).select(*by, F.array(F.struct(F.lit(None).cast("int").alias("model_type"), n)).alias("_base"))
    own = counted(tri.where(f"{which} IS NOT NULL"), [*by, "model_type"]).select(*by, F.struct("model_type", n).alias("c"))
    own = own.groupBy(*by).agg(F.collect_list("c").alias("_own"))
    counts = F.when(F.col("_own").isNull(), F.col("_base")).when(F.col("_base").isNull(), F.col("_own")).otherwise(F.concat("_base", "_own"))
    return base.join(own.hint(HASHED), by, "full").select(*by, counts.alias("counts"))


def _level(number: int, prev, nxt) -> F.Column:
    return F.struct(F.lit(number).alias("level"), prev.alias("kp"), nxt.alias("kn"))


def _looked_up(tri: DataFrame, pairs: DataFrame, few: bool, by: list[str]) -> DataFrame:
    """``_by_band`` of the triples at every level at which some query looks them up; ``few``:
    its contexts ``pairs`` go to every task."""
    none, prev, nxt = F.lit(NONE), F.col("prev"), F.col("next")
    if few:      # the bound holds for the single neighbours too
        t = tri.join(F.broadcast(pairs.select("prev").distinct().withColumn("_kp", F.lit(True))), "prev", "left")
        t = t.join(F.broadcast(pairs.select("next").distinct().withColumn("_kn", F.lit(True))), "next", "left")
        t = t.join(F.broadcast(pairs.withColumn("_kpn", F.lit(True))), ["prev", "next"], "left")
        at = F.array(F.when(F.col("_kpn"), _level(1, prev, nxt)), F.when(F.col("_kn"), _level(2, none, nxt)),
                     F.when(F.col("_kp"), _level(3, prev, none)), _level(4, none, none))
        rows = t.select("model_type", "band_hi", "word", "sign", F.explode(at).alias("at")).where("at IS NOT NULL")
        return _by_band(rows.select("model_type", "band_hi", "word", "sign", "at.*"), by)
    # more contexts than go to every task: counted first, so that only counts are joined
    out = _by_band(tri.select("model_type", "band_hi", "word", "sign", _level(4, none, none).alias("at")).select("*", "at.*"), by)
    for number, at in ((1, (prev, nxt)), (2, (none, nxt)), (3, (prev, none))):
        n = _by_band(tri.select("model_type", "band_hi", "word", "sign", _level(number, *at).alias("at")).select("*", "at.*"), by)
        wanted = pairs.select(_level(number, *at).alias("at")).select("at.*").distinct()
        out = out.unionByName(n.join(wanted.hint("merge"), KEYS, "left_semi"))
    return out


def context_words(tri: DataFrame, ctx: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(level, kp, kn, word, counts): the words of every context that a query looks up,
    one row each, ``counts`` being an array of (model_type, n), n the signed counts
    per band: those of the base with a null model_type, and those of the variants
    that change this word here.  Levels: 1 (prev, next), 2 (next), 3 (prev), 4 none."""
    pairs = ctx.select("prev", "next").distinct()
    few = pairs.count() <= max_rows
    return _counted(tri, [*KEYS, "word"], lambda t, by: _looked_up(t, pairs, few, by))


def _counts_of(model_type) -> F.Column:
    """The counts per band that ``counts`` has of a variant (None: of the base), else zeros."""
    mine = F.filter("counts", lambda c: c["model_type"].eqNullSafe(model_type))
    return F.coalesce(F.get(mine, 0)["n"], F.array(*[F.lit(0).cast("long") for _ in BAND_LIMITS]))


def _untouched() -> F.Column:
    """No variant changes the word: ``counts`` has the base alone."""
    return (F.size("counts") == 1) & F.get("counts", F.lit(0))["model_type"].isNull()


def _sums(model_type) -> F.Column:
    return F.zip_with(_counts_of(F.lit(None).cast("int")), _counts_of(model_type), lambda x, y: x + y)


def context_counts(tri: DataFrame, ctx: DataFrame, variants: list[int] = EVERY) -> DataFrame:
    """One aggregation of the signed training triples serving all backoff levels.

    A triple is counted at a level only if some query needs its context there; the
    base is counted once, goes to every variant as counts, and keeps of a variant
    what that variant's queries need.
    Columns: (model_type, band_hi, level, prev, next, word, n)."""
    c = context_words(tri, ctx)
    levels = F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)])).alias("level")
    own = ctx.select("model_type", "prev", "next", levels)
    own = own.select("model_type", "level", *_keys(F.col("level"), F.col("prev"), F.col("next"))).distinct()
    every = F.array(*[F.lit(m) for m in variants])
    whole = c.sparkSession.range(1).select(F.explode(every).alias("model_type"), F.lit(4).alias("level"),
                                           F.lit(NONE).alias("kp"), F.lit(NONE).alias("kn"))
    own = own.unionByName(whole)
    own = F.broadcast(own) if own.count() <= BROADCAST_MAX_ROWS else own.hint("merge")
    c = c.withColumn("model_type", F.explode(every)).join(own, ["model_type", *KEYS], "left_semi")
    c = c.select("model_type", *KEYS, "word", F.when(_untouched(), F.get("counts", F.lit(0))["n"]).otherwise(_sums(F.col("model_type"))).alias("n"))
    bands = F.array(*[F.struct(F.lit(b).alias("band_hi"), F.get("n", F.lit(i)).alias("n")) for i, b in enumerate(BAND_LIMITS)])
    c = c.select("model_type", *KEYS, "word", F.explode(bands).alias("b")).where("b.n > 0")
    prev = F.when(F.col("level").isin(1, 3), F.col("kp")).alias("prev")
    return c.select("model_type", "b.band_hi", "level", prev, F.when(F.col("level").isin(1, 2), F.col("kn")).alias("next"), "word", "b.n")


def level_words(tri: DataFrame, asked: DataFrame, number: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """(level, kp, kn, word, counts) like ``context_words``, of one level and of the contexts
    of ``asked`` (age, prev, next) alone; n are the signed counts up to each band (the
    cumulative warm start).  No triple above the oldest age that asks for its context is counted."""
    own = {1: ["kp", "kn"], 2: ["kn"], 3: ["kp"], 4: []}[number]      # the neighbours that the level looks at
    upto = [F.sum(F.when(F.col("band_hi") <= b, F.col("sign")).otherwise(0)).alias(c) for b, c in zip(BAND_LIMITS, BAND_COUNTS)]
    keys = [F.col({"kp": "prev", "kn": "next"}[k]).alias(k) for k in own]
    wanted = asked.select("age", *keys).groupBy(*own).agg(F.max("age").alias("_last")) if own else None
    few = own and wanted.count() <= max_rows

    def counted(triples: DataFrame, by: list[str]) -> DataFrame:
        which = "of" if "of" in triples.columns else "model_type"
        at = triples.select(which, "band_hi", "word", "sign", *keys)
        if few:
            at = at.join(F.broadcast(wanted), own).where("band_hi <= _last")
        if which == "of" and "model_type" in by:    # only of the triples that are looked up
            at = unpacked(at)
        n = at.groupBy(*by).agg(*upto)
        # more contexts than go to every task: counted first, so that only counts are joined
        return n.join(wanted.hint("merge"), own, "left_semi") if own and not few else n

    kp, kn = (F.col(k) if k in own else F.lit(NONE).alias(k) for k in ("kp", "kn"))
    return _counted(tri, [*own, "word"], counted).select(F.lit(number).alias("level"), kp, kn, "word", "counts")


def best_by_level(c: DataFrame, variants: list[int] = EVERY, hold=lambda rows: rows) -> DataFrame:
    """(model_type, age, level, kp, kn, pred_word): the most frequent word (count desc,
    word asc) of every context of ``level_words`` at every age.

    A word that no variant changes in a context is a candidate of all variants at once.
    The largest counts of a context are found first, by hash aggregation, and only words
    that have one of them are compared by name: no words of a context are sorted, and no
    task gets all of them.  ``hold`` keeps the largest counts, which are read twice."""
    every = F.array(*[F.lit(m) for m in variants])
    first = F.get("counts", F.lit(0))
    base = F.array(F.struct(F.lit(ANY).alias("of"), first["n"].alias("n")))
    each = F.array(*[F.struct(F.lit(m).alias("of"), _sums(F.lit(m)).alias("n")) for m in variants])
    rows = c.select(*KEYS, "word", F.explode(F.when(_untouched(), base).otherwise(each)).alias("v")).select(*KEYS, "word", "v.of", "v.n")
    own = [*KEYS, "of"]
    most = rows.groupBy(*own).agg(*[F.max(F.get("n", F.lit(i))).alias(x) for i, x in enumerate(BAND_COUNTS)])
    near = join_checked(rows, hold(most.select(*own, F.array(*BAND_COUNTS).alias("most"))), own, max_rows=MOST_ROWS)
    n, top = ([F.get(c, F.lit(i)) for i in range(len(BAND_LIMITS))] for c in ("n", "most"))
    ages = [F.when((x > 0) & (x == y), F.struct(F.lit(b).alias("age"), x.alias("n"))) for b, x, y in zip(BAND_LIMITS, n, top)]
    near = near.where(F.coalesce(*ages).isNotNull()).select(*own, "word", F.explode(F.array(*ages)).alias("x")).where("x IS NOT NULL")
    # words with one largest count are compared before it goes to every variant
    near = near.groupBy(*own, "x.age", "x.n").agg(F.min("word").alias("word"))
    of = F.when(F.col("of") == ANY, every).otherwise(F.array("of"))
    near = near.select(F.explode(of).alias("model_type"), "age", *KEYS, F.struct((-F.col("n")).alias("nn"), "word").alias("best"))
    return near.groupBy("model_type", "age", *KEYS).agg(F.min("best").alias("best")).select(
        "model_type", "age", *KEYS, F.col("best.word").alias("pred_word"))


def predict(queries: DataFrame, tri: DataFrame, variants: list[int] = EVERY, cut=None) -> DataFrame:
    """R7 + W3: ``queries`` has (model_type, age, prev, next, ...);
    adds ``pred_word`` and ``pred_det`` (a / the / other).  ``tri``: signed training
    triples (``editlog.signed_triples`` or ``packed_triples``); ``age`` is one of the band limits.

    The levels are gone through in the order of the backoff: a level counts the words of the
    contexts that no level before has answered, and when none is left no more is counted.
    ``cut(rows, name)`` writes the rows of a step, so each is made once."""
    cut = cut or Stages(tri.sparkSession, "predict").write
    keys = ["model_type", "age", "prev", "next"]
    asked, picks = cut(queries.select(*keys).distinct(), "contexts"), None
    for number in (1, 2, 3, 4):
        words = cut(level_words(tri, asked, number), f"words_{number}")
        held = []
        best = best_by_level(words, variants, lambda most: held.append(most.persist()) or most).drop("level")
        at = asked.select(*keys, *_keys(F.lit(number), F.col("prev"), F.col("next")))
        answers = cut(at.join(best, ["model_type", "age", "kp", "kn"], "left").select(*keys, "pred_word"), f"answers_{number}")
        for most in held:
            most.unpersist()
        pick = answers.where("pred_word IS NOT NULL")
        picks = pick if picks is None else picks.unionByName(pick)
        asked = answers.where("pred_word IS NULL").select(*keys)
        if asked.isEmpty():
            break
    out = queries.join(picks, keys, "left")
    return out.withColumn("pred_det", F.when(F.col("pred_word").isin("a", "the"), F.col("pred_word"))
                          .otherwise(F.lit("other")))
