"""Word vocabulary, id encoding and MLM masking (A20, W7, T14, T15), and the
count model's training-loss curve (A22, W8, W9).

The vocabulary is capped (30,000 words + 7 specials), so after the bounded
top-k it is shipped to the tasks, and encoding is a narrow Arrow-batched
lookup with no shuffle of the token stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detflow.functions import text as T
from detflow.functions.draws import h
from detflow.operators.editlog import EVERY, count_by
from detflow.sources.tables import BAND_LIMITS

# Special tokens in id order, vocabulary cap, minimum frequency,
# sequence length, masking shares and training schedule of the reference.
SPECIALS = ["<s>", "[UNK]", "[PAD]", "[CLS]", "</s>", "[MASK]", "[SEP]"]
VOCAB_CAP = 30_000
MIN_FREQ = 2
MAX_LEN = 64
MLM_SHARE_PER_MILLE = 150          # 15 % of real tokens become targets
MLM_MASK, MLM_RANDOM = 8, 1        # of 10: 8 -> [MASK], 1 -> random id, 1 -> kept
EPOCHS, BATCH = 3, 64
UNK, PAD, CLS_ID, MASK_ID, SEP_ID = 1, 2, 3, 5, 6


def word_counts(texts: DataFrame) -> DataFrame:
    toks = texts.select(F.explode(F.transform(T.tokens("utt"), lambda w: F.lower(w))).alias("word"))
    return toks.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocab_rank(counts: DataFrame, cap: int = VOCAB_CAP, min_freq: int = MIN_FREQ) -> DataFrame:
    """The ``cap`` most frequent words (n desc, word asc) with rank 1..k.
    The sort+limit is a bounded top-k (per-partition top-k, then a merge)."""
    top = counts.where(F.col("n") >= min_freq).orderBy(F.desc("n"), F.asc("word")).limit(cap)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("word"))))


def build_vocab(counts: DataFrame) -> DataFrame:
    """(id, word, n): specials first (n = 0), then ranked words."""
    spark = counts.sparkSession
    spec = spark.createDataFrame([(i, w, 0) for i, w in enumerate(SPECIALS)], "id int, word string, n long")
    words = vocab_rank(counts).select((F.col("rank") + len(SPECIALS) - 1).cast("int").alias("id"), "word", "n")
    return spec.unionByName(words)


def vocab_words(vocab: DataFrame) -> list[str]:
    """The (capped, hence bounded) vocabulary as a list indexed by id."""
    rows = vocab.orderBy("id").select("word").collect()
    return [r["word"] for r in rows]


def _lookup_ids(words: list[str]):
    """Arrow batch function: lowercase token lists -> id lists (hash lookups in
    C++ via ``pyarrow.compute.index_in``; unknown -> [UNK])."""
    def fn(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        value_set = pa.array(words, pa.string())
        for b in batches:
            toks = b.column("_toks")
            if isinstance(toks, pa.ChunkedArray):
                toks = toks.combine_chunks()
            flat = pc.list_flatten(toks)
            ids = pc.fill_null(pc.index_in(flat, value_set=value_set), UNK).cast(pa.int32())
            offsets = pc.subtract(toks.offsets, toks.offsets[0])
            lists = pa.ListArray.from_arrays(offsets, ids)
            yield pa.RecordBatch.from_arrays([b.column("uid"), lists], ["uid", "_ids"])
    return fn


def encode_ids(texts: DataFrame, words: list[str]) -> DataFrame:
    """Ids truncated to MAX_LEN-2, wrapped in [CLS]/[SEP], padded with [PAD];
    ``n_real`` is the attention-mask length.  The id lookup is an Arrow-batched
    ``mapInArrow`` (Spark's map lookup is a linear scan per key)."""
    toks = texts.select("uid", F.transform(T.tokens("utt"), lambda w: F.lower(w)).alias("_toks"))
    ids = toks.mapInArrow(_lookup_ids(words), "uid string, _ids array<int>")
    t = ids.select("uid", F.slice("_ids", 1, MAX_LEN - 2).alias("_ids"))
    core = F.concat(F.array(F.lit(CLS_ID)), F.col("_ids"), F.array(F.lit(SEP_ID)))
    return t.select("uid", F.concat(core, F.array_repeat(F.lit(PAD), MAX_LEN - F.size(core))).alias("input_ids"),
                    F.size(core).alias("n_real"))


def mlm_mask(enc: DataFrame, vocab_size: int) -> DataFrame:
    """Deterministic 15 % target choice on real non-special positions;
    of those 80 % -> [MASK], 10 % -> random id, 10 % kept; label -100 elsewhere."""
    real = F.slice("input_ids", F.lit(1), F.col("n_real"))       # what follows is padding

    def draw(x, i):
        inner = (i > 0) & (i < F.col("n_real") - 1)
        return F.struct(x.alias("id"), (inner & (h("uid", i, F.lit("mlm")) % 1000 < MLM_SHARE_PER_MILLE)).alias("chosen"))

    def pick(x, i):
        r = h("uid", i, F.lit("mlm2")) % 10
        new = (F.when(r < MLM_MASK, F.lit(MASK_ID))
               .when(r < MLM_MASK + MLM_RANDOM, (h("uid", i, F.lit("rnd")) % vocab_size).cast("int"))
               .otherwise(x["id"]))
        return F.struct(F.when(x["chosen"], new).otherwise(x["id"]).alias("id"),
                        F.when(x["chosen"], x["id"]).otherwise(F.lit(-100)).alias("label"))

    padded = lambda field, pad: F.concat(F.col(f"_m.{field}"), F.array_repeat(F.lit(pad), F.size("input_ids") - F.col("n_real")))
    m = enc.select("uid", "input_ids", "n_real", F.transform(F.transform(real, draw), pick).alias("_m"))
    return m.select("uid", padded("id", PAD).alias("masked_ids"), padded("label", -100).alias("labels"))


def band_word_counts(tri: DataFrame) -> DataFrame:
    """(model_type, band_hi, word, n) of signed training triples."""
    return count_by(tri, ["band_hi", "word"])


def cumulative_counts(words: DataFrame) -> DataFrame:
    """Per (model_type, band_hi) the tokens and distinct words seen in bands
    <= band (the warm start accumulates knowledge band after band), from
    ``band_word_counts``."""
    per = words.groupBy("model_type", "band_hi").agg(F.sum("n").alias("n_tokens"))
    first = words.groupBy("model_type", "word").agg(F.min("band_hi").alias("band_hi"))
    new = first.groupBy("model_type", "band_hi").agg(F.count(F.lit(1)).alias("n_new"))
    w = Window.partitionBy("model_type").orderBy("band_hi").rowsBetween(Window.unboundedPreceding, 0)
    j = per.join(new, ["model_type", "band_hi"], "left").fillna(0, subset=["n_new"])
    return j.select("model_type", "band_hi", F.sum("n_tokens").over(w).alias("n_tokens_cum"),
                    F.sum("n_new").over(w).alias("vocab_cum"))


LEVELS = (["prev", "next"], ["next"], ["prev"], [])       # contexts of the backoff levels, as in prediction


def _n(variants: list[int]) -> list[str]:
    return [f"n_{m}" for m in variants]


def triple_counts(tri: DataFrame, variants: list[int] = EVERY) -> DataFrame:
    """(band_hi, prev, next, word, n_0 .. n_100): a row per distinct triple of a band,
    with its count in every variant, from signed triples (the base counts in all), packed or
    not.  They are dealt by (prev, next), for the windows of ``own_shares``."""
    def mine(m):
        if "of" in tri.columns:
            return F.col("of").isNull() | (F.col("of").bitwiseAND(F.lit(1 << EVERY.index(m))) > 0)
        return F.col("model_type").isNull() | (F.col("model_type") == m)

    return tri.repartition("prev", "next").groupBy("band_hi", "prev", "next", "word").agg(
        *[F.sum(F.when(mine(m), F.col("sign")).otherwise(0)).alias(c) for m, c in zip(variants, _n(variants))])


def _p(level: int, variants: list[int]) -> list[str]:
    return [f"p{level}_{m}" for m in variants]


def _share(a, b, out: str):
    return F.when(b > 0, a / b).alias(out)


def own_shares(counts: DataFrame, variants: list[int] = EVERY) -> DataFrame:
    """``counts`` with p1_0 .. p1_100, the word's share in its own context (prev, next) over the
    bands <= band.  Both counts run within the context, so no triple is shuffled again."""
    word = Window.partitionBy("prev", "next", "word").orderBy("band_hi").rowsBetween(Window.unboundedPreceding, 0)
    context = Window.partitionBy("prev", "next").orderBy("band_hi").rangeBetween(Window.unboundedPreceding, 0)
    p = counts.select("*", *[F.sum(c).over(word).alias(f"a{c}") for c in _n(variants)])
    p = p.select("*", *[F.sum(c).over(context).alias(f"b{c}") for c in _n(variants)])
    return p.select(*counts.columns, *[_share(F.col(f"a{c}"), F.col(f"b{c}"), out) for c, out in zip(_n(variants), _p(1, variants))])


def _running(per: DataFrame, by: list[str], out: str, variants: list[int]) -> DataFrame:
    """(band_hi, *by, out..): cumulative counts of ``by`` at every band in which it occurs."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("band_hi").rowsBetween(Window.unboundedPreceding, 0)
    per = per.groupBy("band_hi", *by).agg(*[F.sum(c).alias(c) for c in _n(variants)])
    return per.select("band_hi", *by, *[F.sum(c).over(w).alias(out + c) for c in _n(variants)])      # <= 12 rows a partition


def level_share(counts: DataFrame, level: int, variants: list[int] = EVERY, write=lambda df, name, **kw: df) -> DataFrame:
    """(band_hi, *context, word, p<level>_0 ..): the word's share in the contexts of a level of one
    word, over the bands <= band; a row a pair of neighbours, fewer than the triples.  The third
    level's rows have the last one's as well, which are a row a word.  ``write``: after each shuffle."""
    ctx, names = LEVELS[level - 1], _n(variants)
    pairs = counts.select("band_hi", *ctx, "word", *names).repartition(*ctx, "word").groupBy("band_hi", *ctx, "word").agg(
        *[F.sum(c).alias(c) for c in names])
    until = Window.partitionBy(*ctx, "word").orderBy("band_hi").rowsBetween(Window.unboundedPreceding, 0)
    pairs = write(pairs.select("*", *[F.sum(c).over(until).alias(f"a{c}") for c in names]), "pairs", replace=True)

    def shared(words: DataFrame, contexts: DataFrame, at: int, keys: list[str]) -> DataFrame:
        return words.join(contexts, ["band_hi", *keys]).select("band_hi", *keys, "word", *[
            _share(F.col(f"a{c}"), F.col(f"b{c}"), out) for c, out in zip(names, _p(at, variants))])

    p = shared(pairs.drop(*names), _running(pairs, ctx, "b", variants), level, ctx)
    if level == len(LEVELS) - 1:
        words = shared(_running(pairs, ["word"], "a", variants), _running(pairs, [], "b", variants), level + 1, [])
        p = write(p, "pair_shares").join(write(words, "word_shares"), ["band_hi", "word"])
    return p


def with_shares(own: DataFrame, shares: list[DataFrame], variants: list[int] = EVERY) -> DataFrame:
    """(band_hi, n_0 .., p1_0 .. p4_100): the rows of ``own_shares`` with those of ``level_share`` for
    levels 2 and 3.  The variants are columns, so a triple meets its contexts once for all of them."""
    p = own
    for ctx, share in zip(LEVELS[1:], shares):
        p = p.join(share.hint("shuffle_hash"), ["band_hi", *ctx, "word"])
    return p.select("band_hi", *_n(variants), *[c for i in range(1, len(LEVELS) + 1) for c in _p(i, variants)])


def level_shares(counts: DataFrame, variants: list[int] = EVERY) -> DataFrame:
    """(band_hi, n_0 .., p1_0 .. p4_100) per row of ``triple_counts``."""
    return with_shares(own_shares(counts, variants), [level_share(counts, i, variants) for i in (2, 3)], variants)


# The triples of a few bands at a time meet their shares and are fitted, and make room for the next.
PARTS = 6


def part_of(band: Column) -> Column:
    """0 .. PARTS - 1, as many bands each."""
    lasts = [BAND_LIMITS[(i + 1) * len(BAND_LIMITS) // PARTS - 1] for i in range(PARTS - 1)]
    return sum(((band > last).cast("int") for last in lasts), F.lit(0))


def fitted_losses(tri: DataFrame, write, variants: list[int] = EVERY, epochs: int = EPOCHS) -> DataFrame:
    """``em_losses`` of the signed triples of all bands.  ``write``: of stages.  The weights of a band
    need the triples of that band only, with counts up to it; so the wide rows lie on disk for
    ``PARTS``-th of the bands at once."""
    part = part_of(F.col("band_hi")).alias("part")
    own = write(own_shares(triple_counts(tri, variants), variants).select("*", part), "own_shares", ("part",))
    shares = [write(level_share(own, i, variants, write).select("*", part), f"level_{i}_shares", ("part",)) for i in (2, 3)]
    out = None
    for i in range(PARTS):
        mine = lambda t: t.where(F.col("part") == i).drop("part")  # noqa: B023, E731
        p = write(with_shares(mine(own), [mine(s) for s in shares], variants), "part_shares", replace=True)
        losses = em_losses(by_variant(p, variants), epochs)
        out = losses if out is None else out.unionByName(losses)
    return out


def by_variant(shares: DataFrame, variants: list[int] = EVERY) -> DataFrame:
    """(model_type, band_hi, n, p1 .. p4): the rows of ``level_shares`` per variant that has them."""
    each = F.array(*[F.struct(F.lit(m).alias("model_type"), F.col(f"n_{m}").alias("n"), *[
        F.col(f"p{i}_{m}").alias(f"p{i}") for i in range(1, len(LEVELS) + 1)]) for m in variants])
    rows = shares.select("band_hi", F.explode(each).alias("x")).where("x.n > 0")
    return rows.select("x.model_type", "band_hi", "x.n", *[f"x.p{i}" for i in range(1, len(LEVELS) + 1)])


def level_probabilities(counts: DataFrame, variants: list[int] = EVERY) -> DataFrame:
    """(model_type, band_hi, n, p1 .. p4) per distinct triple of a band: the share of
    its word in each level's context, over the bands <= band.  ``counts``:
    (model_type, band_hi, prev, next, word, n)."""
    wide = counts.groupBy("band_hi", "prev", "next", "word").agg(
        *[F.sum(F.when(F.col("model_type") == m, F.col("n")).otherwise(0)).alias(c) for m, c in zip(variants, _n(variants))])
    return by_variant(level_shares(wide, variants), variants)


def em_losses(probabilities: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(model_type, band_hi, epoch, loss, l1 .. l4): the interpolation weights of the
    backoff levels, equal at first, fitted by expectation maximisation.  An epoch
    is one pass over the band's triples: its loss, the mean -ln of the mixture
    under the weights it began with, and the weights it ends with, which the next one
    is given as values, a row per (variant, band): 60 at most."""
    names = [f"l{i}" for i in range(1, len(LEVELS) + 1)]
    spark, rows, weights = probabilities.sparkSession, [], None
    for epoch in range(1, epochs + 1):
        if weights is None:
            each = probabilities.select("*", *[F.lit(1.0 / len(names)).alias(x) for x in names])
        else:
            each = probabilities.join(F.broadcast(weights), ["model_type", "band_hi"])
        parts = [F.col(x) * F.col(f"p{i}") for i, x in enumerate(names, 1)]
        each = each.withColumn("mix", sum(parts[1:], parts[0]))
        step = each.groupBy("model_type", "band_hi").agg(
            (F.sum(-F.col("n") * F.log("mix")) / F.sum("n")).alias("loss"),
            *[(F.sum(F.col("n") * part / F.col("mix")) / F.sum("n")).alias(x) for x, part in zip(names, parts)])
        now = step.select("model_type", "band_hi", F.lit(epoch).alias("epoch"), "loss", *names)
        found = now.collect()
        rows += found
        weights = spark.createDataFrame(found, now.schema).select("model_type", "band_hi", *names)
    return spark.createDataFrame(rows, now.schema)


def step_offsets(bands: DataFrame) -> DataFrame:
    """W8 over sentences (model_type, band_hi, ...)."""
    return step_offsets_of(bands.groupBy("model_type", "band_hi").agg(F.count(F.lit(1)).alias("rows")))


def step_offsets_of(rows: DataFrame) -> DataFrame:
    """Batches per epoch ceil(rows/64), 3 epochs; the global step of band i
    is its local step plus the sum over earlier bands of (last step + 1)."""
    rows = rows.withColumn("last_step", F.ceil(F.col("rows") / BATCH) * EPOCHS)
    w = Window.partitionBy("model_type").orderBy("band_hi").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.col("last_step") + 1).over(w), F.lit(0)).cast("bigint"))


def loss_curve(offsets: DataFrame, losses: DataFrame) -> DataFrame:
    """(model_type, band_hi, epoch, step, global_step, loss): one logged
    point per epoch, as with per-epoch logging, each with its own loss."""
    pts = offsets.select("model_type", "band_hi", "rows", "offset").join(losses, ["model_type", "band_hi"])
    pts = pts.withColumn("step", (F.ceil(F.col("rows") / BATCH) * F.col("epoch")).cast("bigint"))
    pts = pts.withColumn("global_step", F.col("step") + F.col("offset"))
    return pts.select("model_type", "band_hi", "epoch", "step", "global_step", "loss")
