"""What lies on disk while a step runs, and what is left after it (findings of round 4)."""

from pyspark.sql import functions as F

from detflow.operators import editlog as EL
from detflow.operators import vocab as V
from detflow.sources.stages import CLEANUP, Stages
from test_growth import base_and_log, plan_of


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}


def test_what_a_stage_shuffled_goes_when_it_is_written(spark):
    """the shuffles of all stages of a run lay on disk together."""
    before, usual = shuffle_files(spark), spark.conf.get(CLEANUP, "false")
    stages = Stages(spark, "cleaned")
    rows = spark.range(0, 5000, 1, 4).select((F.col("id") % 7).alias("k"), "id")
    out = stages.write(rows.groupBy("k").agg(F.sum("id").alias("s")).join(rows.hint("merge"), "k"), "s", (), "k")
    assert not shuffle_files(spark) - before and spark.conf.get(CLEANUP, "false") == usual
    assert out.count() == 5000 and sorted(r["rows"] for r in stages.manifest().collect()) == [5000]
    again = stages.write(rows.where("k = 1"), "t", replace=True).count(), stages.write(rows.where("k < 2"), "t", replace=True).count()
    assert again == (rows.where("k = 1").count(), rows.where("k < 2").count())


def test_losses_fitted_by_parts_of_the_bands_are_those_of_all_at_once(spark):
    """the triples were shuffled to each level's counts of triples and back, all bands at once."""
    base, log = base_and_log(spark)
    stages, names = Stages(spark, "losses"), []

    def write(df, name, *a, **kw):
        names.append(name)
        return stages.write(df, name, *a, **kw)
    got = {(r["model_type"], r["band_hi"], r["epoch"]): r["loss"] for r in V.fitted_losses(EL.packed_triples(base, EL.packed_changes(base, log)), write).collect()}
    counts = EL.count_by(EL.signed_triples(base, log), ["band_hi", "prev", "next", "word"])
    want = {(r["model_type"], r["band_hi"], r["epoch"]): r["loss"] for r in V.em_losses(V.level_probabilities(counts)).collect()}
    assert got.keys() == want.keys() and len(got) == (5 * 2 + 4) * V.EPOCHS      # all of band 42 is dropped in one variant
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and names.count("part_shares") == V.PARTS
    own = plan_of(V.own_shares(V.triple_counts(EL.signed_triples(base, log))))
    assert own.count("hashpartitioning(prev") == 1


def test_parts_hold_the_bands_in_order(spark):
    rows = spark.createDataFrame([(b,) for b in V.BAND_LIMITS], "b int").select(V.part_of(F.col("b")).alias("p")).collect()
    assert [r["p"] for r in rows] == sorted(r["p"] for r in rows) and {r["p"] for r in rows} == set(range(V.PARTS))


def test_bands_are_written_compressed_one_variant_after_another(spark):
    """the text of all variants was shuffled at once and lay there as it is."""
    from detflow.operators import bands as B
    from detflow.plans.study import StudyPlan
    from detflow.sources import io as IO
    base, log = base_and_log(spark)
    parent = base.drop("band_hi").withColumns({c: F.lit(0) for c in ("k", "id", "turn", "sent_no")})
    study, before = StudyPlan(spark, "/nowhere"), shuffle_files(spark)
    study.__dict__.update(parent=parent, edits=log)
    rows = B.in_bands(B.training_corpus(parent, log)).select("model_type", "band_hi", "utt")
    back = IO.read_band_text(spark, study.band_files)
    assert not shuffle_files(spark) - before and all(f.endswith(".txt.gz") for f in back.inputFiles())
    want = sorted(map(tuple, rows.collect()))
    assert sorted((r["model_type"], r["band_hi"], r["utt"]) for r in back.collect()) == want and len(want) == 19
    kept = spark.read.parquet(study.write_bands("with_uid", ["uid", "utt"], "parquet", "zstd"))
    assert sorted((r["model_type"], r["band_hi"], r["utt"]) for r in kept.collect()) == want


def test_a_headerless_export_can_be_compressed(spark, tmpdir_path):
    """words and tags as JSON in CSV are several times the corpus."""
    from detflow.sources import io as IO
    df = spark.createDataFrame([("a, \"b\"", [("the", "DET")]), ("é", [])], "utt string, tagged array<struct<word:string,pos:string>>")
    IO.write_headerless(df, f"{tmpdir_path}/out", "gzip")
    back = IO.decode_tagged(IO.read_headerless(spark, f"{tmpdir_path}/out", ["utt", "tagged"]))
    assert all(f.endswith(".csv.gz") for f in back.inputFiles()) and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_masks_are_drawn_once_a_word_and_not_for_padding(spark):
    """a word's draw was made for its id and again for its label, and every pad ran the lambda."""
    rows = [(f"u{k}", [f"w{i}" for i in range(n)]) for k, n in enumerate((0, 1, 7, 62, 70))]
    texts = spark.createDataFrame(rows, "uid string, t array<string>").select("uid", F.array_join("t", " ").alias("utt"))
    enc = V.encode_ids(texts, [*V.SPECIALS, *[f"w{i}" for i in range(40)]])
    got = V.mlm_mask(enc, 47)
    assert plan_of(got).count(", mlm)") == 1
    import hashlib
    h = lambda *p: int(hashlib.md5("-".join(map(str, p)).encode()).hexdigest()[:8], 16)
    labels = {r["uid"]: (r["masked_ids"], r["labels"]) for r in got.collect()}
    for r in enc.collect():
        ids, want = list(r["input_ids"]), [-100] * V.MAX_LEN
        for i in range(1, r["n_real"] - 1):
            if h(r["uid"], i, "mlm") % 1000 < 150:
                want[i], d = ids[i], h(r["uid"], i, "mlm2") % 10
                ids[i] = V.MASK_ID if d < 8 else h(r["uid"], i, "rnd") % 47 if d < 9 else ids[i]
        assert labels[r["uid"]] == (ids, want)
