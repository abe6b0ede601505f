"""The study pipeline as one object: each stage is built once per run and the
stages read by several later stages are written as Parquet in the shared folder
of the cluster (``spark.checkpoint.dir``), which cuts lineage and survives
executor loss.

Stages (SURVEY §3):  cleaned, normalised and tagged corpus -> noun types (A1-A3)
-> edit log of the rewrites (R1-R5) -> test sets (R6) -> predictions (R7) ->
results (R8).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detflow.functions import text as T
from detflow.functions.tagger import tag_rows
from detflow.operators import assign as A
from detflow.operators import bands as B
from detflow.operators import clean as C
from detflow.operators import editlog as EL
from detflow.operators import evaluate as E
from detflow.operators import filters as P
from detflow.operators import overall as O
from detflow.operators import predict as PR
from detflow.operators import rewrite as R
from detflow.operators import testsets as TS
from detflow.operators import vocab as V
from detflow.sources import io as IO
from detflow.sources.stages import Stages
from detflow.sources.tables import UNFILTERED, Corpus

STUDY_REMOVE_CONFLICTS = True   # the study removed conflicting sentences (one pass)


_SHARED: dict = {}


def _session_key(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect
        return str(id(spark))


class StudyPlan:
    """Stages of one run.  ``shared`` returns one instance per (session, input,
    flags): its stages are written once and read by every later query of the
    session, like the intermediate tables of a batch pipeline.

    Stages are Parquet (``sources/stages.py``).  Sentences are stored once,
    partitioned by speaker and bucketed by ``uid``; the variants are an edit log
    in the same buckets, so the two join without an exchange."""

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str, **kw) -> "StudyPlan":
        key = (cls.__name__, _session_key(spark), sf_dir, tuple(sorted(kw.items())))
        if key not in _SHARED:
            _SHARED[key] = cls(spark, sf_dir, **kw)
        return _SHARED[key]

    def __init__(self, spark: SparkSession, sf_dir: str, remove_conflicts: bool = STUDY_REMOVE_CONFLICTS,
                 unique_nouns: bool = True, materialize: bool = True):
        self.spark = spark
        self.corpus = Corpus(spark, sf_dir)
        self.remove_conflicts = remove_conflicts
        self.unique_nouns = unique_nouns
        self.materialize = materialize

    @cached_property
    def stages(self) -> Stages:
        return Stages(self.spark, written=self.materialize)

    # ---- stage 1: the corpus cleaned (P1-P6), normalised (T1-T6), without empty
    # sentences (P10) and tagged (T8).  Filters on ``tagged`` must run on this
    # written column: on a computed alias Catalyst pushes them below the
    # projection and re-tags per element.
    @cached_property
    def normalized(self) -> DataFrame:
        c = self.corpus
        names = self.stages.write(c.names, "names")
        return C.normalize_utts(C.import_clean(C.wide_corpus(c.raw_corpus)), names, c.table("nation").count(), self.stages.write)

    @cached_property
    def tagged(self) -> DataFrame:
        key = F.split("uid", "-")       # k-id-turn-sent_no: the corpus order
        return self.stages.write(C.drop_empty(self.normalized), "sentences", ("speaker",), "uid", lambda t: tag_rows(t.select(
            "uid", key[0].alias("k"), *[key[i].cast("bigint").alias(c) for i, c in ((1, "id"), (2, "turn"), (3, "sent_no"))],
            "subject", "age_months", "utt", T.tokens("utt").alias("tagged"), "speaker"), "tagged"))

    @cached_property
    def parent(self) -> DataFrame:
        return self.tagged.where(F.col("speaker") == "parent").drop("speaker")

    @cached_property
    def child(self) -> DataFrame:
        return self.tagged.where(F.col("speaker") == "child").drop("speaker")

    @staticmethod
    def with_det(sentences: DataFrame) -> DataFrame:
        """The sentences that have a determiner by tag, without which none has a pair, a window
        or a candidate: the others pass no lambda.  ``sentences``: the written ones."""
        return sentences.where(F.array_contains("tagged.pos", "DET"))

    # ---- stage 2: noun types
    @cached_property
    def raw_types(self) -> DataFrame:
        return self.stages.write(A.noun_types_raw(self.with_det(self.parent)), "noun_types_raw")

    @cached_property
    def noun_types(self) -> DataFrame:
        return self.stages.write(A.assign_types(self.raw_types), "noun_types", ("model_type",))

    # ---- stage 3: the edit log, and what is read off it
    @cached_property
    def edits(self) -> DataFrame:
        log = R.iterated_log(self.with_det(self.parent), self.noun_types, self.remove_conflicts, cut=self.stages.write)
        return self.stages.write(log, "edits", (), "uid")

    @cached_property
    def base(self) -> DataFrame:
        """Parent sentences of a band, as they are before any rewrite."""
        return B.in_bands(self.parent)

    @property
    def corpus_variants(self) -> DataFrame:
        return B.training_corpus(self.parent, self.edits)

    @property
    def bands(self) -> DataFrame:
        return B.in_bands(self.corpus_variants)

    def write_bands(self, name: str, columns: list[str], form: str, codec: str) -> str:
        """The folder ``name`` with the bands' ``columns``, a folder for each (model_type, band_hi).  The
        variants are written one after another, so the text of one is shuffled at a time."""
        for m in EL.EVERY:
            rows = B.in_bands(B.training_corpus(self.parent, self.edits, [m]))
            self.stages.files(rows.select("band_hi", *columns), f"{name}/model_type={m}", ["band_hi"], form, codec)
        return f"{self.stages.root}/{name}"

    @cached_property
    def band_files(self) -> str:
        """K2: the folder of the band files, written once a run."""
        return self.write_bands("band_files", ["utt"], "text", "gzip")

    @cached_property
    def changes(self) -> DataFrame:
        return self.stages.write(EL.packed_changes(self.base, self.edits), "changes")

    @property
    def triples(self) -> DataFrame:
        """Signed triples; the differences are written, those of the base cost less than reading them."""
        return EL.base_triples(self.base).unionByName(EL.unpacked(self.changes))

    @cached_property
    def det_sets(self) -> DataFrame:
        """A4: determiners seen per noun per (variant, band)."""
        return self.stages.write(B.noun_det_sets(self.base, self.edits), "det_sets", ("model_type", "band_hi"))

    @cached_property
    def word_counts(self) -> DataFrame:
        return self.stages.write(V.band_word_counts(self.triples), "word_counts", ("model_type",))

    @property
    def step_offsets(self) -> DataFrame:
        rows = EL.count_by(EL.signed_rows(self.base, self.edits), ["band_hi"]).withColumnRenamed("n", "rows")
        return V.step_offsets_of(rows)

    @cached_property
    def loss_curve(self) -> DataFrame:
        losses = V.fitted_losses(EL.packed_triples(self.base, self.changes), self.stages.write)
        return self.stages.write(V.loss_curve(self.step_offsets, losses), "loss_curve")

    # ---- stage 4: test sets
    @cached_property
    def first_age(self) -> DataFrame:
        return self.stages.write(B.first_training_age(self.with_det(self.parent)), "first_training_age")

    @cached_property
    def test_sets(self) -> DataFrame:
        t = TS.make_test_sets(self.with_det(self.child), self.noun_types, self.first_age, self.unique_nouns)
        return self.stages.write(t, "test_sets")

    @cached_property
    def test_sets_all(self) -> DataFrame:
        """Every deciding sentence (the CLI default, unique_nouns off), by key: a sentence
        is in up to 60 cells, its columns are joined by who needs them."""
        t = TS.make_test_sets(self.with_det(self.child), self.noun_types, self.first_age, False, columns=["uid"])
        return self.stages.write(t, "test_sets_all")

    # ---- stage 5: prediction and evaluation
    @cached_property
    def candidates(self) -> DataFrame:
        return E.with_gold(E.masked_candidates(self.test_sets), self.noun_types)

    @cached_property
    def scored(self) -> DataFrame:
        p = PR.predict(self.candidates, EL.packed_triples(self.base, self.changes), cut=self.stages.write)
        return self.stages.write(p, "scored")

    @cached_property
    def counters(self) -> DataFrame:
        return E.counters(self.test_sets, self.scored)

    @cached_property
    def results(self) -> DataFrame:
        """The 60-row results table, written once; statistics and charts read it."""
        return self.stages.write(E.ratios(self.counters), "results")


class OverallPlan:
    """Children vs model on the children's sentences, with the unfiltered (100)
    model by default; the model is trained on the parents' sentences of the study."""

    @classmethod
    def shared(cls, spark: SparkSession, sf_dir: str, model_type: int = 100) -> "OverallPlan":
        key = (cls.__name__, _session_key(spark), sf_dir, model_type)
        if key not in _SHARED:
            _SHARED[key] = cls(spark, sf_dir, model_type)
        return _SHARED[key]

    def __init__(self, spark: SparkSession, sf_dir: str, model_type: int = 100):
        self.spark = spark
        self.study = StudyPlan.shared(spark, sf_dir)
        self.corpus = self.study.corpus
        self.model_type = model_type

    @property
    def normalized(self) -> DataFrame:
        return self.study.normalized

    @cached_property
    def overall(self) -> DataFrame:
        """The children's sentences with a determiner before a noun."""
        return self.study.child.where(P.any_det_x_noun("tagged"))

    @property
    def triples(self) -> DataFrame:
        """Training triples of the model: those of the base for the unfiltered one."""
        return EL.signed_triples(self.study.base, None if self.model_type == UNFILTERED else self.study.edits)

    @cached_property
    def registry(self) -> DataFrame:
        """The trained bands of the model, as its files say."""
        path = f"{self.study.stages.root}/model_bands-{self.model_type}"
        IO.write_age_bands(self.study.bands.where(F.col("model_type") == self.model_type), path)
        return self.study.stages.write(IO.discover_bands(self.spark, path), f"trained_bands_{self.model_type}")

    def _cut(self, name: str):
        return lambda rows, step: self.study.stages.write(rows, f"{name}_{self.model_type}_{step}")

    @cached_property
    def model_preds(self) -> DataFrame:
        p = O.model_predictions(self.overall, self.triples, self.model_type, self._cut("overall"), self.registry)
        return self.study.stages.write(p, "model_predictions")

    @cached_property
    def final_preds(self) -> DataFrame:
        p = O.final_band_predictions(self.overall, self.triples, self.model_type, self._cut("final"))
        return self.study.stages.write(p, "final_predictions")
