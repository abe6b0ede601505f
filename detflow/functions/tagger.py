"""Rule-based part-of-speech tags (UD tag names) as a pure Column expression.

The reference uses a neural tagger; here the tag of a token is decided by the
first matching rule below, on the lowercase word, so it runs inside whole-stage
codegen with no Python.  A learned lexicon (``learn_tag_lexicon``) can refine it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Closed-class word lists of the tagging rules, in rule order.
CLOSED_CLASSES = [
    ("DET", ["a", "the", "this", "that", "these", "those"]),
    ("ADP", ["of", "in", "to", "for", "with", "on", "by", "from", "at", "as"]),
    ("AUX", ["is", "are", "was", "were", "be"]),
    ("CCONJ", ["and", "or", "but"]),
    ("PRON", ["it", "he", "she", "they", "you", "we"]),
]
SUFFIX_RULES = [("ADV", ["ly"]), ("VERB", ["ed", "ing"]), ("ADJ", ["ble", "er"])]


def pos_of(word: Column, idx: Column, lw: Column | None = None) -> Column:
    lw = F.lower(word) if lw is None else lw
    closed = None
    for tag, ws in CLOSED_CLASSES:
        cond = lw.isin(*ws)
        closed = F.when(cond, F.lit(tag)) if closed is None else closed.when(cond, F.lit(tag))
    # most words are in no class and no number: one lookup and one look at the first letter
    expr = F.when(lw.isin(*[w for _, ws in CLOSED_CLASSES for w in ws]), closed)
    expr = expr.when(F.ascii(lw).between(48, 57) & lw.rlike("^[0-9]+$"), F.lit("NUM"))
    for tag, sufs in SUFFIX_RULES:
        cond = None
        for s in sufs:
            c = lw.endswith(F.lit(s))
            cond = c if cond is None else (cond | c)
        expr = expr.when(cond, F.lit(tag))
    expr = expr.when(F.ascii(word).between(65, 90) & (idx > 0), F.lit("PROPN"))
    return expr.otherwise(F.lit("NOUN"))


def tag_tokens(toks) -> Column:
    """ARRAY<STRING> -> ARRAY<STRUCT<word, pos>>.  Lambdas are interpreted
    without common-subexpression elimination, so the lowercase form is computed
    once per token in an inner ``transform`` and reused by every rule."""
    t = F.col(toks) if isinstance(toks, str) else toks
    pairs = F.transform(t, lambda w: F.struct(w.alias("w"), F.lower(w).alias("lw")))
    return F.transform(pairs, lambda x, i: F.struct(x["w"].alias("word"), pos_of(x["w"], i, x["lw"]).alias("pos")))


TAGS = [*dict.fromkeys([tag for tag, _ in CLOSED_CLASSES] + ["NUM"] + [tag for tag, _ in SUFFIX_RULES] + ["PROPN", "NOUN"])]
CLOSED_WORDS = pa.array([w for _, ws in CLOSED_CLASSES for w in ws])
CLOSED_TAGS = np.array([TAGS.index(tag) for tag, ws in CLOSED_CLASSES for _ in ws] + [-1])      # last: of no class


def tags_of(words: pa.StringArray, first: np.ndarray) -> pa.StringArray:
    """``pos_of`` of many words at once; ``first``: those at the start of a sentence."""
    lw = pc.utf8_lower(pc.replace_substring(words, "\u0130", "i\u0307"))    # as Java lowers it
    ends = lambda sufs: np.logical_or.reduce([pc.ends_with(lw, s).to_numpy(zero_copy_only=False) for s in sufs])
    closed = CLOSED_TAGS[pc.fill_null(pc.index_in(lw, value_set=CLOSED_WORDS), -1).to_numpy(zero_copy_only=False)]
    rules = [(pc.match_substring_regex(lw, "^[0-9]+$").to_numpy(zero_copy_only=False), "NUM")]
    rules += [(ends(sufs), tag) for tag, sufs in SUFFIX_RULES]
    rules += [(pc.match_substring_regex(words, "^[A-Z]").to_numpy(zero_copy_only=False) & ~first, "PROPN")]
    code = np.select([closed >= 0, *[r for r, _ in rules]], [closed, *[TAGS.index(tag) for _, tag in rules]], TAGS.index("NOUN"))
    return pa.array(TAGS).take(pa.array(code))


def tagged_lists(tokens: pa.ListArray) -> pa.ListArray:
    """``tag_tokens`` of a column of token lists."""
    words = tokens.flatten()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    starts = np.r_[np.int32(0), ends[:-1]]
    first = np.zeros(len(words), bool)
    first[starts[starts < ends]] = True
    pairs = pa.StructArray.from_arrays([words, tags_of(words, first)], ["word", "pos"])
    return pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends], pa.int32()), pairs, mask=tokens.is_null())


def tag_rows(rows: DataFrame, tokens_col: str) -> DataFrame:
    """The rows with ``tokens_col``, ARRAY<STRING>, as ``tag_tokens`` of it, in Arrow batches:
    whole corpora are tagged this way, as the rules cost a lambda a token otherwise."""
    at = rows.columns.index(tokens_col)
    tagged = rows.sparkSession.range(0).select(tag_tokens(F.array(F.lit(""))).alias(tokens_col)).schema[0].dataType

    def tag(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([tagged_lists(c) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    schema = StructType([StructField(f.name, tagged if i == at else f.dataType) for i, f in enumerate(rows.schema)])
    return rows.mapInArrow(tag, schema)
