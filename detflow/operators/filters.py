"""Sentence filters over tagged arrays (P13-P16): narrow ``exists``/``filter`` HOFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from detflow.operators.pairing import _t, is_det_tagged, is_det_word, pair_eval, positions


def _pos(t: Column, j: Column) -> Column:
    return F.get(t, j.cast("int"))["pos"]


def det_noun(tagged) -> Column:
    """a/the DET followed by NOUN, or by one non-DET non-NOUN token then NOUN."""
    t = _t(tagged)
    return F.exists(positions(t), lambda i: is_det_tagged(F.get(t, i)) & F.coalesce(
        (_pos(t, i + 1) == "NOUN")
        | (~_pos(t, i + 1).isin("DET", "NOUN") & (_pos(t, i + 2) == "NOUN")), F.lit(False)))


def any_det_x_noun(tagged) -> Column:
    """Any DET with a NOUN at +1 or at +2, whatever lies between."""
    t = _t(tagged)
    return F.exists(positions(t), lambda i: (F.get(t, i)["pos"] == "DET") & F.coalesce(
        (_pos(t, i + 1) == "NOUN") | (_pos(t, i + 2) == "NOUN"), F.lit(False)))


def n_det_words(tagged) -> Column:
    """Number of tokens whose lowercase text is a/the (POS ignored)."""
    return F.size(F.filter(_t(tagged), is_det_word))


def one_det_only(tagged) -> Column:
    """P15."""
    return n_det_words(tagged) == 1


def one_candidate(tagged) -> Column:
    """Exactly one D5 candidate."""
    return F.size(pair_eval(tagged)) == 1
