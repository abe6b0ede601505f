"""Column expressions for utterance cleaning and token handling (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
DETERMINERS = ("a", "the")          # the two determiners under study
DET_TYPE = {"a": "A", "the": "B"}   # determiner -> type letter
TOKEN_PATTERN = r"[\pL\pN']+"    # word tokens; punctuation is dropped
SENTENCE_SPLIT = r"[.!?\n]+"
WORD_CHAR = r"[\p{L}\p{N}_]"        # Unicode word character, as Python's \w


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_only_mask(c) -> Column:
    """Trimmed text is exactly MASK or MASK MASK (trim all whitespace)."""
    t = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    return col(c).contains("MASK") & t.isin("MASK", "MASK MASK")


def norm_article(c) -> Column:
    """Whole-word ``an`` -> ``a`` and ``An`` -> ``A``; ``AN`` untouched."""
    x = F.regexp_replace(col(c), rf"(?<!{WORD_CHAR})an(?!{WORD_CHAR})", "a")
    return F.when(col(c).contains("An"), F.regexp_replace(x, rf"(?<!{WORD_CHAR})An(?!{WORD_CHAR})", "A")).otherwise(x)


def strip_at(c) -> Column:
    """P5: delete every '@'."""
    return F.translate(col(c), "@", "")


def clean_entities(c) -> Column:
    """P6: '&' followed by four digits becomes an apostrophe."""
    return F.regexp_replace(col(c), r"&[0-9]{4}", "'")


def import_clean(c) -> Column:
    """P4 -> P5 -> P6 in the reference's order; a text without any part that they change passes as it is."""
    some = F.greatest(*[col(c).contains(part) for part in ("an", "An", "@", "&")])
    return F.when(some, clean_entities(strip_at(norm_article(c)))).otherwise(col(c))


def tokens(c) -> Column:
    """Ordered word tokens without punctuation."""
    return F.regexp_extract_all(col(c), F.lit(TOKEN_PATTERN), 0)


def tokens_with_markers(c) -> Column:
    """T1 for normalisation: ``[xN]`` repeat markers survive as tokens."""
    return F.regexp_extract_all(col(c), F.lit(r"\[x[0-9]+\]|[\pL\pN'+@]+"), 0)


# Fixed limit: a repeat marker says at most 999 times; a larger number is a word.
MARKER = r"^\[x0*[0-9]{1,3}\]$"


def expand_repeats(c) -> Column:
    """A ``[xN]`` token, N up to 999, repeats the previous output token N-1 more
    times and disappears; a leading marker (nothing emitted yet) is kept as a word,
    and so is one with a larger number.

    Linear per sentence: ordinary tokens map to themselves; only a marker
    looks back for the last literal token (non-marker, or the token at 0).
    Sentences without a marker pass as they are."""
    arr = col(c)

    def out(t, i):
        literal = ~t.rlike(MARKER) | (i == 0)
        prev = F.element_at(F.filter(F.slice(arr, 1, i), lambda x, j: ~x.rlike(MARKER) | (j == 0)), -1)
        n = F.greatest(F.regexp_extract(t, r"([0-9]+)", 1).cast("int") - 1, F.lit(0))
        return F.when(literal, F.array(t)).otherwise(F.array_repeat(prev, n))

    return F.when(F.exists(arr, lambda x: x.startswith("[x")), F.flatten(F.transform(arr, out))).otherwise(arr)


def strip_plus_join(c) -> Column:
    """T4: delete '+' inside tokens, join by one blank."""
    return F.replace(F.array_join(col(c), " "), F.lit("+"), F.lit(""))


def words(tagged) -> Column:
    """Sentence text rebuilt from a tagged array."""
    return F.array_join(F.transform(col(tagged), lambda x: x["word"]), " ")
