import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from detflow.llm import packing as P


def check_groups(counts, groups, capacity):
    used = np.zeros(capacity + 1, np.int64)
    for bins, lengths in groups:
        assert bins > 0 and 0 < sum(lengths) <= capacity
        for x in lengths:
            used[x] += bins
    assert (used == counts).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_histogram_packing_is_whole(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=25)
    groups, _ = P.plan(counts, 24)
    check_groups(counts, groups, 24)


def brute_bins(lengths, capacity):
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0] and i < len(lengths):
            return
        if i == len(lengths):
            best[0] = min(best[0], len(bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity:
                bins[j] += lengths[i]
                go(i + 1, bins)
                bins[j] -= lengths[i]
        bins.append(lengths[i])
        go(i + 1, bins)
        bins.pop()
    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_fixed_sets_keep_an_optimum(lengths):
    counts = np.bincount(np.array(lengths), minlength=13)
    fixed = P.reduce_dominated(counts, 12)
    rest = [x for x in range(13) for _ in range(counts[x])]
    assert sum(b for b, _ in fixed) + (brute_bins(rest, 12) if rest else 0) == brute_bins(lengths, 12)


def test_cut():
    assert P.cut(5, 4) == [(0, 1), (1, 4)]
    assert P.cut(8, 4) == [(0, 4), (4, 4)]
    assert P.cut(3, 4) == [(0, 3)]


def test_vocabularies_agree():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ["Hello  world\n\nfoo", "é ñ 漢字 \x00", "", "a" * 500, "it's 12 <|endoftext|>"]:
        assert t.encode(text, add_special_tokens=False).ids == P.encoder(P.VOCABULARY).encode_ordinary(text)


def test_pack_round_trip(spark):
    rows = [(1, "alpha beta", "x"), (2, None, "x"), (3, "word " * 5000, None), (1, "alpha beta", "x"), (None, "n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    out = P.pack(spark, df, with_ids=True).toPandas()
    enc = P.encoder(P.VOCABULARY)
    assert out["length"].sum() == sum(len(enc.encode_ordinary(t or "")) + 1 for _, t, _ in rows)
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].to_numpy() == np.concatenate([[0], seq["length"].cumsum()[:-1]])).all()
        assert seq["length"].sum() <= 1024
    long = out[out.doc_id == 3].sort_values("piece")
    ids = [i for x in long["ids"] for i in x]
    assert ids == enc.encode_ordinary("word " * 5000) + [2]
    assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(long["ids"], long["ids_crc32"]))
    assert P.pack(spark, df.limit(0)).count() == 0


def test_added_tokens_inside_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>  \n b", "x <|endoftext| y", "é <|endoftext|>é " * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = P.pack(spark, df, with_ids=True).toPandas().sort_values("piece")
    for i, text in enumerate(texts):
        ids = [x for piece in got[got.doc_id == i]["ids"] for x in piece]
        assert ids == t.encode(text, add_special_tokens=False).ids + [P.END_TOKEN]
