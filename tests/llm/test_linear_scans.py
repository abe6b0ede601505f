"""Scans whose time grows with the text: all maximal segments and nearest decided blocks."""

import random
import time

import pytest

from detflow.llm import html as H
from detflow.llm import toxicity as T


def brute_segments(values, first=0):
    """The best segment, then those left and right of it, by definition."""
    best = max(((sum(values[a:b]), -(b - a), a, b) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0, 0, 0, 0))
    score, _, a, b = best
    if score <= 0:
        return []
    return brute_segments(values[:a], first) + [(score, first + a, first + b)] + brute_segments(values[b:], first + b)


def test_all_maximal_segments():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    for _ in range(150):
        scores = T.Scores({w: (rng.uniform(-2, 2), 5.0) for w in words})
        tokens = [w.encode() for w in rng.choices(words, k=rng.randrange(30))]
        want = brute_segments([scores[t] - T.DRIFT for t in tokens])
        got = T.segments(tokens, scores)
        assert [x[1:] for x in got] == [x[1:] for x in want]
        assert [x[0] for x in got] == pytest.approx([x[0] for x in want])


def test_segments_in_linear_time():
    scores = T.Scores({"bad": (3.0, 9.0), "good": (-4.0, -9.0)})

    def seconds(n):
        texts = ([b"bad", b"good"] * n, [b"bad"] * n + [b"good"] * n, [b"bad", b"bad", b"x"] * n)
        at = time.process_time()
        for tokens in texts:
            T.segments(tokens, scores)
        return time.process_time() - at

    seconds(1000)
    assert seconds(200_000) < 4 * seconds(100_000) + 0.2
    assert len(T.segments([b"bad", b"good"] * 100_000, scores)) == 100_000


def test_nearest_decided_blocks():
    rng = random.Random(6)
    for _ in range(200):
        labels = rng.choices([True, False, None], k=rng.randrange(12))
        want = []
        for k in range(len(labels)):
            before = [d for d in range(k) if labels[d] is not None]
            want.append((k - before[-1], labels[before[-1]]) if before else None)
        assert H.nearest_decided(labels) == want


def test_many_undecided_blocks():
    page = "".join(f"<p>word {i}</p><p><a href=x>link {i}</a></p>" for i in range(20_000))
    at = time.process_time()
    H.main_text(page)
    assert time.process_time() - at < 20
