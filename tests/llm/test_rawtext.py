"""Spans that are equal, and those that only look it."""

import random

import numpy as np
import pyarrow as pa
from actionflow.llm import near_duplicates as nd
from actionflow.llm import quality_rules as qr
from actionflow.llm import rawtext

from tests.llm.test_quality import brute


def thue_morse(steps):
    """Two texts of a and b that meet under any polynomial hash modulo a power of two, once they are long enough."""
    t = "a"
    for _ in range(steps):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def counts(texts):
    parts = [qr._of_slice(p) for p in rawtext.slices(pa.array(texts, pa.string()))]
    return np.stack([np.concatenate([p[c] for p in parts]) for c in qr.COUNTS[:5]], 1).tolist()


def test_texts_that_meet_under_a_polynomial():
    for steps in (10, 11, 14):
        a, b = thue_morse(steps)
        assert counts([f"{a}\n{b}", f"{a}\n{a}"]) == [list(brute(f"{a}\n{b}")), list(brute(f"{a}\n{a}"))]
        x, y, z = (s.tolist() for s in nd.shingle_sets(next(rawtext.slices(pa.array([f"{a} x y z w", f"{b} x y z w", f"{a.upper()} X y z\tw"]))), 4))
        assert len(set(x) & set(y)) == 1 and x == z


def near_texts(seed):
    """Lines and words that differ in one byte, in their last byte, or in length by a zero."""
    r = random.Random(seed)
    words = [w for n in (1, 7, 8, 9, 15, 16, 17, 40) for base in ["".join(r.choice("ab") for _ in range(n))] for w in (base, base[:-1] + "c", "c" + base[1:], base + "\0", base + "a")]
    return [r.choice(["\n", " "]).join(r.choice(words) for _ in range(r.choice([3, 30, 200]))) for _ in range(40)]


def test_near_texts():
    for seed in range(5):
        texts = near_texts(seed)
        assert counts(texts) == [list(brute(t)) for t in texts]


def test_counts_hold_even_if_the_hash_says_nothing(monkeypatch):
    texts = near_texts(3)[:12] + ["one line\none line\nanother"]
    monkeypatch.setattr(rawtext.Slice, "hashes", lambda self, start, end, lower=False: (end - start).astype(np.uint64) % np.uint64(3))
    assert counts(texts) == [list(brute(t)) for t in texts]


def test_long_spans_go_in_bounded_pieces(monkeypatch):
    r = random.Random(1)
    long = "".join(r.choice("abc") for _ in range(5000))
    part = next(rawtext.slices(pa.array([f"{long} short {long} {long[:-1]}x tiny"])))
    whole = part.hashes(*part.words())
    monkeypatch.setattr(rawtext, "MOST_EIGHTS", 7)
    again = part.hashes(*part.words())
    assert whole.tolist() == again.tolist() and whole[0] == whole[2] != whole[3]
    assert part.same(np.array([0, 0, 1]), np.array([2, 3, 4]), *part.words()).tolist() == [True, False, False]
