import numpy as np
import pyarrow as pa

from undertone.llm import words


def test_blocks_do_not_change_hashes(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 5000, 800)
    ends = np.minimum(5000, starts + rng.integers(0, 3000, 800))
    whole = words.Rolling(data, 4).spans(starts, ends)
    monkeypatch.setattr(words, "BLOCK_BITS", 8)
    assert (words.Rolling(data, 4).spans(starts, ends) == whole).all()
    full = data[:256]
    some = words.Rolling(full, 4).spans(np.array([0, 100, 256]), np.array([256, 256, 256]))
    monkeypatch.setattr(words, "BLOCK_BITS", 21)
    assert (words.Rolling(full, 4).spans(np.array([0, 100, 256]), np.array([256, 256, 256])) == some).all()


def test_equal_words_have_equal_hashes_in_a_very_long_text():
    """100 MB in one text: the same words at both ends and in a short text."""
    text = "alpha beta " + "x" * 100_000_000 + " alpha beta"
    long, short = words.words_of(pa.array([text])), words.words_of(pa.array(["beta alpha"]))
    h, s = long.hashes(), short.hashes()
    assert h[0] == h[3] == s[1] and h[1] == h[4] == s[0] and len(h) == 5
