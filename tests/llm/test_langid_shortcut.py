"""The shortcut around the recursion gives no text to a language off its best path."""

import numpy as np

from tallyspring.llm import langid


def worth(s, path, switch):
    return s[np.arange(len(s)), path].sum() - switch * (np.diff(path) != 0).sum()


def test_two_rivals_without_the_leader():
    s = np.array([[0.0, -20.0, -10.0], [-20.0, 0.0, -9.9]])
    leader = s.sum(0).argmax(keepdims=True)
    assert leader[0] == 2 and langid.viterbi(s, 12.0).tolist() == [0, 1]
    assert not langid.one_language(s, np.array([0, 2]), leader, 12.0)[0]


def test_sure_texts_have_the_leader_as_best_path():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 20_000)
    offsets = np.concatenate([[0], np.cumsum(n)])
    s = rng.normal(0, 1, (offsets[-1], 4)) * np.repeat(rng.uniform(0.2, 8, len(n)), n)[:, None]
    leader = np.add.reduceat(s, offsets[:-1], axis=0).argmax(1)
    sure = langid.one_language(s, offsets, leader, 12.0)
    assert 0.2 < sure.mean() < 0.9
    for i in np.flatnonzero(sure):
        x = s[offsets[i] : offsets[i + 1]]
        assert worth(x, langid.viterbi(x, 12.0), 12.0) <= x[:, leader[i]].sum() + 1e-9
