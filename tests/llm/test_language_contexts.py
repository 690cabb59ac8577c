"""Contexts of a small language stay beside those of a large one."""

import numpy as np

from tabscope.llm import language


def test_all_contexts_seen_often_enough_are_kept():
    own = np.arange(1, 41)
    a, b, c = (x.ravel() for x in np.meshgrid(own + 100, own + 100, own + 100, indexing="ij"))
    large = np.sort((((a << 8 | b) << 8 | c) << 8) | 101)             # 64,000 contexts, seen 90 times each
    small = np.array([(((200 << 8 | 201) << 8 | 202) << 8) | 203])
    model = language.Model(["large", "small"], [large, small], [np.full(len(large), 90), np.array([4])])
    at = [int(model.code[x]) for x in (200, 201, 202)]
    row = model.state[(at[0] * model.size + at[1]) * model.size + at[2]]
    cost = model.cost[1].reshape(-1, model.size)
    assert cost.shape[0] == 1 + 41 + (1600 + 1) + (64_000 + 1)
    assert cost[row, model.code[203]] == round(-np.log2(4 / 5) * language.UNIT)
    assert row >= cost.shape[0] - 64_001                              # a context of three bytes
