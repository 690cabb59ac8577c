"""A text is measured alike in one piece and in several."""

import random

import numpy as np
import pyarrow as pa

from tabscope.llm import quality, textvec


def test_measures_do_not_depend_on_the_cuts(monkeypatch):
    rng = random.Random(2)
    text = " ".join(["AB" * rng.randint(1, 9) if i < 500 else rng.choice(["the", "le le", "so! so!", "##", "x" * 30])
                     for i in range(3000)])
    whole = next(quality.text_features(pa.array([text])))
    monkeypatch.setattr(textvec, "SLICE", 500)
    parts = next(quality.text_features(pa.array([text])))
    assert parts.n == whole.n
    assert np.array_equal(parts.measures, whole.measures)
    assert np.array_equal(quality.votes(parts), quality.votes(whole))
    assert np.array_equal(parts.shapes, whole.shapes)
