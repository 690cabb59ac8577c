"""Short texts that share half of their bytes are somewhat alike."""

import random

import pyarrow as pa

from tabscope.llm import fingerprints


def test_short_edited_texts_have_likeness():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [word(rng.randint(14, 20)) for _ in range(400)]
    edited = [t[:len(t) - len(t) // 2] + word(len(t) // 2) for t in texts]
    other = [word(len(t)) for t in texts]
    own = fingerprints.fingerprints(pa.array(texts))
    near = fingerprints.likeness(own, fingerprints.fingerprints(pa.array(edited)))
    far = fingerprints.likeness(own, fingerprints.fingerprints(pa.array(other)))
    assert (near == 0).mean() < 0.2
    assert far.mean() < 0.02 < near.mean()
