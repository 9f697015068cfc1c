"""Texts of one unit have fingerprints that tell them apart."""

import random

from tidemark.llm.media import decode, digest, encode, pairs, peaks


def test_short_texts_have_fingerprints():
    rng = random.Random(8)
    texts = {" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 20))) for _ in range(400)}
    found = [pairs(peaks(decode(encode(t)[1]))) for t in texts]
    assert all(len(rows) for rows in found)
    assert len({digest(rows) for rows in found}) == len(texts)
