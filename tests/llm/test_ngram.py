"""The answers of a shard of the language model."""

import numpy as np
import pyarrow as pa


def test_a_shard_is_searched_once_for_all_batches(monkeypatch):
    """Twice the batches of the same n-grams decode no more of the trie."""
    from tidemark.llm import ngram

    texts = [" ".join(f"w{(i * k) % 97}" for i in range(60)) for k in range(1, 9)]
    grams = ngram._Grams(pa.table({"text": texts}), 2)
    blob = ngram._send(grams, np.ones(len(texts), bool), 1)[0]
    schema = pa.schema([("batch", pa.int32()), ("shard", pa.int32()), ("answer", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
    decoded, whole = [0], ngram.EliasFano.range
    monkeypatch.setattr(ngram.EliasFano, "range", lambda self, a, b: decoded.__setitem__(0, decoded[0] + max(b - a, 0)) or whole(self, a, b))

    def work(n):
        decoded[0] = 0
        rows = ngram._answer(pa.table([pa.array(range(n), pa.int32()), pa.array([0] * n, pa.int32()), pa.array([blob] * n, pa.binary())], ["batch", "shard", "grams"]), schema)
        assert len(set(rows.column("answer").to_pylist())) == 1  # equal batches, equal answers
        return decoded[0]

    assert work(20) <= work(10) > 0
