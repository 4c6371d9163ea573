"""Distinct numbers come from a sort; the hash table of `np.unique` took four fifths of the time of toxicity features."""

import random

import numpy as np

from corvane.llm import suffix, textblocks, toxicity
from corvane.llm.textblocks import U64, mix


def test_distinct_numbers_in_order():
    for values in ([], [5], [3, 1, 3, 2**63, 0, 1]):
        values = np.array(values, dtype=np.uint64)
        assert textblocks.sorted_distinct(values).tolist() == sorted(set(values.tolist()))


def test_features_are_those_of_each_text_without_a_hash_table(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["Katze", "hund", "a", "strassenbahn", "étés", "x1"], k=n)).encode() for n in (0, 1, 7, 60)] + [None]

    def hashed(word):
        return int(mix(textblocks._span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])))[0] % U64(toxicity.BUCKETS))

    def brute(text):
        out = set()
        for w in (text or b"").lower().split():
            out.add(hashed(w))
            for n in toxicity.STEMS:
                if len(w) > n:
                    h = textblocks._span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([n])) + U64(n)
                    out.add(int(mix(h)[0] % U64(toxicity.BUCKETS)))
        return sorted(out)

    want = [brute(t) for t in texts]

    def hash_table(values, **more):
        raise AssertionError("distinct numbers by a hash table")

    monkeypatch.setattr(np, "unique", hash_table)
    values, bounds = toxicity.features(texts)
    assert [values[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    data, starts = textblocks.join_texts([t or b"" for t in texts])
    assert sum(len(r[0]) for r in suffix._anchors(data, starts)) > 0
