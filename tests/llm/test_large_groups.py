"""What large groups of copies cost: edges of near duplicates, and segments that suffix arrays sort."""

import random

import numpy as np

from corvane.llm import minhash, suffix


def _near_copies(n: int) -> list[str]:
    rng = random.Random(8)
    words = [f"w{k}" for k in range(200)]
    out = []
    for _ in range(n):
        edited = list(words)
        for _ in range(2):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(edited))
    return out


def test_edges_of_a_group_of_near_copies_follow_its_members(spark, monkeypatch):
    """A member meets a lead in each of many tables; what goes to the graph is about one edge for each member."""
    held, components = [], minhash.components

    def counted(edges, scratch):
        held.append(edges.distinct().count())
        return components(edges, scratch)

    monkeypatch.setattr(minhash, "components", counted)
    n = 120
    rows = [(k, t) for k, t in enumerate(_near_copies(n))] + [(n, "a b c d e f g")]
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k in range(n)} | {n: n}
    assert held[0] <= 2 * n, held


def test_segments_without_a_counterpart_are_not_sorted(monkeypatch):
    """Windows of a segment whose anchor no other segment has get the segment's smallest id; the rest is sorted, with the same answers."""
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 123, 120).astype(np.uint8)
    whole = rng.integers(97, 123, 70).astype(np.uint8)
    # a segment is a run of windows with one anchor
    runs = next(suffix._anchors(np.append(shared, 0).astype(np.uint8), np.array([0, 121])))
    at, count = int(runs[1][np.argmax(runs[2])]), int(runs[2].max())
    assert count >= 3
    one, two = shared[at : at + count - 1 + 49], shared[at + 1 : at + count + 49]
    held, smallest_ids = [], suffix.smallest_ids
    monkeypatch.setattr(suffix, "smallest_ids", lambda strings, windows, low: held.append(len(strings)) or smallest_ids(strings, windows, low))
    strings, windows = [one, two, whole[:50], whole[:50]], np.array([count - 1, count - 1, 1, 1])
    number, low, high = np.array([0, 1, 0, 1]), np.array([5, 7, 2, 9]), np.array([5, 7, 2, 9])
    found = {block: rows for block, *rows in suffix._answers_of(number, windows, low, high, np.concatenate(strings))}
    assert held == [len(one) + len(two)]
    key, offset, run, least = found[1]
    # the second block's segment repeats all but its last window; its copy of the lone string is repeated too
    assert sorted(zip(offset.tolist(), run.tolist(), least.tolist())) == sorted([(0, count - 2, 5), (0, 1, 2)]) and 0 not in found
