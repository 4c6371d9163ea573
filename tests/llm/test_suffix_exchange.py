"""What blocks of the suffix operator send, and that it does not matter in which order rows arrive."""

import random

import numpy as np
import pyarrow as pa

from corvane.llm import suffix
from corvane.llm.routing import unpack

N_PARTS, N_SHARDS = 3, 6


def _block(number, rows, seed):
    rows = random.Random(seed).sample(rows, len(rows))
    return pa.table({"__block": pa.array([number] * len(rows), pa.int64()), "__id": pa.array([r[0] for r in rows], pa.int64()), "__text": pa.array([r[1] for r in rows], pa.binary())})


def _of(rows, column, value):
    return rows.filter(pa.compute.equal(rows.column(column), value))


def _segments(blocks):
    """The answers on anchors and the segments that the blocks send."""
    asked = pa.concat_tables([suffix._send_anchors(N_PARTS)(_block(k, rows, 1)) for k, rows in enumerate(blocks)])
    answers = pa.concat_tables([suffix._answer_anchors(_of(asked, "to", part)) for part in range(N_PARTS) if _of(asked, "to", part).num_rows])
    return asked, answers, pa.concat_tables([suffix._send_segments(N_PARTS, N_SHARDS)(_block(k, rows, 2), _of(answers, "block", k)) for k, rows in enumerate(blocks)])


def _random_text(rng, n):
    return bytes(rng.integers(97, 123, n).astype(np.uint8))


def test_short_strings_in_common_send_no_segments():
    """Texts that share phrases of 24 bytes, as any two large ones do, have no window of 50 bytes in common: nothing is sent."""
    rng = np.random.default_rng(5)
    phrases = [_random_text(rng, 24) for _ in range(20)]
    blocks = [[(100 * k + j, b" ".join(_random_text(rng, 60) + p for p in phrases)) for j in range(5)] for k in range(3)]
    asked, answers, segments = _segments(blocks)
    assert asked.num_rows and not (np.array(segments.column("kind").to_pylist()) == suffix.SEGMENTS).any()


def test_anchors_are_answered_by_bits():
    rng = np.random.default_rng(6)
    rows = [(j, _random_text(rng, 40_000)) for j in range(4)]
    asked, answers, _ = _segments([rows, [(j + 10, t) for j, t in rows]])
    anchors = sum(len(unpack(b, "u1", "<u4")[1]) for b in asked.column("blob").to_pylist())
    sizes = [sum(len(b) for b in t.column("blob").to_pylist()) for t in (asked, answers)]
    assert anchors > 15_000 and sizes[0] < 5 * anchors and sizes[1] < anchors / 8 + 60 * answers.num_rows


def test_rows_in_any_order_give_the_same_cuts():
    rng = np.random.default_rng(7)
    pool = [_random_text(rng, n) for n in (70, 130, 400)] + [b"a" * 300, b"ab" * 150]
    rows = [(int(rng.integers(0, 30)), b"".join([_random_text(rng, 30), pool[int(rng.integers(0, 5))], _random_text(rng, int(rng.integers(0, 90))), pool[int(rng.integers(0, 5))]])) for _ in range(60)]
    rows += [(None, pool[2]), (None, None), (3, b""), (4, pool[0][:49])]
    blocks = [rows[:20], rows[20:21], rows[21:]]
    _, _, segments = _segments(blocks)
    answers = pa.concat_tables([suffix._answer_segments(_of(segments, "to", part)) for part in range(N_PARTS) if _of(segments, "to", part).num_rows])
    seen = {}
    for i, t in rows:
        key = suffix.NO_ID if i is None else i
        for k in range(len(t or b"") - 49):
            seen[t[k : k + 50]] = min(seen.get(t[k : k + 50], suffix.NO_ID), key)
    want, got = [], []
    for k, own in enumerate(blocks):
        for i, t in own:
            gone = np.zeros(len(t or b""), dtype=bool)
            for at in range(len(gone) - 49):
                if seen[t[at : at + 50]] < (suffix.NO_ID if i is None else i):
                    gone[at : at + 50] = True
            want.append((-1 if i is None else i, len(gone), int(gone.sum()), np.frombuffer(t or b"", np.uint8)[~gone].tobytes()))
        cut = suffix._cut(["__id"], True, N_PARTS, N_SHARDS)(_block(k, own, 3), _of(answers, "block", k))
        got += [(-1 if r["__id"] is None else r["__id"], r["n_bytes"], r["n_removed"], r["kept"]) for r in cut.to_pylist()]
    assert sorted(got) == sorted(want) and any(w[2] for w in want)
