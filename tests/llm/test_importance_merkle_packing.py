"""Importance resampling, Merkle manifests and packing against brute force: nulls, empty and long texts, ties,
repeated rows, empty tables and columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import importance, merkle, packing
from corvane.llm.textblocks import ALNUM, Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _texts(n=140):
    rng = random.Random(11)
    vocabulary = ["the", "Of", "Ähre", "éa", "x1", "Straße", "42", "q" * 49, "r" * 48, "s" * 200] + ["".join(rng.choices("abcdeéßXY", k=rng.randint(1, 9))) for _ in range(150)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(n)]
    return out + [out[0], out[0], out[1].upper(), "", None, "  \t", "!!", "a", "z" * 5000, " ".join(rng.choices(vocabulary, k=9000))]


TEXTS = _texts()


# importance resampling


def _grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _resampled(rows, target, least=20, percent=25):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    s, t = (Counter(bucket(g) for x in texts for g in _grams(x)[1]) for texts in ([r[1] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000.0) / ((s[b] + 1.0) * (t_all + 10_000.0))))
    out = []
    for i, text in rows:
        words, grams = _grams(text)
        weight = sum(gain(bucket(g)) for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = Counter()
    for place, r in enumerate(able[: percent * len(able) // 100]):
        ranks[(r[0], r[3]), place + 1] += 1
    return out, ranks


@pytest.mark.parametrize("repeated", [False, True])
def test_importance_resampling(spark, repeated):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[3])]
    if repeated:  # one id in a third of all rows, and rows without any
        rows += [(5, TEXTS[5])] * 90 + [(None, TEXTS[7])] * 30
    target = [TEXTS[2], None, "", TEXTS[9], "the of 42"]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, id int, score int, rank int, deal int").repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), keep=["id", "score", "rank"]).collect()
    want, ranks = _resampled(rows, target)
    assert Counter((r["id"], r["n_features"], r["weight"], r["score"], r["n_words"]) for r in got) == Counter(want)
    assert Counter(((r["id"], r["score"]), r["rank"]) for r in got if r["rank"] is not None) == ranks
    assert all(tuple(r["row"]) == (1, 2, 3) for r in got)


def test_importance_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, TEXTS[0] * 9), (2, TEXTS[1] * 9), (3, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    assert {r["id"]: r["n_features"] for r in importance.resample(docs, none, percent=100, least_words=0).where("rank is not null").collect()} == {i: len(_grams(t)[1]) for i, t in ((1, TEXTS[0] * 9), (2, TEXTS[1] * 9), (3, None))}


def test_run_hashes_are_crc32_of_the_joined_words():
    texts = [TEXTS[0], None, "q" * 47 + " " + "r" * 48 + " " + "s" * 49 + " t", "Ä ö 9", TEXTS[-2]]
    for k, (of, crc) in enumerate(importance.run_crcs(Words([t and t.encode() for t in texts], ALNUM), 3)):
        want = [(i, zlib.crc32(" ".join(w[j : j + k + 1]).encode())) for i, w in enumerate(_grams(t)[0] for t in texts) for j in range(len(w) - k)]
        assert list(zip(of.tolist(), crc.tolist())) == want


def test_offsets_reach_the_score_where_the_draw_ends():
    assert importance.rank_offsets([(5, 2), (9, 1), (7, 4)], 3) == (7, [(9, 0), (7, 1)])
    assert importance.rank_offsets([(5, 2)], 0) == (None, [])
    assert importance.rank_offsets([], 4) == (None, [])


# Merkle manifest


def _h(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def _leaf(row):
    return _h(b"".join(b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in row))


def _tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h("".join(now[k : k + fan])) for k in range(0, len(now), fan)])
    return levels


def _siblings(levels, k, fan):
    for now in levels[:-1]:
        low = k // fan * fan
        yield now[low : low + fan], k - low
        k //= fan


def _manifest(rows, altered, fan=16):
    """Counter of the manifest's rows; `altered` gives the row as a changed copy has it."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r))) for s in names}
    trees = {s: _tree([_leaf(r) for r in own[s]], fan) for s in names}
    top = _tree([trees[s][-1][0] for s in names], fan)
    out = Counter()
    for place, s in enumerate(names):
        for k, r in enumerate(own[s]):
            v, proof = _leaf(altered(r)), ""
            for run, at in [*_siblings(trees[s], k, fan), *_siblings(top, place, fan)]:
                v, proof = _h("".join([*run[:at], v, *run[at + 1 :]])), proof + "".join(run[:at] + run[at + 1 :])
            out[r[0], trees[s][0][k], trees[s][-1][0], top[-1][0], _h(proof), v, v == top[-1][0]] += 1
    return out


def _low_where(r):
    hit = zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0
    return (*r[:4], r[4].translate(LOWER) if hit and r[4] is not None else r[4])


@pytest.mark.parametrize("fan,depth", [(16, 3), (2, 3), (4, 1)])
def test_merkle_manifest(spark, fan, depth):
    sources = [None, "", "é", "Z", "a", "hot", "hot", "hot", "hot"] + [f"s{k}" for k in range(9)]
    rows = [(k if k % 17 else None, sources[k % len(sources)], None if k % 5 == 0 else "en", None if k % 7 == 0 else k, t) for k, t in enumerate(TEXTS)]
    rows += [rows[5]] * 60 + [(8, "hot", "xx", 1, "B"), (8, "hot", "xx", 1, "A")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, id int, tree int, H int").repartition(5)
    got = merkle.manifest(docs, altered={"text": merkle.lowered_where("text", "doc_id")}, fan=fan, depth=depth).collect()
    assert Counter(tuple(r) for r in got) == _manifest(rows, _low_where, fan)
    assert any(not r["verified"] for r in got)


def test_merkle_of_one_row_one_source_and_none(spark):
    ddl = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], ddl)).count() == 0
    one = [(1, None, None, None, None)]
    assert Counter(tuple(r) for r in merkle.manifest(spark.createDataFrame(one, ddl)).collect()) == _manifest(one, lambda r: r)
    many = [(k, "s", "en", 1, "t") for k in range(17)]
    got = merkle.manifest(spark.createDataFrame(many, ddl)).collect()
    assert Counter(tuple(r) for r in got) == _manifest(many, lambda r: r) and all(r["verified"] for r in got)


# packing

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def _ids(text):
    from tokenizers import Tokenizer

    if not hasattr(_ids, "of"):
        _ids.of = Tokenizer.from_file(TOKENIZER)
        _ids.of.encode_special_tokens = True
    return _ids.of.encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["don't CAN'T 12ab é Σας <|endoftext|> x\x1fy", "　zz \x85 q\xa0r", "日本語 \U0001f642\U0001f642", "o'sullivan 'tis", None, ""]


def test_word_ids_are_those_of_whole_texts():
    words = packing.WordIds(TOKENIZER, most_words=60)
    for texts in (TEXTS[:50], ODD, TEXTS[20:], ODD[::-1]):
        ids, bounds = packing.token_ids([t and t.encode() for t in texts], words, 1)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [_ids(t) for t in texts]


def _packed(got, want, capacity):
    """That the pieces are those of the texts and that sequences are gapless; how many sequences there are."""
    pieces = Counter()
    for i, t in want:
        ids = _ids(t)
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            pieces[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r[c] for c in ("id", "piece", "start", "length", "ids_crc32")) for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return by


def test_packing(spark):
    rows = list(enumerate(TEXTS + ODD)) + [(3, TEXTS[3])] * 100 + [(None, None), (None, "x")]
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, id int, block int, sequence_id string").repartition(4)
    total = sum(len(_ids(t)) for _, t in rows)
    for capacity, block in ((4096, 8192), (512, 64), (512, 8192)):
        got = packing.pack_documents(docs, TOKENIZER, capacity=capacity, block_pieces=block, with_ids=True, keep=["id", "block", "sequence_id"]).collect()
        by = _packed(got, rows, capacity)
        lengths = np.array([min(capacity, n - at) for n in (len(_ids(t)) for _, t in rows) for at in range(0, n, capacity)])
        at_once = packing.best_fit(lengths, np.array([capacity, capacity, capacity * capacity]), np.array([1.0, 0.05, 0.2]))[0].max() + 1
        assert -(-total // capacity) <= len(by) <= at_once * (1.0 if block > len(rows) else 1.03)
        assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and tuple(r["row"]) == (1, 2, "k") for r in got)
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_packing_under_every_limit(spark):
    rows = list(enumerate(TEXTS[:140])) + [(k, "a b c") for k in range(200, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rule in ("norm", "dot"):
        got = packing.pack_documents(docs, TOKENIZER, capacity=2048, most_documents=9, most_cost=900_000, rule=rule, block_pieces=100).collect()
        for parts in _packed(got, rows, 2048).values():
            # a piece that exceeds a limit by itself has a sequence of its own
            assert len(parts) == 1 or len(parts) <= 9 and sum(n * n for _, n in parts) <= 900_000


def test_best_fit_takes_the_tightest_bin_and_loses_none():
    rng = np.random.default_rng(5)
    capacities, weights = np.array([100, 100, 10_000]), np.array([1.0, 0.0, 0.0])
    bins, place = packing.best_fit(np.array([60, 50, 40, 30, 20]), capacities, weights)
    assert bins.tolist() == [0, 1, 0, 1, 1] and place.tolist() == [0, 0, 60, 50, 80]
    for rule in ("norm", "dot"):
        length = rng.integers(1, 101, 700)
        bins, place = packing.best_fit(length, capacities, np.array([1.0, 0.1, 0.2]), rule)
        filled = np.bincount(bins, weights=length)
        assert filled.max() <= 100 and (filled > 0).all() and len(filled) <= 1.1 * length.sum() / 100
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1]), capacities, weights, "first")
