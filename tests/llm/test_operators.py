"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, repeated
rows, empty tables and columns of clashing names."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import decontam, imatch, langid, lm, minhash, mixing, suffix, textblocks, toxicity, urlfilter, warc

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, source string, hit_spans int, size int, rank int"


def _texts():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Ähre", "éa", "x1", "Straße", "naïve", "42"] + ["".join(rng.choices("abcdeéß", k=rng.randint(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(30)]
    out = list(base)
    for t in base[:12]:
        words = t.split(" ")
        for _ in range(3):
            edited = list(words)
            for _ in range(max(1, len(words) // 25)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            out.append(" ".join(edited))
    shared = " ".join(rng.choices(vocabulary, k=30))
    out += [f"{base[k]}\n{shared} {base[k + 1]}" for k in range(0, 10)] + [base[0], base[0], "", None, "   ", "!!!", "a", "\t b \x0b", "ab" * 400, "z" * 300, shared.upper(), " ".join(rng.choices(vocabulary, k=6000))]
    return out, shared


TEXTS, SHARED = _texts()
ROWS = [(k * 3 + 1, t, [None, "s1", "s2", "hot", "hot"][k % 5], 1, 2, 3) for k, t in enumerate(TEXTS)] + [(None, "null id " + SHARED, None, 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _low(t):
    return (t or "").translate(LOWER)


def test_decontamination(spark, docs, empty):
    items = [(1, SHARED), (2, TEXTS[5]), (3, "ab éa"), (4, None), (5, ""), (None, TEXTS[6]), (10, TEXTS[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, t in items:
        w = ALNUM.findall(_low(t))
        for k in range(len(w) - min(10, len(w)) + 1 if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(str(item))
    for block in (1 << 20, 1):  # one pass, and one for each item
        found = decontam.find_phrases(docs, bench, block_bytes=block)
        assert set(found.columns) == {"doc_id", "text", "source", "hit_spans", "size", "rank", "n_words", "n_hit", "hit_items"}
        got = {r["doc_id"]: r for r in decontam.report(found).collect()}
        for doc, t, *_ in ROWS:
            w, hit, names = ALNUM.findall(_low(t)), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if x := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        names |= x
            r = got[doc]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), decontam.digest_of(list(names)), bool(hit))
    cut = {r["doc_id"]: r["text"] for r in decontam.cut_spans(found).collect()}
    assert all(SHARED.lower() not in (t or "").lower() for t in cut.values())
    assert cut[1 + 3 * 20] == TEXTS[20] or got[1 + 3 * 20]["contaminated"]
    assert decontam.find_phrases(empty, bench).count() == 0
    none = decontam.find_phrases(docs, bench.limit(0))
    assert none.count() == len(ROWS) and none.agg(F.sum("n_hit")).first()[0] == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for _ in range(30):
        parts = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(4)]
        seq = np.concatenate([np.append(p, 0) for p in parts])
        index = decontam.FMIndex(seq, 4)
        phrase = rng.integers(1, 4, (1, 3))
        low, high = index.search(phrase)
        want = [k for k in range(len(seq) - 2) if (seq[k : k + 3] == phrase[0]).all()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_suffix_array_is_sorted_at_every_alphabet():
    rng = np.random.default_rng(1)
    for trial in range(600):
        t = rng.integers(0, 1 + [1, 2, 3, 5, 300][trial % 5], rng.integers(1, 120)).astype(np.int32)
        if trial % 3 == 0:
            t = np.tile(t[: max(1, len(t) // 6)], 6)
        if trial % 7 == 0:
            t = np.repeat(t, rng.integers(1, 5, len(t)))
        s = t.tolist()
        assert suffix.suffix_array(t, 301).tolist() == sorted(range(len(s)), key=lambda k: s[k:])


def test_suffix_array_recurses_and_takes_long_runs_at_once():
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(97, 110, rng.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
    text = b" ".join(words[k] for k in rng.integers(0, 3000, 60_000))
    for raw in (text, b"-" * 2_000_000 + b"a" + b"-" * 1_000_000, text[:100_000] * 3):
        t = np.frombuffer(raw, np.uint8).astype(np.uint16)
        order = suffix.suffix_array(t, 256).astype(np.int64)
        rank = np.zeros(len(t) + 1, dtype=np.int64)
        rank[order] = np.arange(1, len(t) + 1)
        a, b = order[:-1], order[1:]
        assert len(np.unique(order)) == len(t) and ((t[a] < t[b]) | ((t[a] == t[b]) & (rank[a + 1] < rank[b + 1]))).all()


def _brute_repeats(rows):
    seen, out = {}, {}
    for doc, t, *_ in rows:
        b, key = (t or "").encode(), suffix.NO_ID if doc is None else doc
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            seen[w] = min(seen.get(w, suffix.NO_ID), key)
    for doc, t, *_ in rows:
        b, key = (t or "").encode(), suffix.NO_ID if doc is None else doc
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if seen[b[k : k + 50]] < key:
                gone[k : k + 50] = True
        out.setdefault(doc, []).append((len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "block"), [(1000, 4 << 20), (2, 4000)])
def test_repeats(docs, empty, monkeypatch, hot, block):
    send = suffix._answer_anchors

    def answer(table):  # runs in a worker, where HOT is its own
        suffix.HOT = hot
        return send(table)

    monkeypatch.setattr(suffix, "_answer_anchors", answer)
    got = suffix.remove_repeats(docs, block_bytes=block, shard_bytes=block // 4, with_text=True).collect()
    want = _brute_repeats(ROWS)
    assert len(got) == len(ROWS)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) in want[r["doc_id"]]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
        assert len(bytes(r["kept_text"]).decode()) <= len(bytes(r["kept"]).decode(errors="ignore"))
    assert suffix.remove_repeats(empty).count() == 0


def test_near_duplicates(spark, docs, empty, monkeypatch):
    repeated = docs.union(docs.where("doc_id = 1"))
    sets, parent = {}, {}
    for doc, t, *_ in ROWS:
        w = BLANK.findall(_low(t))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * either:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    for size in (minhash.BLOCK, 2):
        monkeypatch.setattr(minhash, "BLOCK", size)
        got = minhash.near_duplicates(repeated).collect()
        assert len(got) == len(ROWS) + 1
        for r in got:
            if r["id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["id"]]), root(r["id"]), root(r["id"]) == r["id"]), r
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids_lose_no_link(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (5, b), (7, a + " x"), (8, b + " y"), (9, "c d e f g h"), (5, ""), (None, a), (None, b)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"], r["component_id"], r["kept"]) for r in got if r["id"]) == [(5, 5, True)] * 4 + [(7, 5, False), (8, 5, False), (9, 9, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["id"] is None] == [(None, True)] * 2


def test_near_duplicates_recall_at_the_threshold(spark):
    # 300 pairs at similarity 0.75 to 0.78, the hardest that are linked; a chain of near texts; and a template group below the threshold
    rng, rows, want = random.Random(3), [], {}
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    for k in range(300):
        w = [word() for _ in range(140)]
        v = w[:124] + [word() for _ in range(16)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        want[2 * k] = want[2 * k + 1] = 2 * k
    w = [word() for _ in range(200)]
    for k in range(40):
        rows.append((1000 + k, " ".join(w)))
        want[1000 + k] = 1000
        w = w[8:] + [word() for _ in range(8)]
    template = [word() for _ in range(100)]
    for k in range(60):
        rows.append((2000 + k, " ".join(template + [word() for _ in range(45)])))
        want[2000 + k] = 2000 + k
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_language_model(docs, empty):
    train = ~F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))
    got = lm.score(docs, train, block_bytes=3000).collect()
    tokens = {doc: BLANK.findall(_low(t)) + [None] for doc, t, *_ in ROWS}
    counts = {}
    for doc, w in tokens.items():
        if doc is None or doc % 5 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        w = tokens[r["doc_id"]]
        base = sum(np.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] <= 0
    assert len(got) == len(ROWS) and lm.score(empty, train).count() == 0
    nothing = lm.score(docs, F.lit(False)).collect()
    assert len(nothing) == len(ROWS) and all(r["base_score"] == 0 for r in nothing)


def test_bloom_counts_never_fall_short():
    levels = lm.Levels(1.5, 2)
    assert levels.of(np.array([1, 2, 3, 4, 5])).tolist()[:2] == [0, 1]
    assert all(levels.value[levels.of(np.array([c]))][0] >= c / 1.5 for c in (2, 3, 7, 100, 10**6))


def test_language_model_counts_single_bigrams_and_tunes_on_all_rows(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices("abcdefghijklmnopqrst", k=1 + k % 7))) for k in range(300)]
    held = [(1000, "a b c"), (1001, "t s r q"), (1002, None)]
    # far more rows, of which a sample by hash used to choose the prior
    rows += [(2000 + k, "u v" if k % 2 else "v u w") for k in range(4000)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows + held, "doc_id long, text string"), ~F.col("doc_id").isin(1000, 1001, 1002), block_bytes=20000).collect()}
    levels, one, two, three = lm.Levels(1.5, 1), {}, {}, {}
    tokens = {k: ["<"] + (t or "").split() + [">"] for k, t in rows + held}
    for k, _ in rows:
        for a, b in zip(tokens[k], tokens[k][1:]):
            one[b], two[a, b] = one.get(b, 0) + 1, two.get((a, b), 0) + 1
        for g in zip(["<"] + tokens[k], tokens[k], tokens[k][1:]):
            three[g] = three.get(g, 0) + 1
    n, v = sum(one.values()), len(one)
    one["<"] = one[">"]

    def kept(count, most):
        """What the filter gives back for a count that another one bounds."""
        return min(levels.value[min(levels.of(np.array([count]))[0], levels.of(np.array([most]))[0])], most)

    def score(w, prior, less):
        out = 0.0
        for h, a, b in zip(["<"] + w, w, w[1:]):
            before, c = one.get(a, 0), one.get(b, 0)
            found = kept(two.get((a, b), 0), min(c, before))
            p = (max(c - less, 0) + 0.5) / (n + 0.5 * (v + 1))
            p = (max(found - less, 0) + prior * p) / (max(before - less, 0) + prior)
            history = one["<"] if a == "<" else levels.value[min(levels.of(np.array([two.get((h, a), 0)]))[0], levels.of(np.array([before]))[0])]
            longer = min(kept(three.get((h, a, b), 0), found), history)
            out += np.log10((max(longer - less, 0) + prior * p) / (max(history - less, 0) + prior))
        return out

    sums = {x: sum(score(tokens[k], x, 1) for k, _ in rows) for x in (1, 4, 16, 64, 256, 1024, 4096, 16384)}
    prior = max(sums, key=sums.get)
    assert sum(c == 1 for c in two.values()) > 10
    # the filter's false positives, under 0.01 a level, move the scores of a few texts
    assert np.mean([got[k] == pytest.approx(score(w, prior, 0), abs=1e-6) for k, w in tokens.items()]) > 0.9
    assert np.mean([got[k] == pytest.approx(score(tokens[k], prior, 0), abs=1e-6) for k in range(300)]) > 0.9


def test_filter_of_a_part_keeps_its_error_rate_at_any_size():
    # a part of a 30 GB input, of which 128 MB / 7500 parts used to leave 1.4 bits an entry
    levels, rng = lm.Levels(1.5, 1), np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 48, 100_000, dtype=np.uint64))
    bloom = lm.LogFrequencyBloom(keys + np.uint64(lm.GRAMS), levels.of(np.ones(len(keys), np.int64)))
    assert len(bloom.bytes) * 8 >= lm.BITS * len(keys) and (bloom.levels(keys, lm.GRAMS) > 0).all()
    assert (bloom.levels(rng.integers(0, 1 << 48, 100_000, dtype=np.uint64), lm.GRAMS) > 0).mean() < 0.01


def test_language_identification(spark, empty):
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["katze", "hund", "maus"]}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(words[x], k=40)), x) for k in range(60) for x in [["aa", "bb"][k % 2]]] + [(100, None, "aa"), (101, "12 !?", None), (102, "", "bb"), (103, "katze hund", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(frame, F.col("doc_id") % 3 != 1).collect()}
    assert all(got[k]["lang_pred"] == x for k, _, x in rows[:60]) and got[103]["lang_pred"] == "bb"
    assert {got[k]["lang_pred"] for k in (100, 101, 102)} == {"und"} and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(frame, F.lit(False)).collect()} == {"und"}
    assert langid.identify(empty.withColumn("lang", F.lit("x")), F.lit(True)).count() == 0


def test_dictionaries_sample_all_rows_places_and_languages(spark):
    # each row says its tenth of the ids, after a head that all rows share
    rows = [(k, "head " * 500 + f"tenth{k // 300} " * 300, "aa") for k in range(3000)] + [(5000 + k, f"speech{k} of{k} few{k}", f"l{k}") for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.train(frame, doc_id="doc_id", text="text", lang="lang")
    assert len(got) == 601 and all(f"speech{k}".encode() in got[f"l{k}"] for k in range(600))
    assert all(f"tenth{k} ".encode() in got["aa"] for k in range(10)) and b"head " in got["aa"] and len(got["aa"]) == 50_000_000 // 601
    small = langid.train(frame, doc_id="doc_id", text="text", lang="lang", total_bytes=601 * 1000)
    assert len(small) == 601 and len(small["aa"]) == 1000


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    total, by = sum(r["size"] for r in got), {}
    for r in got:
        text = next(t for d, t, *_ in ROWS if d == r["doc_id"])
        assert r["size"] == len(BLANK.findall(text or "")) and 0 <= r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [r["target"], 0, 0, r["source_size"]])
        s[1] += r["taken"]
        s[2] = max(s[2], r["size"])
    assert sum(s[0] for s in by.values()) == pytest.approx(1.5 * total)
    for target, taken, longest, size in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= longest
    assert mixing.mix(empty).count() == 0


def test_characters_cut_in_part_go_whole(spark):
    shared = "\u00e9" * 40  # 80 bytes: the text below shares the second byte of the character before it
    rows = [(1, "\u00a9" + shared), (2, "x\ufffdy \u00e9z\u00e9" + shared + "\ufffd end")]
    got = {r["doc_id"]: r for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert bytes(got[1]["kept_text"]).decode() == rows[0][1] and bytes(got[2]["kept_text"]).decode() == "x\ufffdy \u00e9z\ufffd end"


def test_mixing_includes_by_weight(spark):
    # 30 sources of the same 420 sizes: how often documents of a size are in the sample, against their probability
    sizes = [4, 9, 25, 64, 100, 400] * 70
    rows = [(k * 420 + j, " ".join(["w"] * n), f"s{k:03d}") for k in range(30) for j, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by_target, seen = {}, []
    for r in got:
        by_target.setdefault(r["target"], {}).setdefault(r["size"], []).append(r["taken"] // r["size"])
    assert len(by_target) == 3
    for target, places in by_target.items():
        copies, rest = divmod(target, sum(sizes))
        level = next((x for x in np.linspace(0, 0.5, 50_001) if sum(min(1.0, x * int(n**0.5)) * n for n in sizes) >= rest - 0.01), 1.0)
        for n, taken in places.items():
            p = min(1.0, level * int(n**0.5)) if rest > 0.01 else 0.0
            seen.append(p)
            assert set(taken) <= {copies, copies + 1} and abs(np.mean(taken) - copies - p) < (0.08 if 0 < p < 1 else 1e-9), (target, n, p, np.mean(taken))
    assert sum(0.02 < p < 0.98 for p in seen) >= 6 and len(set(seen)) > 4


def test_toxicity(spark, empty):
    rng = random.Random(2)
    plain = ["one", "two", "three", "four", "five", "six"]
    rows = [(k, " ".join(rng.choices(plain, k=20) + (["vile" + rng.choice("abc")] if k % 5 == 0 else []))) for k in range(400)] + [(900, None), (901, ""), (902, "vilea")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels, F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    held = [k for k in range(400) if k % 4 == 2]
    assert np.mean([got[k]["predicted"] == int(k % 5 == 0) for k in held]) > 0.95
    assert got[900]["score"] == got[901]["score"] < 0.3 and got[902]["predicted"] == 1
    assert toxicity.score(empty, model).count() == 0
    unlearned = toxicity.train(frame, labels.limit(0), F.lit(True))
    assert toxicity.score(frame, unlearned).where("predicted = 1").count() == 0


def test_fingerprints(docs, empty):
    rows = [r for r in ROWS if r[0] is not None]
    got = {r["id"]: r for r in imatch.with_fingerprints(docs.where("doc_id is not null"), low=0.02, high=0.6).collect()}
    for k, (doc, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[doc]["n_chars"], got[doc]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[doc]["near_edited"] <= 1 and 0 <= got[doc]["near_next"] <= 1
    same = {got[d]["fingerprint"] for d, t, *_ in rows if t == TEXTS[0]}
    assert len(same) == 1 and imatch.with_fingerprints(docs).count() == len(ROWS)
    assert imatch.with_fingerprints(empty).count() == 0


def _brute_print(text, band):
    words = re.split(r"[\x20\x09-\x0D]+", _low(text))
    terms = sorted({w for w in words if w}, key=str.encode)
    digest = lambda own, n: hashlib.md5(" ".join(own).encode()).hexdigest()[:n] if own else ""
    held = [(w, xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in terms if w in band]
    out = []
    for k, rate in enumerate(imatch.RATES):
        out += [digest([w for w, h in held if ((h >> (12 * k)) & (rate - 1)) == j], 8) for j in range(imatch.SUBSETS)]
    return [*out, digest([w for w, _ in held] or terms, 16)]


def _brute_like(a, b):
    pairs = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


@pytest.mark.parametrize("rows_in_range", [2000, 3])
def test_fingerprints_against_brute_force(spark, rows_in_range):
    # ids in a dense run, far apart, one id in a third of the rows, and null ids
    texts = [t for t in TEXTS if not t or len(t) < 5000]
    rows = [(k, t) for k, t in enumerate(texts[:40])] + [(10**12 * k, t) for k, t in enumerate(texts[40:60], 1)] + [(77, f"{t} {k}") for k, t in enumerate(texts[:30])] + [(None, "null one"), (None, "null two")]
    got = imatch.with_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), low=0.05, high=0.5, rows_in_range=rows_in_range).collect()
    df = {}
    for _, t in rows:
        for w in {w for w in re.split(r"[\x20\x09-\x0D]+", _low(t)) if w}:
            df[w] = df.get(w, 0) + 1
    band = {w for w, c in df.items() if max(2.0, 0.05 * len(rows)) <= c <= 0.5 * len(rows)}
    signed = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64((t or "").encode(), seed=42).intdigest())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1])))
    want = []
    for (doc, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new, following = (_brute_print(x, band) for x in (t, edited, after))
        want.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), ".".join(own), ".".join(new), _brute_like(own, new), _brute_like(own, following)))
    assert band and sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_fingerprints_of_texts_without_lexicon_terms_differ(spark):
    texts = ["only here", "words apart", "HERE only", "", None, "common one", "common two", "common three"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["id"]: r for r in imatch.with_fingerprints(frame, low=0.3, high=1.0).collect()}
    prints = [got[k]["fingerprint"] for k in range(8)]
    assert len({prints[k] for k in (0, 1, 3, 5)}) == 4 and prints[0] == prints[2] and prints[3] == prints[4]
    assert got[0]["near_next"] < 1 and got[1]["near_next"] < 1 and got[3]["near_next"] == 1 == got[5]["near_next"]


@pytest.mark.parametrize("n", [0, 1, 1000, 40_000])
def test_fingerprint_band_is_exact(spark, n):
    terms = spark.range(400_000).select("id", F.concat(F.lit("t"), F.col("id")).alias("term"))
    marks = imatch.marks_of(terms.where(F.col("id") < n).select(F.xxhash64("term").alias("hash")))
    assert len(marks) <= 64 * max(1, n) + 16
    got = terms.where(imatch._in_band(F.col("term"), marks)).agg(F.count("*"), F.coalesce(F.max("id"), F.lit(-1))).first()
    assert tuple(got) == (n, n - 1)


def test_url_rules(spark):
    urls = ["http://A.org/x", "https://example.org/es/1", "http://sub.example.org/en/12?q", "http://a.com/fr/", "http://notcom/de/", "http://x.com/de/#f", None, "no scheme", "http://a.org", "http://a.net/q/", "http://a.net/q/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    train = spark.createDataFrame([("http://good.net/ok/1", 0), ("http://good.net/ok/2", 0), ("http://bad.net/spam/1", 1), ("http://bad.net/spam/2", 1), (None, None)], "url string, label int")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, train).collect()}
    assert [got[k]["rule"] for k in range(9)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", None, "com/de/", None, None, None]
    assert [got[k]["verdict"] for k in (0, 1, 2, 3, 5)] == ["allow", "block", "block", "allow", "block"]
    assert got[0]["host"] == "a.org" and got[2]["path"] == "/en/12" and got[6]["host"] == "" and got[8]["path"] == ""
    assert got[9]["verdict"] == got[10]["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in urlfilter.judge(pages.where("page_id = 9"), train.limit(0)).collect()} == {"allow"}


def test_url_classifier_on_held_out_words(spark):
    table = urlfilter.labelled_urls(spark)
    assert table.count() == 200 and urlfilter.judge(table.limit(0).withColumnRenamed("label", "page_id"), table).count() == 0
    # one form of every word is held out, then five words of each kind in all forms
    form = F.col("url").startswith("https://site.net/")
    words = F.col("url").rlike("|".join(urlfilter.BLOCKED_WORDS[::4] + urlfilter.ALLOWED_WORDS[::4]))
    for held, least in ((form, 0.9), (words, 0.6)):
        got = urlfilter.judge(table.where(held), table.where(~held), rules=()).collect()
        assert np.mean([(r["verdict"] == "block") == (r["label"] == 1) for r in got]) >= least


def test_warc_of_copies_and_null_ids(spark):
    rows = [(None, "u", "x"), (None, "v", "x"), (3, "u", "x"), (4, "u", "only"), (None, "u", "none"), (None, "u", "none"), (2, "u", "")] + [(100 + k, "u", "hot" * 50) for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()]
    want = [(None, 1, "revisit", 3)] * 2 + [(3, 1, "response", None), (4, 4, "response", None), (2, 0, "response", None)] + [(None, 4, "response", None)] * 2
    want += [(100, 150, "response", None)] + [(100 + k, 150, "revisit", 100) for k in range(1, 200)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    # short payloads are all responses
    assert {r["record_type"] for r in warc.round_trip(pages, least_bytes=1000).collect()} == {"response"}


def test_warc_round_trip(spark):
    noise = bytes(random.Random(1).randbytes(300)).decode("latin-1")
    rows = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (7, "u", noise + "\x1f\x8b\x08" + noise), (8, "u", "é" * 5000), (8, "u", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        payload = next((h or "").encode() for p, _, h in rows if p == r["page_id"])
        first = min(p for p, _, h in rows if (h or "").encode() == payload)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("step", [1, 7, 100, 5000])
def test_members_are_read_once_whatever_the_ranges(step):
    records = [warc.record(k, "u", bytes(random.Random(k).randbytes(400)), "d", 400, None) for k in range(6)]
    data = b"".join(records)
    read = lambda start, length: data[start : start + length]
    found = [at for low in range(0, len(data), step) for at, _ in warc.members(read, low, min(len(data), low + step), len(data), chunk=64)]
    assert found == np.cumsum([0] + [len(r) for r in records[:-1]]).tolist()


def test_hash_fold_of_ids():
    assert zlib.crc32(b"17") % 5 == zlib.crc32(str(17).encode()) % 5
    value, bounds = textblocks.shingles(textblocks.Words([b"a b c d e f", None, b"", b"a b"], textblocks.BLANK_SPLIT), 5)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1]


def test_a_row_that_repeats_without_end_teaches_once(spark):
    rows = [(k, f"one two three word{k}" + (" vile vile" if k % 5 == 0 else ""), "aa" if k % 2 else "bb") for k in range(200)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = once.union(once.where("doc_id = 10").join(spark.range(3000).select(F.lit(1)), how="cross").select(once.columns))
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    a, b = (toxicity.train(x, labels, F.lit(True), positive_rows=10**6, unlabelled_rows=10**6) for x in (once, often))
    assert a.bias == b.bias and (a.weights == b.weights).all()
    assert langid.train(once, doc_id="doc_id", text="text", lang="lang").keys() == langid.train(often, doc_id="doc_id", text="text", lang="lang").keys()
    assert langid.train(often, doc_id="doc_id", text="text", lang="lang")["bb"].count(b"word10\n") + langid.train(often, doc_id="doc_id", text="text", lang="lang")["bb"].count(b"word10 ") <= 1


def test_columns_of_results_replace_the_callers(spark):
    rng = random.Random(12)
    long = " ".join(rng.choices("katze hund maus lorem ipsum".split(), k=200_000))
    rows = [(k, t, "x", "y", "z", "w", "v") for k, t in enumerate(["katze hund", "lorem ipsum", "katze hund", "", None, long])] + [(0, "katze hund", "x", "y", "z", "w", "v")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens string, margin string, predicted string, base_score string")
    lang = frame.withColumn("lang", F.when(F.col("text").startswith("k"), "de").otherwise("la")).withColumn("lang_pred", F.lit("q")).withColumn("rejected", F.lit("q"))
    scored = lm.score(frame, F.lit(True))
    assert sorted(scored.columns) == sorted(["doc_id", "margin", "predicted", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    got = scored.collect()
    assert len(got) == 7 and len({r["score"] for r in got if r["doc_id"] in (0, 2)}) == 1 and max(r["n_tokens"] for r in got) == 200_001
    judged = langid.identify(lang, F.lit(True)).collect()
    assert len(judged) == 7 and len({(r["lang_pred"], r["score"]) for r in judged if r["doc_id"] in (0, 2)}) == 1
    assert {r["lang_pred"] for r in judged if r["doc_id"] in (3, 4)} == {"und"} and all(isinstance(r["rejected"], bool) for r in judged)
    marked = toxicity.score(frame, toxicity.Model(np.zeros(toxicity.BUCKETS, dtype=np.float32), 0.0)).collect()
    assert len(marked) == 7 and {(r["score"], r["predicted"]) for r in marked} == {(0.5, 1)}
