"""The chain from log lines to transcripts, with its counters, against a line-by-line version."""

import re

import pytest

from corvane.functions import text as tx
from corvane.operators import transcripts

LINES = [
    ("a.wav", " Random Digit ", '"3"'), ("b.wav", "random digit", "7 and 4 (gloss 5)"), ("c.wav", "RANDOM DIGIT", "8"), ("d.wav", "TGL_x", "9 11"), ("e.wav", "CEB", '"(all gone) "'),
    ("f.wav", "CEB", '  "there are 12 of 100 and 5"  '), ("g.wav", None, "11a 9_ 19"), ("h.wav", "CEB", None), ("i.wav", "Random Digit", "(x)"), ("a.wav", "Random Digit", "13 3"), ("j.wav", "CEB", "tabs\tand   blanks"),
]
DIGITS = [("a.wav", "3", "three"), ("b.wav", "7", "se$v\\en"), ("i.wav", "1", "one")]


def _expected(mode):
    kept, n = [], dict.fromkeys(("lines", "written", "excluded_source", "digit_mode", "empty", *transcripts.DIGITS), 0)
    known, words = {f: (d, s) for f, d, s in DIGITS}, tx.number_words()
    for file, source, text in LINES:
        n["lines"] += 1
        entry = (source or "").strip().lower() == "random digit"
        if (source or "").startswith("TGL_"):
            n["excluded_source"] += 1
            continue
        if entry and mode == "exclude":
            n["digit_mode"] += 1
            continue
        text = (text or "").strip()
        if len(text) >= 2 and text[0] == text[-1] == '"':
            text = text[1:-1]
        text = re.sub(r"\s*\([^)]*\)", "", text)
        found = re.findall(r"\b[1-9]\b", text)
        if not entry:
            n["skipped"] += bool(found)
        elif file not in known:
            n["missing"] += len(found)
        else:
            n["replaced"] += len(found)
            n["mismatch"] += sum(d != known[file][0] for d in found)
            text = re.sub(r"\b[1-9]\b", lambda m: known[file][1], text)
        text = re.sub(r"\b\d+\b", lambda m: words.get(int(m[0]), m[0]) if not m[0].startswith("0") else m[0], text)
        text = re.sub(r"\s+", " ", text).strip()
        if text:
            kept.append((file, text))
        n["written" if text else "empty"] += 1
    return sorted(kept), n


@pytest.mark.parametrize("mode", ["include", "exclude"])
def test_lines_and_counters_come_from_one_pass(spark, mode):
    lines = spark.createDataFrame(LINES, "file string, source string, text string")
    kept, seen = transcripts.pipeline(lines, spark.createDataFrame(DIGITS, "file string, digit string, saying string"), excluded=("TGL_", "CEB_Utt"), digit_mode=mode)
    rows, counts = _expected(mode)
    assert sorted((r["file"], r["text"]) for r in kept.collect()) == rows
    assert seen.first().asDict() == counts
    with pytest.raises(ValueError):
        transcripts.cleaned(lines, lines, excluded=(), digit_mode="maybe")


def test_no_lines_have_counts_of_zero(spark):
    none = spark.createDataFrame([], "file string, source string, text string")
    kept, seen = transcripts.pipeline(none, spark.createDataFrame([], "file string, digit string, saying string"), excluded=())
    assert kept.count() == 0 and set(seen.first()) == {0}

