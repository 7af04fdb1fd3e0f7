import collections
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelframe.llm.stats import counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Éé\n\t#!.😀\x0b1", max_size=60)), min_size=1, max_size=8)


def brute(text):
    x = text or ""
    w = WORD.findall(x)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [y for y in x.split("\n") if WORD.search(y)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in x),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_distinct": len(set(w)),
        "n_adjacent": sum(a == b for a, b in zip(w, w[1:], strict=False)),
        "n_chars_": len(x),
    }


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_counts(texts):
    got = counts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert {k: int(got[k][i]) for k in brute(t)} == brute(t)


def test_long_words_and_texts():
    texts = ["x" * 3_000_000, "a b " * 400_000, ""]
    got = counts(pa.array(texts))
    assert [int(v) for v in got["n_words"]] == [1, 800_000, 0]
    assert [int(v) for v in got["n_repeat_words"]] == [0, 800_000, 0]


def test_no_rows():
    assert all(len(v) == 0 for v in counts(pa.array([], pa.string())).values())
