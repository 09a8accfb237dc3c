import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from paperweave.llm.words import slices, window_starts, windows, words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x1c\xa0z", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = words_of(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        got = [words.text(j).decode() for j in range(words.first[i], words.first[i + 1])]
        assert got == re.findall(r"[^\x20\x09-\x0D]+", text or "")
    assert len(set(words.hash.tolist())) == len({words.text(j) for j in range(len(words.start))})


def test_windows_tell_order_and_ends():
    words = words_of(pa.array(["a b c a b", "c a b"]))
    runs = windows(words.hash, 2)
    starts, text = window_starts(words.first, 2)
    assert starts.tolist() == [0, 1, 2, 3, 5, 6] and text.tolist() == [0, 0, 0, 0, 1, 1]
    found = runs[starts]
    assert found[0] == found[3] == found[5] and found[1] != found[0] and found[2] == found[4]


def test_slices_keep_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], ["text"])
    parts = list(slices([batch], "text", 12))
    assert [p.num_rows for p in parts] == [2, 1, 1]
    assert np.concatenate([p["text"].to_pylist() for p in parts]).tolist() == batch["text"].to_pylist()
