"""Items wider than the usual five words."""

import numpy as np
import pytest

from orrery.llm import decontamination


@pytest.mark.parametrize("width", [6, 8, 13])
def test_items_wider_than_five_words(spark, width):
    rng = np.random.default_rng(width)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 500, n)]
    items = [(i, word(n)) for i, n in enumerate((3, 5, 6, 7, 8, 12, 13, 14, 30, 60, 90))]
    docs = [(i, word(20) + w + word(20)) for i, w in items] + [(100 + i, word(80)) for i in range(5)]
    shingles = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = {(d, i) for d, t in docs for i, w in items if len(shingles(w, k := min(width, len(w))) & shingles(t, k)) * 100 >= 80 * len(shingles(w, k))}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{key} bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(frame(docs, "doc_id"), frame(items, "item_id"), width).collect()}
    assert got == want and len(want) >= len(items)
