"""What a task of the pipeline holds at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from facetry.llm import shingles, toxicity


def test_shingles_of_many_texts_take_memory_for_a_slice_of_them():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    texts = pa.array([" ".join(rng.choice(words, 400)) for _ in range(2000)] + [None, "", "one two"])
    whole = shingles._shingles(texts)
    tracemalloc.start()
    got = shingles.shingle_sets(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(whole) and all((a == b).all() for a, b in zip(got, whole, strict=True))
    held = sum(s.nbytes for s in got)
    assert peak < held + 60 * shingles.HASHED, (peak, held)
    assert [len(s) for s in shingles.shingle_sets(texts.slice(1999))] == [len(s) for s in got[1999:]]


def test_words_are_kept_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 10)
    models = [toxicity.Linear(np.arange(1 << toxicity.BITS, dtype=float), np.zeros(c), 0.0) for c in range(2)]
    kept = toxicity.Margins(models)
    first = {w: kept[w] for w in (b"word%d" % i for i in range(40))}
    assert len(kept) <= 10
    assert all(kept[w] == v == (sum(toxicity.numbers(w)),) * 2 for w, v in first.items())
