import hashlib
import random
import zlib

import numpy as np
import pytest

from facetry.llm import periodic_runs as pr

WIDE = "doc_id long, text string, n_words string, runs string"


def brute_runs(w, least=12):
    """Every run by its definition: maximal at its lag, least period of the stretch."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def brute_row(doc_id, text):
    words = text.encode().split() if text else []
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def found(words, least=12):
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return [tuple(map(int, r)) for r in zip(*pr.runs_of(np.array([names[w] for w in words], np.int64), least), strict=True)]


@pytest.mark.parametrize("least", [2, 3, 5, 12, 17])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for case in range(250):
        n, letters = rng.randrange(0, 90), rng.choice([1, 2, 3, 30])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 4:
                a, p = rng.randrange(n), rng.randrange(1, 30)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert found(words, least) == sorted(brute_runs(words, least), key=lambda r: (r[0], r[2])), (least, case, words)


def test_long_uniform_text_is_one_run():
    words = [0] * 200_000 + [1, 2] * 50_000
    assert found(words) == [(0, 200_000, 1), (200_000, 100_000, 2)]


def texts():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        size = rng.choice([0, 1, 5, 11, 12, 40, 300])
        base = [rng.choice("ab c d é 漢 gg X x".split()) + str(rng.randrange(rng.choice([1, 2, 40]))) for _ in range(size)]
        if rng.random() < 0.4 and size:
            base = base + base[-(size // 3 + 1):] * rng.randrange(2, 6)
        rows.append((i, rng.choice([" ", "\n", " \t", "\x0b"]).join(base)))
    rows += [(500, None), (501, ""), (502, " \n "), (None, "a b " * 20), (503, "w " * 30), (503, "w " * 30), (504, "x" * 5000), (505, " ".join(["a"] * 30)),
             (506, " ".join(f"w{i % 50}" for i in range(1500)))]
    return rows


def test_query_rows_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "p", "q") for r in rows], WIDE)
    got = pr.digests(pr.find_runs(pr.with_planted_periods(docs))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_row(*r)) for r in rows)


def test_pieces_do_not_change_results(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(pr, "PIECE_WORDS", 50)
    monkeypatch.setattr(pr, "PIECE_BYTES", 400)
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    out = [r for b in pr._found(12, ["doc_id"])([batch]) for r in b.to_pylist()]
    assert [r["doc_id"] for r in out] == [r[0] for r in rows]
    for row, (_, text) in zip(out, rows, strict=True):
        words = text.encode().split() if text else []
        assert [(r["start"], r["length"], r["period"]) for r in row["runs"]] == sorted(brute_runs(words), key=lambda r: (r[0], r[2]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pr.digests(pr.find_runs(pr.with_planted_periods(docs))).collect() == []
