import hashlib
import os
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from facetry.llm import token_alignment as ta

WIDE = "doc_id long, text string, row string, pairs string"


@pytest.fixture(scope="module")
def libraries():
    byte = Tokenizer.from_file(os.path.join(ta.TOKENIZERS, ta.BYTE_BPE))
    byte.encode_special_tokens = True
    return byte, sentencepiece.SentencePieceProcessor(model_file=os.path.join(ta.TOKENIZERS, ta.PIECE_BPE))


@pytest.fixture(scope="module")
def sides():
    data = [open(os.path.join(ta.TOKENIZERS, name), "rb").read() for name in (ta.BYTE_BPE, ta.PIECE_BPE)]
    return ta.ByteTokens(data[0]), ta.PieceTokens(data[1])


def bytes_of_a(byte, i):
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {}, 0
    for b in range(256):
        if b in visible:
            table[chr(b)] = b
        else:
            table[chr(256 + n)] = b
            n += 1
    return bytes(table[c] for c in byte.id_to_token(i))


def bytes_of_b(piece, i):
    return bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()


def brute(texts, libraries):
    """Rows by plain loops over the tokens of the two libraries."""
    byte, piece = libraries
    rows, holds = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
            parts = [[bytes_of_a(byte, i) for i in a], [bytes_of_b(piece, i) for i in b]]
            if all(b"".join(p) == (" " + text).encode() for p in parts):
                ends = []
                for p in parts:
                    at, own = 0, []
                    for token in p:
                        at += len(token)
                        own.append(at)
                    ends.append(own)
                low = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(([i for i, e in zip(a, ends[0], strict=True) if low < e <= end], [i for i, e in zip(b, ends[1], strict=True) if low < e <= end]))
                    low = end
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        holds.update(set(links))
        rows.append((groups, links))
    top = Counter()
    for (x, _), n in holds.items():
        top[x] = max(top[x], n)
    out = []
    for groups, links in rows:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(holds[p] == top[p[0]] for p in links),
                    sum(holds[p] for p in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def texts():
    rng = random.Random(3)
    words = "the The straße naïve don't 漢字 Привет 🙂 🙂🙂 <|endoftext|> <s> </s> x=1; 12345 ... aaaaaaa café école <0x41> ▁   \x85 \x1c tab\there é ﬁ ½".split(" ")
    out = [None, "", " ", "  ", "\n\n", "a", " a", "a ", "▁a", "x" * 3000, " " * 500, "z\n" * 200, "9" * 777, "\x00", "the " * 400]
    for _ in range(60):
        out.append(rng.choice([" ", "  ", "\n", ""]).join(rng.choice(words) for _ in range(rng.randrange(1, 40))))
    return out + out[20:30]


@pytest.mark.parametrize("hot", [0, 40, 1 << 17])
def test_rows_equal_brute_force(spark, libraries, monkeypatch, hot):
    monkeypatch.setattr(ta, "HOT", hot)
    rows = [(None if i % 17 == 3 else i // 2, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(*r, "p", "q") for r in rows], WIDE).repartition(3)
    got = sorted(str(tuple(r)) for r in ta.alignment_links(docs).collect())
    want = sorted(str((r[0], *b)) for r, b in zip(rows, brute([t for _, t in rows], libraries), strict=True))
    assert got == want


def test_small_slices_of_pairs_give_the_same(sides, monkeypatch):
    monkeypatch.setattr(ta, "PAIRS", 3)
    a, b = ta.tokens_of(texts(), *sides)
    groups = ta.groups_of(a, b)
    few = ta.linked_pairs(a, b, groups)
    monkeypatch.setattr(ta, "PAIRS", 10 ** 6)
    assert all((x == y).all() for x, y in zip(few, ta.linked_pairs(a, b, groups), strict=True))


def test_overlaps_are_all_pairs_that_share_a_byte(sides):
    a, b = ta.tokens_of(texts(), *sides)
    got = set(zip(*map(list, ta.overlaps(a, b)), strict=True))
    want, at = set(), 0
    for i in range(len(a.ids)):
        while at < len(b.ids) and b.end[at] <= a.start[i]:
            at += 1
        j = at
        while j < len(b.ids) and b.start[j] < a.end[i]:
            want.add((i, j))
            j += 1
    assert got == want


def test_fast_reading_equals_the_library(sides, libraries):
    rng = random.Random(8)
    alphabet = [c for c in map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)])]
    common = list("  ''sstm eaion.\n\t12")
    for _ in range(1500):
        text = " " + "".join(rng.choice(common if rng.random() < 0.6 else alphabet) for _ in range(rng.randrange(60)))
        assert sides[0].fast.encode_ordinary(text) == libraries[0].encode(text, add_special_tokens=False).ids


def test_aligned_tokens(spark, libraries):
    rows = [(1, "naïve 🙂 text"), (2, None), (3, ""), (4, "the cat")]
    got = {r["doc_id"]: r for r in ta.align_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2]["a_ids"] == got[3]["groups"] == []
    for i, text in (rows[0], rows[3]):
        r = got[i]
        assert r["a_ids"] == libraries[0].encode(" " + text, add_special_tokens=False).ids and r["b_ids"] == libraries[1].encode(text)
        assert (r["groups"][-1]["a_end"], r["groups"][-1]["b_end"]) == (len(r["a_ids"]), len(r["b_ids"]))
        assert {p["a"] for p in r["overlaps"]} == set(range(len(r["a_ids"]))) and {p["b"] for p in r["overlaps"]} == set(range(len(r["b_ids"])))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ta.alignment_links(none).collect() == [] and ta.align_tokens(none).collect() == []
