import math
import re
import random
import zlib
from collections import Counter, defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from facetry.llm import decontaminate, licenses, mixing, sharding, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"
EDGES = [(1, None, "en", "a", 0, "x", "y"), (2, "", "en", None, 0, "x", "y"), (None, "one two", "en", "a", 7, "x", "y"), (3, "dup text", "en", "b", 8, "x", "y"),
         (3, "dup text", "en", "b", 8, "x", "y"), (4, "word " * 20000, "de", "b", 100000, "x", "y"), (5, "ümlaut Ω", "de", "a", 8, "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, DOCS)


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 5, 17, 1000, 4099):
        got = sorted(r.p for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 7).alias("p")).collect())
        assert got == list(range(n))


def test_shards_are_even_and_gapless(spark, docs):
    rows = sharding.shard_rows(docs.unionByName(docs), 4).collect()
    assert len(rows) == 2 * len(EDGES)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = Counter((e[0], len((e[1] or "").encode()) + 1, zlib.crc32((e[1] or "").encode())) for e in EDGES * 2)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    again = sharding.shard_rows(docs.unionByName(docs).repartition(3), 4)
    assert sorted((r.row_number, r.place, r.text_crc32) for r in again.collect()) == sorted((r.row_number, r.place, r.text_crc32) for r in rows)
    assert sharding.shard_rows(docs.where(F.lit(False))).count() == 0


def water(sizes, weights, percent=150, repeats=2):
    total, full = sum(sizes) * percent / 100, set()
    while True:
        left = total - sum(repeats * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [repeats * sizes[i] if i in full else weights[i] * left / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if target[i] > repeats * sizes[i]} - full
        if not over:
            return target
        full |= over


def test_targets_fill_like_water(spark):
    for sizes in ([100, 100, 100], [10, 1000, 10, 500], [1, 1, 1, 1000], [5], [0, 7, 9], [0, 0]):
        rows = [(i, "w " * n, f"s{i}") for i, n in enumerate(sizes)]
        per = mixing.targets(mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))).orderBy("source").collect()
        want = water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]) if sum(sizes) else [0] * len(sizes)
        assert [r.target for r in per] == pytest.approx(want)


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (37 * i % 900), f"s{i % 5}" if i % 5 else None, "extra") for i in range(400)] + [(7, "w " * 259, "s2", "extra")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 5 * 128 for s in target)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert Counter((r.row_key, r.taken) for r in again) == Counter((r.row_key, r.taken) for r in got)


def test_mix_edges(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(EDGES) and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix_sources(docs.where(F.lit(False))).count() == 0
    assert all(r.taken == 0 for r in mixing.mix_sources(docs.where("text IS NULL OR text = ''")).collect())


@pytest.mark.parametrize("nodes", [1, 2, 3])
def test_top_k_is_exact(spark, nodes):
    import random
    rnd = random.Random(nodes)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(1000 + i, [0.5, -0.25, 0.5, 0.0, 0.1, 0.9]) for i in range(40)]
    rows += [(5000, None), (5001, [None, 1.0]), (5002, [float("nan"), 1.0]), (5003, [float("inf")]), (5004, [1.0, 1.0]), (None, [1.0]), (300, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 100 == 0, 10, nodes=nodes, per_pack=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    import numpy as np
    vectors = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    queries = [q for q in vectors if q[0] % 100 == 0]
    assert set(got) == {q[0] for q in queries}
    for qid, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in vectors if i != qid)[:10]
        assert got[qid] == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(topk.integer_vectors(df), F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(topk.integer_vectors(df.where(F.lit(False))), F.col("vec_id") % 100 == 0).count() == 0


def test_url_lists_as_of_the_fetch(spark):
    entries = spark.createDataFrame([("example.com", "block", date(2024, 1, 10)), ("example.com", "remove", date(2024, 2, 1)), ("example.com", "block", date(2024, 3, 1)),
                                     ("www.example.com/en", "allow", date(2024, 1, 15)), ("x.org", "block", date(2024, 1, 1)), ("x.org", "allow", date(2024, 1, 1)),
                                     (None, "block", date(2024, 1, 1)), ("y.org", None, date(2024, 1, 1)), ("z.org", "block", None)], "pattern string, action string, day date")
    cases = [(1, "https://www.example.com/en/1", date(2024, 1, 9), 0, None, "none"), (2, "https://www.example.com/fr", date(2024, 1, 10), 1, "example.com", "block"),
             (3, "http://u:p@WWW.example.com:80/en?x", date(2024, 1, 20), 2, "www.example.com/en", "allow"), (4, "http://example.com", date(2024, 2, 1), 0, None, "none"),
             (5, "http://notexample.com", date(2024, 3, 5), 0, None, "none"), (6, "http://x.org./", date(2024, 5, 5), 1, "x.org", "block"), (7, None, date(2024, 1, 1), 0, None, "none"),
             (8, "no address", date(2024, 1, 1), 0, None, "none"), (9, "http://example.com/a", None, 0, None, "none"), (10, "http://example.com", date(2024, 3, 1), 1, "example.com", "block"),
             (10, "http://example.com", date(2024, 3, 1), 1, "example.com", "block")]
    captures = spark.createDataFrame([c[:3] + ("clash",) for c in cases], "capture_id long, url string, fetched date, pattern string")
    got = urls.filter_urls(captures, entries).collect()
    assert Counter((r.capture_id, r.url, r.fetched, r.n_active, r.pattern, r.verdict) for r in got) == Counter(cases)
    assert {r.verdict for r in urls.filter_urls(captures, entries.where(F.lit(False))).collect()} == {"none"}
    assert urls.filter_urls(captures.where(F.lit(False)), entries).count() == 0


def test_decontamination_by_brute_force(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    items = [(1, item), (1, item), (2, "tiny item"), (3, None), (4, ""), (None, item), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    words = item.split()
    texts = [None, "", item, "filler " * 5000 + item.upper().replace(" ", "\n") + " filler" * 5000, " ".join(words[:14]), " ".join(words[:9]), "tiny item", "a tiny item here",
             "Alpha, beta; gamma: delta (epsilon) zeta-eta theta! x kappa", item, "alpha beta gamma delta epsilon zeta eta theta iota"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")

    def shingles(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = Counter()
    for i, t in enumerate(texts):
        for k, x in {k: x for k, x in items if k is not None}.items():
            s = shingles(x)
            if s and 100 * len(s & shingles(t)) >= 75 * len(s):
                want[i, k, len(s), len(s & shingles(t))] += 1
    table = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.n_item, r.n_found) for r in decontaminate.contained(docs, table).collect())
    assert got == want and {k[0] for k in got} >= {2, 3, 4, 6, 9, 10}
    assert decontaminate.contained(docs, table.where(F.lit(False))).count() == 0
    assert decontaminate.contained(docs.where(F.lit(False)), table).count() == 0


def test_candidates_of_the_sketch_are_verified(spark):
    """Documents of a sketch's shingles alone are candidates and no results; long items need several hits."""
    rng = random.Random(4)
    long = [f"w{i}" for i in range(200)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, "a b c d e f g h i j k l")], "item_id long, text string")
    wanted = decontaminate.item_shingles(items, 5, 75)
    rows = {r.item_id: r for r in wanted.groupBy("item_id").agg(F.max("n").alias("n"), F.max("need").alias("need"), F.count_if("sketched").alias("s")).collect()}
    assert (rows[1].n, rows[1].need, rows[1].s) == (196, 4, 196 - 147 + 4) and (rows[2].n, rows[2].need, rows[2].s) == (8, 1, 3)
    texts = [" ".join(long[:100]), " ".join(long[:155]), "a b c d e", "h i j k l", "c d e f g h i j k l x"]
    for _ in range(40):  # any 147 of the 196 shingles hold enough of the sketch
        cut = rng.randrange(0, 49)
        texts.append(" ".join(rng.sample("pqrst", 5) + long[cut:cut + 151]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = wanted.persist()
    candidates = decontaminate.candidates(docs, wanted, 5, True).count()
    found = {r.doc_id for r in decontaminate.contained(docs, items).collect()}
    assert found == {1, 4, *range(5, 45)} and candidates > len(found)


def scan(text):
    """The rules by brute force: all places, then suppression by every pair."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    norm = " " + " ".join(w) + " "
    found = []
    for r in licenses.rules() if any(g in (text or "").lower() for g in licenses.GATE) else []:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm):
            a = norm[:m.start()].count(" ") - 1
            found.append((a, a + m[0].count(" "), r))
    kept = [d for d in found if not any(e[2].priority < d[2].priority and e[0] <= d[0] and e[1] >= d[1] for e in found)]
    base = [d for d in found if d[2].base]
    return (len(w), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[2].label for d in base})),
            ",".join(sorted({d[2].label for d in base + kept})), max((licenses.CONFIDENCE[d[2].priority] for d in base + kept), default=0.0))


def test_license_rules_by_brute_force(spark):
    texts = [None, "", "MIT License", "mit license mit license", "the MIT, License. and Apache License; GNU General Public License v3 or later",
             "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: BSD-3-Clause", "general public license general public license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy", "all rights reserved", "no keyword here", "mitlicense submit license",
             "word " * 30000 + "MIT License" + " word" * 30000, "MIT License " * 400, "Ünder the mıt license", "released under the terms of the GNU Lesser General Public License 2.1"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(2, texts[2], "c"), (None, texts[2], "c")], "doc_id long, text string, labels string")
    got = licenses.scan_licenses(docs).collect()
    want = Counter((i, *scan(t)) for i, t in enumerate(texts)) + Counter([(2, *scan(texts[2])), (None, *scan(texts[2]))])
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got) == want
    assert licenses.scan_licenses(docs.where(F.lit(False))).count() == 0
    assert len(licenses.rules()) > 200


def test_license_gate_loses_no_rule(spark, monkeypatch):
    """A text per family, name and version, and per sentence, against the rules without any gate."""
    texts = [f"Released under {name.replace(' ', gap).upper()}{gap}{by}{v.replace(' ', '.')}, see there" for _, _, names, versions in licenses.FAMILIES for name in names for v in versions
             for gap, by in ((" ", ""), ("\n -", "v"), ("_", "Version "))]
    texts += [f"({name} {words})" for _, _, names, _ in licenses.FAMILIES for name in names for words in ("License", "licences")]
    texts += [f"SPDX-License-Identifier: {short.replace(' ', '-')}" for _, short, _, _ in licenses.FAMILIES]
    texts += [re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", pattern) for _, _, pattern in licenses.SENTENCES]
    texts += ["MPL", "sample 2.0", "mpl2.0", "MPLv2", "public\ndomain", "dedicated to the public\n domain"]
    with monkeypatch.context() as m:
        m.setattr(licenses, "GATE", ("",))
        want = [scan(t) for t in texts]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want[i], t
    assert all(w[5] for w in want[:-6]) and [bool(w[5]) for w in want[-6:]] == [False, False, False, False, False, True]


def test_url_entries_of_every_shape(spark):
    day = date(2024, 1, 1)
    names = ["a.com/x/y", "a.com/x", "HTTPS://u@B.org:443/Deep/er/path/#f", "Upper.NET", "intranet", "zz", "c.com/p?id=5", " d.com. ", "ftp://e.com", "f.com/", ""]
    entries = spark.createDataFrame([(n, "block", day) for n in names], "pattern string, action string, day date")
    want = {"http://a.com/x/y/z": (2, "a.com/x/y"), "http://www.a.com/x/": (1, "a.com/x"), "http://a.com/x/yy": (1, "a.com/x"), "http://a.com/xx": (0, None), "http://a.com//x": (0, None),
            "http://b.org/Deep/er/path?q#g": (1, "b.org/Deep/er/path"), "http://b.org/deep/er/path": (0, None), "http://b.org/Deep/er": (0, None), "http://w.upper.net/1": (1, "upper.net"),
            "https://intranet/home": (1, "intranet"), "http://any.where.zz": (1, "zz"), "http://c.com/p?id=5": (1, "c.com/p?id=5"), "http://c.com/p?id=55": (0, None), "http://c.com/p": (0, None),
            "http://d.com/a/b/c/d/e/f": (1, "d.com"), "http://e.com": (0, None), "http://ftp/e.com": (0, None), "http://f.com": (1, "f.com"), "http://[::1]/x": (0, None)}
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(want)], "capture_id long, url string, fetched date")
    assert {r.url: (r.n_active, r.pattern) for r in urls.filter_urls(captures, entries).collect()} == want
