import hashlib
import math
import re
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetry.llm import language_model, mixing, ngram_join, phrases, repeats, toxicity
from facetry.llm.eliasfano import EliasFano, Trie

WIDE = "doc_id long, text string, uid string, row string"


def sequence(values):
    head, parts = EliasFano.encode(np.array(values, np.int64))
    return EliasFano(*head, *parts)


def test_elias_fano_gets_and_finds():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (2, 1), (500, 40), (500, 10 ** 6), (3000, 2 ** 61)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = sequence(values)
        assert (ef.get(np.arange(n)) == values).all()
        target = np.concatenate((values, values + 1, rng.integers(0, top + 2, 200)))
        low = rng.integers(0, n, len(target))
        high = low + rng.integers(0, n + 1 - low)
        at, value = ef.successor(target, low, high)
        for t, a, b, i, v in zip(target, low, high, at, value, strict=True):
            inside = [j for j in range(a, b) if values[j] >= t]
            assert (i, v) == ((inside[0], values[inside[0]]) if inside else (b, -1))


def test_trie_finds_pairs_and_nothing_else():
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 2 ** 62, 40)[rng.integers(0, 40, 900)], rng.integers(0, 2 ** 39, 60)[rng.integers(0, 60, 900)], strict=True)})
    words = np.unique([p[0] for p in pairs])
    first = np.searchsorted([p[0] for p in pairs], np.append(words, 2 ** 63 - 1))
    before = np.array([p[1] for p in pairs])
    logs = rng.uniform(-9, 0, len(pairs))
    trie = Trie(words, rng.uniform(-9, 0, len(words)), first, before, logs)
    for a in words:
        for b in np.unique(before):
            at = trie.pair(trie.word(np.array([a])), trie.context(np.array([b])))[0]
            assert (at >= 0) == ((a, b) in set(pairs))
            if at >= 0:
                assert abs(trie.log(1, np.array([at]))[0] - logs[pairs.index((a, b))]) < 1e-3
    assert trie.word(np.array([5])).tolist() == [-1]
    empty = Trie(words[:0], logs[:0], np.zeros(1, np.int64), before[:0], logs[:0])
    assert empty.word(words[:3]).tolist() == [-1, -1, -1]


def model(rows, mass):
    """Scores of the bigram model by plain counting."""
    kept = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    one, two, texts = Counter(), Counter(), 0
    for (_, w), h in zip(kept, held, strict=True):
        if not h:
            one.update(w)
            two.update(zip(["<"] + w[:-1], w, strict=True))
            texts += 1
    total = sum(one.values()) + 0.5 * (len(one) + 1)
    out = []
    for (d, w), h in zip(kept, held, strict=True):
        score, last = 0.0, "<"
        for x in w:
            score += math.log10((two[last, x] + mass * (one[x] + 0.5) / total) / ((texts if last == "<" else one[last]) + mass))
            last = x
        out.append((d, h, len(w), sum(one[x] > 0 for x in w), sum(one.values()), sum(math.log10((one[x] + 0.5) / total) for x in w), score))
    return out


@pytest.mark.parametrize(("per_shard", "piece"), [(10 ** 6, 1 << 19), (300, 64)])
def test_language_model_by_brute_force(spark, monkeypatch, per_shard, piece):
    """Many shards split the frequent words; short pieces cut texts."""
    monkeypatch.setattr(language_model, "PIECE", piece)
    rng = np.random.default_rng(2)
    vocabulary = ["The", "of", "and"] * 20 + [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 80)))) for i in range(120)] + [(None, "The of"), (3, None), (4, ""), (4, ""), (9, "The\tÉ " * 500)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], WIDE).repartition(3)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score_texts(docs, 50.0, per_shard).collect())
    want = sorted((str(r[0]), *r[1:]) for r in model(rows, 50.0))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], abs=1e-4) and g[6] == pytest.approx(w[6], abs=2e-4 * w[2])


def test_language_model_without_rows_to_learn_from(spark):
    docs = spark.createDataFrame([(6, "a b", "x", "y")], WIDE)
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][0]
    got = language_model.score_texts(docs.withColumn("doc_id", F.lit(held).cast("long"))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)]
    assert language_model.score_texts(docs.where(F.lit(False))).count() == 0


def removed(texts, span):
    """Spans by looking at every window of every text."""
    seen = Counter(b[p:p + span] for b in texts for p in range(len(b) - span + 1))
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen[b[p:p + span]] > 1:
                cover[p:p + span] = b"\1" * span
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("piece", [3_000_000, 150])
def test_repeats_by_brute_force(spark, monkeypatch, piece):
    """Small pieces cut texts and spread copies over pieces."""
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdeé \n"), n))
    passages = [word(n) for n in (45, 60, 90, 200)]
    texts = [None, "", "short", "x" * 300, "x" * 70, "ab" * 90, word(300), passages[3], passages[3], passages[3][:61]]
    for i in range(60):
        p = passages[i % 4]
        a = int(rng.integers(0, 20))
        texts.append(word(int(rng.integers(0, 60))) + p[a:a + int(rng.integers(30, 200))] + word(int(rng.integers(0, 60))))
    docs = spark.createDataFrame([(i, t, "u", "r") for i, t in enumerate(texts)], WIDE).repartition(3)
    want = removed([(t or "").encode() for t in texts], 60)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, 60, 20).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 2000


def test_repeats_edges(spark):
    text = "one row twice, and no other text in the table has any of this, so it goes whole"
    docs = spark.createDataFrame([(1, text, "u", "r"), (1, text, "u", "r"), (None, "another", "u", "r")], WIDE)
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs, 60, 20).collect())
    assert got == [("1", len(text), 1), ("1", len(text), 1), ("None", 0, 0)]
    assert repeats.remove_repeats(docs.where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, 30, 20)


def test_triggers_depend_on_the_window_alone():
    rng = np.random.default_rng(5)
    core = rng.integers(97, 103, 80).astype(np.uint8)
    places = []
    for _ in range(20):
        data = np.concatenate((rng.integers(97, 103, rng.integers(0, 90)), core, rng.integers(97, 103, rng.integers(0, 90)))).astype(np.uint8)
        found = phrases.parse(data, np.array([len(data)]), 80, 30)
        start = next(i for i in range(len(data)) if (data[i:i + 80] == core).all())
        at = np.nonzero((found.low <= start) & (found.high >= start))[0]
        assert len(at) == 1
        places.append((int(found.trigger[at[0]] - start), int(found.key[at[0]])))
    assert len(set(places)) == 1


def toxic_rows(rng, n, first=0):
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(first, first + n):
        bad = i % 7 == 0
        w = list(rng.choice(words, 40)) + (list(rng.choice(["vile", "filth", "scumbag"], 3)) if bad else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_chain_on_held_out_rows(spark):
    rng = np.random.default_rng(6)
    rows = toxic_rows(rng, 900)
    extra = [(10_000, None, 0), (10_001, "", 0), (10_002, "Vile, FILTH! " * 4000, 1), (10_002, "Vile, FILTH! " * 4000, 1), (None, "word1 word2", 0)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t, _ in rows + extra], "doc_id long, text string, p_toxic string")
    marks = [(d, 1, x) for d, _, x in rows if d < 600] + [(0, 1, 1), (None, 1, 1), (5, None, 1), (7, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {d: x for d, _, x in rows}
    unseen = [r for r in got if r.doc_id is not None and 600 <= r.doc_id < 10_000]
    assert sum(r.is_toxic != bool(truth[r.doc_id]) for r in unseen) <= 0.02 * len(unseen)
    assert [r.is_toxic for r in got if r.doc_id in (10_000, 10_001, 10_002) or r.doc_id is None].count(True) == 2
    none = toxicity.score_toxicity(docs, labels.where(F.lit(False))).collect()
    assert not any(r.is_toxic for r in none)
    assert toxicity.score_toxicity(docs.where(F.lit(False)), labels).count() == 0


def test_later_models_see_out_of_fold_probabilities():
    """The second category equals the first one's label; the chain's weight carries it."""
    rng = np.random.default_rng(7)
    n = 400
    row = np.repeat(np.arange(n), 6)
    y = (np.arange(n) % 3 == 0).astype(float)
    feature = np.sort(np.where(rng.random((n, 6)) < 0.4, np.where(y[:, None] == 1, 11, 12), rng.integers(100, 400, (n, 6))), axis=1).ravel()
    models, cuts = toxicity.fit_chain(row, feature, np.column_stack((y, y)), rng.integers(0, 3, n))
    assert len(models) == 2 and models[0].chain.size == 0 and models[1].chain[0] > 0 and all(0 < c <= 1 for c in cuts)


def write(spark, tmp_path, docs, labels, benchmark):
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
                               ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against plain Python over what its predecessor kept."""
    from test_native import water
    from test_ngram_join import jaccard_components
    rng = np.random.default_rng(8)
    rows = toxic_rows(rng, 300)
    item = " ".join(f"question{i}" for i in range(30))
    texts = [(d, t) for d, t, _ in rows] + [(400 + i, " ".join(f"base{(i % 4) * 100 + j}" for j in range(50)) + (f" tail{i}" if i > 3 else "")) for i in range(24)]
    texts += [(500, item), (501, "intro " * 300 + item + " outro"), (502, None), (503, ""), (504, "two words"), (504, "two words"), (None, "no id here at all, not one")]
    docs = [(d, t, "en", f"s{(d or 0) % 3}" if d != 503 else None, len(t or "")) for d, t in texts]
    labels = [(d, 1, x) for d, _, x in rows if d < 200]
    write(spark, tmp_path, docs, labels, [(1, item)])
    sf, at, seen = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    before = at
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        out.write.parquet(f"{tmp_path}/out-{name}")
        before, at = at, spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = (before.collect(), at.collect())
        if name != "sharding":
            assert at.columns == before.columns
    got, kept = seen["toxicity"]
    bad = {d for d, _, x in rows if x}
    assert sum((r.doc_id in bad) != (r not in kept) for r in got) <= 4
    got, kept = seen["ngram_join"]
    _, group = jaccard_components([r.text for r in got])
    least = {}
    for r, g in zip(got, group, strict=True):
        least[g] = min(least.get(g, 10 ** 9), r.doc_id if r.doc_id is not None else 10 ** 9)
    want = {(r.doc_id, r.text) for r, g in zip(got, group, strict=True) if not (r.text or "").split() or r.doc_id in (None, least[g])}
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)
    got, kept = seen["decontamination"]
    assert Counter(kept) == Counter(r for r in got if r.doc_id not in (500, 501))
    got, kept = seen["mixing"]
    size, total = Counter(), Counter()
    for r in got:
        size[r.source] += len((r.text or "").split())
    for r in kept:
        total[r.source] += len((r.text or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, water([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True):
        assert abs(total[s] - t) <= 0.12 * t + 400
    assert max(Counter((r.doc_id, r.text) for r in kept).values()) <= 2 and set(kept) <= set(got)
    got, kept = seen["sharding"]
    counts = Counter(r.shard for r in kept)
    assert sum(counts.values()) == len(got) and max(counts.values()) - min(counts.values()) <= 1


def test_pipeline_runs_and_takes_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert ngram_join.BLOCK and mixing.WEIGHTS


def test_near_copies_by_component_and_not_by_id(spark):
    base = [" ".join(f"{w}{i}" for i in range(50)) for w in "abcd"]
    rows = [(7, base[0]), (7, base[1]), (8, base[0] + " tail"), (9, base[1] + " tail"), (None, base[2]), (None, base[2]), (None, base[2] + " tail"), (None, base[3]), (6, base[3] + " tail"), (None, " "), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies_out(spark, docs, "").collect())
    one = [k for k in kept if k in rows[4:7]]
    assert len(one) == 1 and kept == Counter([(7, base[0]), (7, base[1]), (6, base[3] + " tail"), (None, " "), (None, None), *one])


def test_repeated_ids_weigh_once_in_the_sample(spark):
    rows = [(d, t) for d, t, _ in toxic_rows(np.random.default_rng(9), 120)]
    labels = spark.createDataFrame([(d, 1, x) for d, _, x in toxic_rows(np.random.default_rng(9), 120)], "doc_id long, quality int, toxic int")
    fit = lambda more: toxicity.train(spark.createDataFrame(rows + more, "doc_id long, text string"), labels)
    (once, cuts), (often, same) = fit([]), fit([rows[0]] * 300)
    assert cuts == same and all((a.weights == b.weights).all() and a.bias == b.bias for a, b in zip(once, often, strict=True))


def test_scores_of_the_chain_by_plain_sums(spark):
    """Every probability from its model's weights, word by word; no feature is left out by number."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{rng.integers(0, 60)}" for _ in range(rng.integers(0, 40))) + (" vile Grimm" if i % 3 == 0 else " kind")) for i in range(150)]
    rows += [(None, "vile"), (900, None), (901, ""), (3, "word " * 100_000 + "vile grimm")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, row_key string, p_toxic double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    models, cuts = toxicity.train(docs, labels)
    cache = toxicity.Words()
    got = sorted((str(r.doc_id), round(r.p_low_quality, 9), round(r.p_toxic, 9), r.is_toxic) for r in toxicity.score_toxicity(docs, labels).collect())
    want = []
    for doc_id, text in rows:
        words = {w for w in re.split(rb"[^0-9a-z\x80-\xff]+", (text or "").encode().lower()) if w}
        earlier = []
        for m in models:
            margin = sum(float(m.weights[f]) for w in words for f in cache[w]) + m.bias + sum(a * b for a, b in zip(m.chain, earlier, strict=True))
            earlier.append(1 / (1 + math.exp(-margin)))
        want.append((str(doc_id), round(earlier[0], 9), round(earlier[1], 9), earlier[1] >= cuts[1]))
    assert got == sorted(want)
    assert sum(r[3] for r in got) >= 50


def test_every_sure_feature_is_used():
    """3,000 features that tell the labels apart: all of them get a weight."""
    n, each = 400, 3000
    y = np.arange(n) % 2 == 0
    feature = np.concatenate([np.arange(each) + (0 if v else 10_000) for v in y])
    model = toxicity.fit(np.repeat(np.arange(n), each), feature, np.zeros((n, 0)), y.astype(float), steps=5)
    assert (model.weights[:each] != 0).all() and (model.weights[10_000:10_000 + each] != 0).all()


def test_shard_sends_only_rows_it_has(spark):
    """Sums of a shard grow with its events and not with the rows of the pieces it meets."""
    sizes = []
    for n in (1, 2, 4):
        rows = spark.createDataFrame([(i, f"a{i} b{i % 50} c{i % 7}") for i in range(1500 * n)], "doc_id long, text string").coalesce(1)
        seen = []
        keep = language_model._shard_scores

        def spy(held, known, total, mass):
            for piece, data in keep(held, known, total, mass):
                seen.append(len(data))
                yield piece, data
        events = rows.select(F.col("doc_id"), F.col("doc_id").alias("uid"), "text", language_model.held_out(F.col("doc_id")).alias("held_out"))
        shards = 8 * n
        empty = (np.zeros(0, np.int64), np.ones(0, np.int64))
        split = spark.sparkContext.broadcast(empty)
        held = {}
        for r in events.mapInArrow(language_model._dealt(shards, split), language_model.EVENTS).collect():
            if r.shard >= 0:
                held.setdefault(r.shard, []).append({c: bytes(r[c]) if c not in ("piece",) else r[c] for c in ("piece", "words", "parents", "befores", "pairs", "docs", "times", "info")})
        for group in held.values():
            list(spy(group, empty, 1000.0, 1000.0))
        sizes.append(sum(seen))
    assert sizes[1] < 2.3 * sizes[0] and sizes[2] < 2.3 * sizes[1]


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    """Columns named as a stage's own come back with their values."""
    extra = ("_row", "_words", "_times", "_copy", "row_key", "size", "_row_")
    rows = [(i, f"some words of text number {i} and a few more to tell it apart", "en", "ab"[i % 2], 60, *[f"{c}{i}" for c in extra]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands anywhere at all today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.collect()]
        assert got and all(r == want[r[0]] for r in got), name


def test_pipeline_leaves_its_result_alone(spark, tmp_path):
    """Tables between the stages are gone when the pipeline is done."""
    from facetry.runtime import checkpoint_dir
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    new = [n for n in os.listdir(folder) if n not in before]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["sharding"]
