"""Joins and searches, against brute force."""

import itertools
import random

import numpy as np
import pytest

from geoloom.llm import ann, components, decontaminate, line_dedup, ngram_join, packing, queries, text
from geoloom.llm.store import bitmap, hit


def near_copies(seed, n, base_words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, base_words))]
        out.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    return out


@pytest.fixture(scope="module")
def small(spark):
    texts = [" ".join(w) for w in near_copies(5, 60)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, "Two words", "x"), (903, "two words!", "x"), (None, texts[0], "x"), (0, texts[0], "again"), (0, texts[0], "again"), (905, "...", "x"), (906, "!!!", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string")


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute_links(rows):
    sets = [text.plain_shingles(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(doc), str(min(ids)) if ids else "None", links[i]))
    return sorted(out)


@pytest.mark.parametrize("block", [1500, 2])
def test_ngram_join(small, spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", block)
    for table in (small, queries.table(spark, sf_dir, "documents")):
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in ngram_join.link_documents(table).collect())
        assert got == brute_links(rows)
    assert ngram_join.link_documents(small.where("false")).count() == 0


def test_keep_one(small):
    got = ngram_join.keep_one(small).collect()
    expected = {int(d) for d, c, n in brute_links([(r.doc_id, r.text) for r in small.collect()]) if d != "None" and (n == 0 or d == c)}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(expected)
    assert small.columns == got[0].__fields__


def test_bands_reach_the_recall():
    for t, recall in ((0.8, 0.999), (0.5, 0.95), (0.9, 0.99)):
        bands, rows = ngram_join.bands_for(t, recall)
        assert 1 - (1 - t**rows) ** bands >= recall


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in edges} | {b for a, b in edges}
    assert got == {n: r for n, r in root.items() if n in alone and any(n in e and e[0] != e[1] for e in edges)}


def test_bitmap(spark):
    values = [-(1 << 62), 17, 5, 1 << 61, -1]
    bits = bitmap(spark.createDataFrame([(v,) for v in values], "h long"), "h")
    assert hit(bits, np.array(values)).all() and not hit(bits, np.array([6, 18])).any()


def brute_lines(rows, threshold=0.8):
    """{(doc_id, text): text without the lines that go} of distinct rows."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    lines = []
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            w = frozenset(text.plain_words(line))
            if w:
                lines.append((d, t, n, w))
    gone = set()
    for j, (d, t, n, w) in enumerate(lines):
        if any(len(w & v) / len(w | v) >= threshold - 1e-12 for _, _, _, v in lines[:j]):
            gone.add((d, t, n))
    return {(d, t): None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, t, n) not in gone) for d, t in docs}


def test_line_dedup(spark, sf_dir):
    rng = random.Random(4)
    lines = [" ".join(w) for w in near_copies(9, 80, 14)]
    rows = []
    for i in range(70):
        own = [rng.choice(lines) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(own + [""] * (i % 3)), "k"))
    rows += [(200, None, "k"), (201, "", "k"), (202, "\n\n...\n", "k"), (None, rows[3][1], "k"), (3, rows[3][1], "k"), (203, "a b c d", "k"), (204, "a b c d e", "k"), (205, "e d c b a", "k")]
    small = spark.createDataFrame(rows, "doc_id long, text string, n_lines_removed string")
    table = queries.table(spark, sf_dir, "documents").select("doc_id", "text")
    for docs in (small, table):
        given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        expected = brute_lines(given)
        got = line_dedup.dedup_documents(docs).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(expected[d, t])) for d, t in given)
    out = line_dedup.dedup_documents(small, drop_emptied=True)
    assert out.where("doc_id = 205").count() == 0 and out.where("doc_id in (200, 201, 202)").count() == 3
    assert line_dedup.dedup_documents(small.where("false")).count() == 0


def rows_scanned(spark, run):
    """Rows that the stages of run() read from files."""
    sc = spark.sparkContext._jsc.sc()

    def seen():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    before = seen()
    run()
    return seen() - before


def test_line_dedup_splits_texts_once(spark, tmp_path):
    line, n = "one two three four five six", 3000
    spark.range(n).selectExpr("id as doc_id", f"'{line}' as text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = []
    scanned = rows_scanned(spark, lambda: kept.extend(line_dedup.kept_lines(docs).collect()))
    assert [(r.doc_id, r.line) for r in kept] == [(0, 0)]
    assert n <= scanned < 2 * n  # once to count words and to make sets; no pairs, so no text again


def test_line_dedup_order(spark):
    """Near copies in a group larger than what is compared first, last documents given first, a null id, more words than two bytes name."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(40)]
    lines = [" ".join(w if rng.random() > 0.05 else f"x{rng.randint(0, 30)}" for w in base) for _ in range(90)]
    rows = [(90 - i, f"{x}\n{' '.join(base[: 5 + i % 30])}") for i, x in enumerate(lines)]
    rows += [(None, lines[5]), (-3, lines[6] + "\nfew"), (101, " ".join(f"v{i}" for i in range(70_000)) + "\n" + lines[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_documents(docs).collect()
    assert {(r.doc_id, t): r.text for r in got for d, t in rows if d == r.doc_id} == brute_lines(rows)
    assert sum(r.n_lines_removed for r in got) > 100


def brute_items(docs, items, threshold=0.8):
    sets = [(i, text.plain_shingles(t), len(text.plain_words(t))) for i, t in items if text.plain_words(t)]
    out = []
    for d, t in docs:
        words = text.plain_words(t)
        for i, s, n in sets:
            own = text.plain_shingles(t) if n >= 5 else {tuple(words[j : j + n]) for j in range(len(words) - n + 1)}
            if len(s & own) / len(s) >= threshold:
                out.append((str(d), str(i), len(s & own), len(s)))
    return sorted(out)


def test_decontamination(spark, sf_dir):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [pick(n) for n in (4, 5, 6, 9, 13, 14, 30, 55, 120, 700, 1, 2)]
    rows = []
    for i in range(60):
        item = items[i % len(items)]
        item = item if i % 3 else [w if rng.random() > 0.03 else "changed" for w in item]
        rows.append((i, " ".join(pick(rng.randint(0, 900)) + item + pick(rng.randint(0, 900)))))
    rows += [(100, None), (101, ""), (102, "few words"), (None, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as n_shared")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (3, " ".join(items[3]))], "item_id long, text string")
    got = decontaminate.find_items(docs, bench).collect()
    given = [(i, " ".join(w)) for i, w in enumerate(items)]
    assert sorted({(str(r.doc_id), str(r.item_id), r.n_shared, r.n_shingles) for r in got}) == sorted(set(brute_items(rows, given)))
    clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert clean == {d for d, t in rows} - {int(d) if d != "None" else None for d, *_ in brute_items(rows, given)}
    assert decontaminate.find_items(docs.where("false"), bench).count() == 0
    assert decontaminate.find_items(docs, bench.where("false")).count() == 0
    table, real = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    got = sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_shingles) for r in decontaminate.find_items(table, real).collect())
    assert got == brute_items([(r.doc_id, r.text) for r in table.collect()], [(r.item_id, r.text) for r in real.collect()])


def brute_nearest(rows, asked, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in ok:
        if q in asked:
            scored = sorted((-float(v @ w / np.sqrt((v @ v) * (w @ w))), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [i for _, i in scored[:k]]
    return out


def test_nearest(spark, sf_dir):
    vectors = queries.table(spark, sf_dir, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    exact = brute_nearest(rows, {i for i, _ in rows if i % 50 == 0})
    got = {}
    for r in queries.op3_nearest_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got.keys() == exact.keys()
    assert np.mean([len(set(got[q]) & set(exact[q])) / 5 for q in exact]) >= 0.9


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as query_id")
    got = {}
    for r in ann.nearest(df, df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [1, 2, 10], 1: [0, 2, 10], 2: [0, 1, 10], 3: [0, 1, 2], 10: [0, 1, 2]}
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from geoloom.llm import toxicity

    docs = queries.table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in toxicity.score_documents(docs, toxicity.train(docs, queries.table(spark, sf_dir, "labels"))).collect() if r.predicted == 0}
    cleaned = brute_lines([(d, rows[d]) for d in kept])
    has = lambda t: any(text.plain_words(t))
    left = {d: c for (d, t), c in cleaned.items() if has(c) or not has(t)}
    left = {int(d): left[int(d)] for d, c, n in brute_links(list(left.items())) if n == 0 or d == c}
    bench = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    left = {d: t for d, t in left.items() if str(d) not in {x[0] for x in brute_items([(d, t)], bench)}}
    expected = packing.pieces(spark.createDataFrame(list(left.items()), "doc_id long, text string"), queries.tokenizer_path(queries.PACKING_TOKENIZER))
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(got.select(key).collect()) == sorted(expected.select(key).collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null, empty, repeated, very long and clashing rows through every stage, and empty tables."""
    import corpus_pipeline

    line = " ".join(f"w{i}" for i in range(30))
    item = " ".join(f"bench{i}" for i in range(20))
    rows = [(0, None), (1, ""), (2, line), (3, line), (4, line + " changed"), (5, "a\nb c d\n" + line), (6, "x " * 50 + item + " y" * 50), (7, "..."), (8, " ".join(f"long{i}" for i in range(60_000))), (None, "no id at all"), (2, line), (9, "short one")]
    rows = [(i, t, "en", "s", len(t) if t else 0, "clash") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, th string")
    tables = {"documents": docs, "benchmark": spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string"), "labels": spark.createDataFrame([(2, 1, 0), (9, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")}
    full, empty = str(tmp_path / "full"), str(tmp_path / "empty")
    for name, df in tables.items():
        df.write.parquet(f"{full}/{name}.parquet")
        df.where("false").write.parquet(f"{empty}/{name}.parquet")
    kept = spark.read.parquet(f"{full}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), full).count() == 0, name
        kept = corpus_pipeline.settle(lambda stage=stage, kept=kept: stage(spark, kept, full))
        assert kept.columns == docs.columns, name
    left = {r.doc_id: r.text for r in kept.collect()}
    assert set(left) == {0, 1, 2, 5, 7, 8, None, 9} and left[2] == line and left[5] == "a\nb c d"
    out = corpus_pipeline.run(spark, full)
    lengths = {}
    for r in out.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert set(lengths) == set(left) and lengths[0] == lengths[1] == 1 and lengths[8] > 60_000
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_ties_beyond_the_first_candidates(spark):
    """24 scaled copies of one direction have equal scores: the smallest vec_ids come first."""
    rows = [(i, [float(2 ** ((7 * i) % 24)), 0.0, 0.0]) for i in range(24)] + [(100 + i, [0.0, 1.0, float(i)]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(999, [3.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(vectors, asked, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_recall_over_several_shards(spark):
    """6,000 vectors in six shards, some of them scaled or exact copies, against brute force."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    base[4000:4400] = base[:400] * rng.choice([2.0, 3.0, 0.1], (400, 1))
    base[4400:4500] = base[7]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    asked = [i for i in range(6000) if i % 40 == 0]
    got = {}
    for r in ann.nearest(vectors, vectors.where("vec_id % 40 = 0"), k=5, shard_points=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(unit[r.query_id] @ unit[r.vec_id])) < 1e-12
    hits = 0
    for q in asked:
        score = unit @ unit[q]
        score[q] = -2
        hits += len(set(got[q]) & set(np.lexsort((np.arange(6000), -score.round(12)))[:5].tolist()))
    assert hits / (5 * len(asked)) >= 0.9


def test_ties_by_brute_force(spark):
    """Whole-number vectors, so that scores tie exactly, by collinear rows and by symmetry."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(2 ** rng.integers(0, 9)) if j == i % 4 else 0.0 for j in range(4)]) for i in range(500)] + [(500 + i, [1.0 + i % 3, 1.0, 1.0, 0.0]) for i in range(60)]
    rows += [(900 + i, [1e200, 1e200 if i % 2 else -1e200, 0.0, 0.0]) for i in range(10)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {}
    data = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    for q in [i for i in data if i % 50 == 0]:
        scored = sorted((-round(float(data[q] @ v / np.sqrt((data[q] @ data[q]) * (v @ v))), 12), i) for i, v in data.items() if i != q)
        exact[q] = [i for _, i in scored[:5]]
    for shard_points in (10_000, 100):
        got = {}
        for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5, shard_points=shard_points).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == exact
