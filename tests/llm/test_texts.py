"""The operators over texts and terms against brute force, exact round trips and held-out grades."""

import collections
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.build import rows
from wayloom.llm import leakage, levels, packing, terms
from wayloom.llm.words import words

SAMPLES = "/root/testdata/sf0.001"
HAS_DATA = os.path.exists(SAMPLES)

# 4: terms

RECORDS = "grp string, sequences array<array<string>>, gram string, total int, suffix string"


def brute_grams(records, n, anchored):
    occurrences, holders = collections.Counter(), collections.defaultdict(set)
    for k, (grp, sequences) in enumerate(records):
        for s in sequences or []:
            s = [t for t in s or [] if t is not None]
            for i in range(len(s)):
                if anchored and i:
                    break
                for j in range(i + 1, min(len(s), i + n) + 1):
                    occurrences[grp, tuple(s[i:j])] += 1
                    holders[grp, tuple(s[i:j])].add(k)
    return sorted((g if g is not None else "-", gram, c, len(holders[g, gram])) for (g, gram), c in occurrences.items())


@pytest.mark.parametrize("seed, n, anchored", [(0, 3, False), (1, 2, True), (2, 1, False)])
def test_grams_against_brute_force(spark, seed, n, anchored):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "a", "a", "b", "c", "", "é", None])
    records = [(rng.choice(["x", "y", None]), rng.choice([None, [], [None]]) if rng.random() < 0.1 else [[word() for _ in range(rng.randrange(6))] for _ in range(rng.randrange(4))]) for _ in range(150)]
    records += [("x", [["hot", "hot", "hot"]])] * 100
    df = spark.createDataFrame([(*r, "", 0, "") for r in records], RECORDS).repartition(5)
    got = terms.count_grams(df, n, anchored).collect()
    assert sorted((r.grp if r.grp is not None else "-", tuple(r.gram), r.occurrences, r.records) for r in got) == brute_grams(records, n, anchored)


def test_grams_across_partition_borders(spark):
    """One first term holds all rows: its suffixes are routed to several tasks, its prefix is added up."""
    df = spark.createDataFrame([("x", [["k", f"{i:04d}"], ["k", f"{i:04d}"]], "", 0, "") for i in range(2000)], RECORDS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r.gram): (r.occurrences, r.records) for r in terms.count_grams(df, 2, anchored=True).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 2001 and got[("k",)] == (4000, 2000) and got[("k", "0007")] == (2, 1)


def test_grams_of_tags(spark, tmp_path):
    from wayloom.llm import queries

    tags = [{"Name": "old mill road east;Old Mill", "ref": "x"}, {"name": "mill road"}, {" NAME ": " ", "k": None}, None]
    rows = [(i, t, True, 1, 1) for i, t in enumerate(tags)]
    for table in ("nodes", "ways"):
        spark.createDataFrame(rows[: 4 if table == "nodes" else 1], "id bigint, tags map<string,string>, visible boolean, version int, sequence int").write.parquet(f"{tmp_path}/{table}.parquet")
    got = {(r.obj, r.gram): (r.occurrences, r.records) for r in queries.QUERIES["p4_grams"](spark, str(tmp_path)).collect()}
    want = {}
    for obj, records in (("node", [["name old mill road east", "name old mill", "ref x"], ["name mill road"]]), ("way", [["name old mill road east", "name old mill", "ref x"]])):
        for n, sequences in enumerate(records):
            for w in map(str.split, sequences):
                for i in range(len(w)):
                    for k in range(i + 1, min(i + 3, len(w)) + 1):
                        seen = want.setdefault((obj, " ".join(w[i:k])), [0, set()])
                        seen[0] += 1
                        seen[1].add(n)
    assert got == {k: (n, len(ids)) for k, (n, ids) in want.items()} and got["node", "mill road"] == (2, 2)


def test_tag_terms_and_marks(spark):
    df = spark.createDataFrame(
        [(1, {" Highway": "Path; ;path ;TRACK", "x": None}), (2, {"highway ": "path"}), (3, {"highway": ""}), (4, None), (5, {"highway": "path"}), (6, {"name": "a;b"})],
        "id bigint, tags map<string,string>",
    )
    records = df.select(F.lit("g").alias("grp"), terms.tag_terms(F.col("tags")).alias("sequences"))
    got = {(tuple(r.gram), r.mark): (r.occurrences, r.records) for r in terms.mark_terms(records, 1, 0.5).collect()}
    assert got == {
        (("highway", "path"), "common"): (4, 3), (("highway", "track"), "rare"): (1, 1), (("name", "a"), "rare"): (1, 1), (("name", "b"), "rare"): (1, 1),
    }
    both = terms.mark_terms(records.where("size(sequences) > 0").limit(1), 2, 0.05).collect()
    assert sorted(r.mark for r in both) == ["common", "common", "rare", "rare"]
    assert terms.mark_terms(records.limit(0), 2, 0.05).count() == 0


# words


def test_words():
    assert words("Café&nbsp;&#66;ar, zero​width so­ft_x 3rd STRASSE straße") == "cafe bar zerowidth soft x 3rd strasse strasse".split()
    assert words(None) == words("") == words("...") == []
    assert words("été") == ["ete"] and words("שָׁלוֹם") == ["שלום"]


# 8: packing

DOCS = "doc_id bigint, text string, tokens int, key string, container string, tags string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, 0, "", "", "") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def packed(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["hut", "lake", "trail", "path", "Zimmer"]) for _ in range(rng.choice([3, 20, 90, 200, 400]))) for _ in range(800)]
    texts += ["", None, "word " * 5000, "same text " * 30] + ["same text " * 30] * 300
    rows_ = packing.pack(docs(spark, *texts), 512).collect()
    return texts, rows_


def test_packing_keeps_everything(packed):
    texts, got = packed
    enc = packing.tokenizer(*packing.vocabulary_of(packing.VOCABULARY))
    size = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.tokens, r.piece))
    assert set(pieces) == set(size)
    for i, p in pieces.items():
        p.sort()
        assert [s for s, _, _ in p] == [512 * k for k in range(len(p))] and sum(t for _, t, _ in p) == size[i]
        assert len(p) == max(1, math.ceil(size[i] / 512))


def test_packing_fills_containers(packed):
    _, got = packed
    boxes = collections.defaultdict(list)
    for r in got:
        if r.container is not None:
            boxes[r.container].append((r.place, r.tokens))
    for b in boxes.values():
        b.sort()
        at = 0
        for place, tokens in b:
            assert place == at
            at += tokens
        assert at <= 512
    total = sum(r.tokens for r in got)
    assert len(boxes) <= 1.05 * math.ceil(total / 512) + 1
    assert sorted(r.doc_id for r in got if r.container is None) == [800, 801]


def test_packing_of_nothing(spark):
    assert packing.pack(docs(spark, "a").limit(0), 10).count() == 0
    assert packing.pack(docs(spark, None, ""), 10).where("container IS NOT NULL").count() == 0


@pytest.mark.parametrize("d, bits", [(2, 4), (3, 3)])
def test_hilbert_curve_is_a_walk(d, bits):
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = packing.hilbert(grid, bits)
    assert sorted(keys.tolist()) == list(range(side**d))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_similar_texts_are_neighbours():
    a, b, c = packing.curve_keys(["the lake and the hut", "the hut and the lake", "Zimmer frei"])
    assert a == b and a != c


# 9: leakage


def brute_leaks(texts, items):
    out = set()
    for d, t in texts:
        tw = words(t)
        for i, it in items:
            iw = words(it)
            n = len(iw)
            if not n:
                continue
            runs = {tuple(tw[a : a + 10]) for a in range(len(tw) - 9)}
            hit = any(tuple(iw[a : a + 10]) in runs for a in range(n - 9))
            limit, least = math.floor(1.5 * n), 0.75 * n
            for a in range(len(tw) if not hit else 0):
                row = [0] * (n + 1)
                for w in tw[a : a + limit]:
                    last = 0
                    for j in range(n):
                        keep = row[j + 1]
                        row[j + 1] = last + 1 if w == iw[j] else max(row[j + 1], row[j])
                        last = keep
                if row[n] >= least - 1e-9:
                    hit = True
                    break
            if hit:
                out.add((d, i))
    return out


def mutated(rng, item, vocabulary):
    """An item with words replaced, dropped, put in and cut off, about where the second case ends."""
    ws = list(item)
    p = rng.choice([0, 0.1, 0.2, 0.25, 0.3])
    out = []
    for w in ws:
        r = rng.random()
        if r < p / 2:
            continue
        out.append(rng.choice(vocabulary) if r < p else w)
        while rng.random() < rng.choice([0, 0.2, 0.4]):
            out.append(rng.choice(vocabulary))
    k = rng.choice([0, 0, 0, len(out) // 5, len(out) // 3])
    return out[k:]


@pytest.mark.parametrize("seed, hot, limbs", [(0, 8, 8), (1, 1, 8), (2, 0, 0), (3, 1, 1), (4, 8, 8)])
def test_leaks_against_brute_force(seed, hot, limbs, monkeypatch):
    monkeypatch.setattr(leakage, "HOT", hot)
    monkeypatch.setattr(leakage, "KEEP", 1 + seed)
    monkeypatch.setattr(leakage, "LIMBS", limbs)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    sentence = lambda n: [rng.choice(vocabulary[: rng.choice([8, 60])]) for _ in range(n)]
    items = [(k, " ".join(sentence(rng.choice([1, 2, 3, 5, 8, 12, 20, 37, 40, 60, 90, 150])))) for k in range(20)]
    texts = []
    for k in range(60):
        base = sentence(rng.randrange(60))
        if rng.random() < 0.8:
            base += mutated(rng, words(rng.choice(items)[1]), vocabulary) + sentence(rng.randrange(40))
        texts.append((k, " ".join(base)))
    m = leakage.Matcher([(i, words(t)) for i, t in items])
    got = {(texts[d][0], i) for d, i in m.search([words(t) for _, t in texts])}
    assert got == brute_leaks(texts, items)


def test_leaks_in_tables(spark, monkeypatch):
    item = "The quick brown fox jumps over the lazy dog near the quiet river bank today"
    texts = [item.upper(), "x " * 50 + item.replace("o", "&#111;") + " y" * 50, " ".join(item.split()[:10]), " ".join(item.split()[:9]), None, "", "nothing", item, "z " * 200_000 + item]
    d = docs(spark, *texts)
    d = d.unionByName(d.where("doc_id = 0"))
    items = spark.createDataFrame([(7, item, "en"), (8, None, "en"), (9, "", "en"), (7, item, "en"), (10, "unseen words only here", "en")], "item_id bigint, text string, lang string")
    want = [(0, 7), (1, 7), (2, 7), (7, 7), (8, 7)]
    assert rows(leakage.leaked(d, items), "doc_id", "item_id") == want
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 1)
    assert rows(leakage.leaked(d, items), "doc_id", "item_id") == want
    assert leakage.leaked(d, items.limit(0)).count() == 0 and leakage.leaked(d.limit(0), items).count() == 0


# 10: levels


@pytest.mark.skipif(not HAS_DATA, reason="no test tables")
def test_levels_of_held_out_texts(spark):
    samples = spark.read.parquet(f"{SAMPLES}/level_samples.parquet").orderBy("sample_id")
    documents = spark.read.parquet(f"{SAMPLES}/documents.parquet")
    graded = [(r.sample_id, r.text, r.level) for r in samples.collect()]
    random.Random(0).shuffle(graded)
    train, test = graded[::2], graded[1::2]
    held = spark.createDataFrame([(i, t, 0, "", "", "") for i, t, _ in test], DOCS).unionByName(documents.select((-F.col("doc_id") - 1).alias("doc_id"), "text", F.lit(0).alias("tokens"), *(F.lit("").alias(c) for c in ("key", "container", "tags"))))
    got = {r.doc_id: r.level for r in levels.rate(held, spark.createDataFrame(train, "x bigint, text string, level int")).collect()}
    want = {i: y for i, t, y in test if len(t.split()) >= levels.LEAST}
    right = sum(got.get(i) == y for i, y in want.items())
    assert len(want) > 40 and right / len(want) > 0.95


def test_ordinal_regression():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 3))
    y = 1 + (x[:, 0] * 2 + x[:, 1] > np.array([[-2], [0], [2]])).sum(0)
    model = levels.fit(x[:400], y[:400])
    assert (np.diff(model.borders) > 0).all() and (model.levels(x[400:]) == y[400:]).mean() > 0.95
    assert np.allclose(model.chances(x).sum(1), 1)


def test_languages():
    texts = ["The room was clean and we liked it", "Das Zimmer war sauber und wir mochten es sehr", "La chambre est propre et nous avons aimé", "La habitación es muy limpia y nos gusta", "", "..."]
    assert levels.features(texts, levels.Lexicon({}))[2].tolist() == [True, False, False, False, False, False]
    assert not levels.features(["", "1 2"], levels.Lexicon({}))[2].any()


def test_features_do_not_depend_on_the_batch():
    texts = ["The dog, the big dog, ran. It was late!" * 30, "", "However, NATO and the Berlin office insisted that nothing happened.\n\n" * 9, "a", "\x01\x02 one two. three", "x " * 3000]
    lexicon = levels.Lexicon({"the": 2.0, "dog": 5.0})
    own, rows_, _ = levels.features(texts, lexicon)
    for i, t in enumerate(texts):
        alone = levels.features([t], levels.Lexicon(lexicon.rarity))[1]
        assert np.allclose(rows_[own == i], alone), i
    assert np.bincount(own).tolist() == [7, 0, 2, 1, 1, 75]


def test_tags_of_any_length_are_no_words():
    tag = "<p class='" + "word " * 2000 + "'>"
    assert levels.plain(f"a{tag}b<3 c<span title='{'x ' * 500}'>d").split() == ["a", "b<3", "c", "d"]


def test_frequencies_are_exact(spark, monkeypatch):
    monkeypatch.setattr(levels, "COUNTED", 1)
    d = docs(spark, *["the cat"] * 30, "The Cát sat", None, "")
    assert levels.frequencies(d) == {"the": pytest.approx(-math.log(31 / 63)), "cat": pytest.approx(-math.log(31 / 63)), "sat": pytest.approx(math.log(63))}
    monkeypatch.setattr(levels, "RAREST", 2.0)
    assert set(levels.frequencies(d)) == {"the", "cat"} and levels.frequencies(d.limit(0)) == {}


def test_levels_of_odd_texts(spark):
    graded = spark.createDataFrame([("The dog was big. " * 20, 1), ("Notwithstanding the aforementioned considerations, the administration recommended, " * 8, 2), (None, 1), ("x", None)], "text string, level int")
    d = docs(spark, None, "", "the word", "the dog was here. " * 20, "<p>The dog &amp; the cat</p> was " * 20, "the " * 50_000, "12 34 " * 40, "a\n\n" * 50)
    got = {r.doc_id: r.level for r in levels.rate(d, graded).collect()}
    assert set(got) >= {3, 4, 5} and not {0, 1, 2, 6} & set(got) and set(got.values()) <= {1, 2}
    assert levels.rate(d.limit(0), graded).count() == 0
    assert levels.rate(d, graded.limit(0)).count() == 0 and levels.rate(d, graded.where("level = 1")).count() == 0


def test_levels_of_words_in_brackets(spark):
    graded = spark.createDataFrame([("The dog was big. " * 20, 1), ("Notwithstanding the aforementioned considerations, the administration recommended, " * 8, 2)], "text string, level int")
    got = {r.doc_id: r.level for r in levels.rate(docs(spark, "(The dog was here.) " * 20, "The dog was here. " * 20), graded).collect()}
    assert set(got) == {0, 1} and got[0] == got[1]
