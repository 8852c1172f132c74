import random
import zlib

import numpy as np
import pytest

from pagelake.llm import langid, ngrams, quality_model, sampling, toxicity
from pagelake.llm.common import documents, held_out, labels
from pagelake.llm.queries import op1_toxicity, op7_quality_model, op8_language
from tests.llm import odd

SF = "/root/testdata/sf0.01"


def toy(n=240, seed=5):
    """Plain words; label 1 holds a misspelt form of a few words."""
    rng = random.Random(seed)
    plain = ["stone", "river", "cloud", "meadow", "winter", "garden", "paper", "silver", "window", "yellow"]
    bad = ["grubnak", "grubnok", "grubnaks", "grrubnak", "grubnaky"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if i % 3 == 0:
            words += [rng.choice(bad[:3]) for _ in range(1 + len(words) // 20)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_sampling_is_bounded_and_covers_every_label(spark):
    rows = [(i, i % 10 == 0) for i in range(5000)] + [(None, True), (7, None), (3, False)]
    df = spark.createDataFrame(rows, "doc_id bigint, label boolean")
    got = sampling.per_label(df, "label", 200).collect()
    n = {x: sum(r["label"] == x for r in got) for x in (True, False)}
    assert 140 < n[True] < 260 and 140 < n[False] < 260 and len({r["doc_id"] for r in got}) == len(got)
    assert len(sampling.per_label(df, "label", 10_000).collect()) == 5000
    assert sampling.per_label(df.where("doc_id < 0"), "label", 5).count() == 0
    assert sampling.prior(df.where("doc_id < 0"), "label") == 0.5 and 0.09 < sampling.prior(df, "label") < 0.12


def test_ngrams_stay_inside_words():
    codes, ends = ngrams.letter_codes(["ab c", "", "1!", "\x00d"])
    got = {}
    for n, (at, h) in zip((2, 3), ngrams.hashed(codes, (2, 3)), strict=True):
        assert len(at) == len(h)
        got[n] = ngrams.per_text(np.ones(len(at)), at, ends).tolist()
    assert got == {2: [5, 0, 0, 2], 3: [3, 0, 0, 1]}
    same = [h for _, h in ngrams.hashed(ngrams.letter_codes(["xy", "xy"])[0], (2,))][0]
    assert same[:3].tolist() == same[3:].tolist()


def test_toxicity_learns_spellings_it_never_saw():
    rows = toy()
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], 1 / 3, steps=300, count=1 << 14)
    fresh = toy(90, seed=6)
    got = (model.scores([t for _, t, _ in fresh]) >= 0.5).astype(int)
    assert (got == [y for *_, y in fresh]).mean() > 0.97
    unseen = model.scores(["stone river cloud grrubnak paper silver", "stone river cloud meadow paper silver", "", "123"])
    assert unseen[0] > 0.5 > unseen[1] and unseen[2] == unseen[3] and 0 <= unseen[2] <= 1


def test_toxicity_without_both_classes():
    assert toxicity.train([], [], 0.5).scores(["a", ""]).tolist() == [0.5, 0.5]
    assert toxicity.train(["a"], [1], 0.25).scores(["x"])[0] == pytest.approx(0.25)


def test_a_score_does_not_depend_on_its_batch():
    rows = toy(60)
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows], 1 / 3, steps=100, count=1 << 12)
    texts = [t for _, t, _ in rows] + ["", odd.LONG]
    assert model.scores(texts) == pytest.approx([model.scores([t])[0] for t in texts])


def test_flattened_trees_walk_like_a_recursive_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(int)
    trees = quality_model.fit_trees(x, y, y.mean(), trees=40)

    def walk(node, row):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    assert trees.margin(x[:50]) == pytest.approx([trees.base + sum(walk(r, row) for r in trees.roots) for row in x[:50]])
    assert ((trees.scores(x) >= 0.5) == y).mean() > 0.97


def test_trees_without_both_classes():
    none = quality_model.fit_trees(np.empty((0, 3)), np.empty(0, "int64"), 0.5)
    assert none.scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_statistics_of_odd_texts_are_finite():
    for text in ("", " ", "\n\n", "a", odd.LONG, "###", "\x00", "é👍 ٣"):
        s = quality_model.statistics(text)
        assert len(s) == len(quality_model.STATISTICS) and np.isfinite(s).all()


def test_filters_hold_every_language_of_an_ngram():
    texts = ["the cat and the dog"] * 3 + ["der hund und die katze"] * 3
    f = langid.build(texts, ["en"] * 3 + ["de"] * 3, slots=1 << 12)
    assert f.languages == ["de", "en"]
    codes, _ = ngrams.letter_codes(["the", "und"])
    masks = [int(m[0]) for _, h in ngrams.hashed(codes, (3,)) for m in f.masks(h)]
    assert all(m & 2 for m in masks[:2]) and all(m & 1 for m in masks[-3:])
    lang, score = f.predict(["the cat", "hund und katze", "", "12 3", "dog"])
    assert lang[:4] == ["en", "de", "und", "und"] and score[2] == score[3] == 0 and (score >= 0).all() and (score <= 1).all()


def test_more_languages_than_a_lane_holds():
    rng = random.Random(1)
    names = [f"l{i:03d}" for i in range(70)]
    words = {n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(6)] for n in names}
    f = langid.build([" ".join(words[n] * 3) for n in names], names)
    assert f.table.shape[1] == 2
    assert f.predict([" ".join(words[n]) for n in names])[0] == names


@pytest.mark.parametrize("languages", [8, 70])
def test_ngrams_that_many_languages_share_are_in_all_their_filters(languages):
    rng = random.Random(languages)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    common, names = [word() for _ in range(30)], [f"l{i:02d}" for i in range(languages)]
    own = {n: common + [word() for _ in range(5)] for n in names}
    text = lambda n, k: " ".join(rng.choice(own[n]) for _ in range(k))
    f = langid.build([text(n, 300) for n in names for _ in range(4)], [n for n in names for _ in range(4)])
    codes, _ = ngrams.letter_codes([" ".join(common)])
    for _, h in ngrams.hashed(codes, langid.SIZES):
        masks = f.masks(h)
        assert all(((masks[:, i // langid.LANE] >> np.uint64(i % langid.LANE)) & np.uint64(1)).all() for i in range(languages))
    assert f.predict([text(n, 150) for n in names])[0] == names


def _grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [f"_{w}_"[i:i + n] for w in words for n in langid.SIZES for i in range(len(w) + 3 - n)]


def test_languages_equal_those_of_plain_sets():
    from collections import Counter

    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    rows = [r for r in rows if r["text"] and r["lang"]][:400]
    learn, rest = rows[:150], rows[150:]
    f = langid.build([r["text"] for r in learn], [r["lang"] for r in learn])
    counted = {name: Counter(g for r in learn if r["lang"] == name for g in _grams(r["text"])) for name in f.languages}
    kept = {name: {g for g, n in c.items() if n >= max(langid.MIN_COUNT, langid.MIN_RATE * c.total())} for name, c in counted.items()}
    hits, n, _ = f.counts([r["text"] for r in rest])
    lang, score = f.predict([r["text"] for r in rest])
    for i, r in enumerate(rest):
        grams = _grams(r["text"])
        true = np.array([sum(g in kept[name] for g in grams) for name in f.languages])
        # filters add chance hits and lose none
        assert n[i] == len(grams) and (hits[i] >= true).all() and (hits[i] - true <= 2 + 0.02 * len(grams)).all()
        best = np.argsort(-true, kind="stable")
        if true[best[0]] - true[best[1]] > 0.04 * len(grams) + 4:
            assert lang[i] == f.languages[best[0]] and abs(score[i] - true[best[0]] / true.sum()) < 0.05


def test_chance_hits_are_corrected():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    texts, names = [], []
    for lang, n in (("big", 400), ("small", 20)):
        own = [word() for _ in range(n)]
        texts.append(" ".join(own * 2))
        names.append(lang)
    f = langid.build(texts, names, slots=1 << 12, hashes=1)
    assert f.chance()[0] > 0.4
    foreign = [" ".join(word() for _ in range(400))]
    hits, n, _ = f.counts(foreign)
    corrected = (hits - n[:, None] * f.chance()) / (1 - f.chance())
    assert abs(corrected[0, 0]) < 0.1 * n[0] < hits[0, 0]


def _crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_held_out_matches_crc32(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id bigint").select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("h"))
    assert all(r["h"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())


def test_queries_score_held_out_documents(spark):
    truth = {r["doc_id"]: r for r in labels(spark, SF).collect()}
    langs = {r["doc_id"]: r["lang"] for r in documents(spark, SF).select("doc_id", "lang").collect()}
    quality = op7_quality_model(spark, SF).collect()
    assert len(quality) == len(langs) and all(r["held_out"] == (_crc(r["doc_id"]) % 4 == 2) for r in quality)
    out = [r for r in quality if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]]["quality"] for r in out]) > 0.95
    language = op8_language(spark, SF).collect()
    out = [r for r in language if r["held_out"]]
    assert all(r["held_out"] == (_crc(r["doc_id"]) % 5 == 0) for r in language)
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in out]) > 0.97
    toxic = op1_toxicity(spark, SF).collect()
    out = [r for r in toxic if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]]["toxic"] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in toxic + quality + language)


def test_odd_and_empty_tables(spark):
    df, none = odd.docs(spark), odd.empty(spark)
    rows = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1), (10, None, None)], "doc_id bigint, quality int, toxic int")
    for module, label in ((toxicity, "toxic"), (quality_model, "quality")):
        model = module.fit(df, rows, label)
        assert module.score(df, model).count() == len(odd.rows())
        assert module.score(none, model).count() == 0
        blank = module.fit(none, rows.where("doc_id < 0"), label)
        assert {r["score"] for r in module.score(df, blank).collect()} == {0.5}
    filters = langid.fit(df)
    got = langid.identify(df, filters).collect()
    assert len(got) == len(odd.rows()) and {r["lang_pred"] for r in got if r["doc_id"] in (7, 8, 9)} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(df, langid.fit(none)).collect()} == {"und"}
