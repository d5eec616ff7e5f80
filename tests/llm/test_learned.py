"""Language, quality and toxicity: held-out accuracy, scoring against plain loops, hard rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modelyard.llm import language, quality, toxicity
from modelyard.llm.bytewords import WordHasher, letters_and_digits
from modelyard.llm.learning import held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def network(corpus):
    return language.learned(corpus[0], ~held_out(F.col("doc_id"), 4, 2))


def test_held_out_is_crc32(spark):
    rows = spark.range(-5, 300).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
    assert not spark.sql("select cast(null as long) id").select(held_out(F.col("id"), 5, 0)).first()[0]


def test_languages_of_unseen_texts(corpus, network):
    docs = corpus[0].filter(held_out(F.col("doc_id"), 4, 2) & (F.length("text") >= 50))
    found = language.identified(docs, network)
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count()


def test_language_windows_against_the_network(network):
    """Table lookups over joined texts give what the plain network gives window by window."""
    texts = ["Das ist ein kleiner Text ohne Ende. " * 40, "x", "été", "the and of " * 30, "a" * 256, "b" * 257]
    scorer, settings, params = language.Scorer(network), network.settings, network.params
    for text, (name, share) in zip(texts, scorer.texts(pa.array(["", *texts, None]).slice(1, len(texts))), strict=True):
        data = np.concatenate([np.frombuffer(text.encode(), np.uint8), np.zeros(language.PAD, np.uint8)])
        n, total = len(data) - language.PAD, np.zeros(len(network.languages))
        for first in range(0, n, settings.window):
            size, pooled = min(settings.window, n - first), []
            for width, _ in settings.filters:
                values = [
                    params["embedding"][data[t : t + width]].reshape(-1) @ params[f"filter{width}"] + params[f"bias{width}"]
                    for t in range(first, first + size)
                ]
                pooled.append(np.maximum(np.max(values, 0), 0))
            logits = np.concatenate(pooled) @ params["output"] + params["bias"]
            shares = np.exp(logits - logits.max())
            total += size * shares / shares.sum()
        assert name == network.languages[int(total.argmax())] and abs(share - total.max() / n) < 1e-4


def test_every_language_is_learned(spark):
    rows = [(i, f"text {i} of l{i % 230}", f"l{i % 230}") for i in range(690)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = sorted({r[2] for r in rows})
    assert language.learned(docs, F.lit(True)).languages == names
    for total, each in ((230 * 2 + 9, 2), (100, 1)):
        settings = language.LanguageSettings(total=total)
        found = [name for name, _ in language.excerpts(docs, settings, "doc_id", "text", "lang", F.lit(True))]
        assert sorted(found) == sorted(names * each)


def test_language_of_hard_rows(hard, hard_rows, network, empty):
    found = language.identified(hard, network).collect()
    assert len(found) == len(hard_rows)
    for row in found:
        known = any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und" and row["score"] == 0) if not known else (row["lang_pred"] in network.languages)
        assert 0 <= row["score"] <= 1
    assert language.identified(empty, network).count() == 0
    assert language.learned(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.identified(hard, None).collect()} == {"und"}
    one = language.learned(hard.filter("lang = 'fr'"), F.lit(True))
    assert {r["lang_pred"] for r in language.identified(hard, one).collect()} == {"und", "fr"}


def test_quality_of_unseen_texts(corpus):
    docs, labels = corpus
    test = held_out(F.col("doc_id"), 5, 0)
    scored = quality.scored(docs, quality.learned(docs, labels, ~test)).join(labels, "doc_id").filter(test)
    good, bad = scored.filter("quality = 1"), scored.filter("quality = 0")
    assert good.filter("score >= 0.3").count() >= 0.99 * good.count()
    assert bad.filter("score < 0.3").count() >= 0.95 * bad.count()


def test_quality_learns_interactions():
    """A label that is the exclusive or of two features is out of reach for single tables."""
    rng = np.random.default_rng(1)
    features = np.zeros((4000, len(quality.FEATURES)))
    features[:, :4] = rng.random((4000, 4))
    label = ((features[:, 0] > 0.5) ^ (features[:, 2] > 0.5)).astype(float)
    model = quality.fitted(features, label, quality.AdditiveSettings(rounds=20))
    assert model.pairs and ((model.score(features) > 0.5) == label).mean() > 0.9
    plain = quality.fitted(features, label, quality.AdditiveSettings(rounds=20, pairs=0))
    assert ((plain.score(features) > 0.5) == label).mean() < 0.7


def test_quality_of_hard_rows(spark, hard, hard_rows, empty, corpus):
    labels = spark.createDataFrame([(6, 1), (6, 0), (10, 1), (11, 0), (1, 0), (None, 1), (12, None), (4, 0)], "doc_id long, quality int")
    scores = [r["score"] for r in quality.scored(hard, quality.learned(hard, labels, F.lit(True))).collect()]
    assert len(scores) == len(hard_rows) and all(0 <= s <= 1 for s in scores)
    none = quality.learned(hard, labels, F.lit(False))
    assert {r["score"] for r in quality.scored(hard, none).collect()} == {0.5}
    assert quality.scored(empty, none).count() == 0
    assert quality.learned(empty, corpus[1], F.lit(True)).tables == []


def test_toxicity_of_unseen_texts(corpus):
    docs, labels = corpus
    test = held_out(F.col("doc_id"), 5, 0)
    found = toxicity.scored(docs, toxicity.learned(docs, labels, ~test), ["doc_id"]).join(labels, "doc_id").filter(test)
    toxic, clean = found.filter("toxic = 1"), found.filter("toxic = 0")
    assert toxic.filter("score >= 0.5").count() >= 0.9 * toxic.count()
    assert clean.filter("score < 0.5").count() >= 0.98 * clean.count()


def test_toxicity_from_positive_and_unlabelled_only():
    """A tenth of the unlabelled texts are toxic; the corrected risk still tells them apart."""
    rng = np.random.default_rng(2)

    def doc(toxic):
        words = rng.integers(100, 5000, 60)
        return np.unique(np.concatenate([words, rng.integers(0, 8, 2) if toxic else words[:0]])).astype(np.uint64)

    model = toxicity.fitted([doc(True) for _ in range(300)], [doc(i % 10 == 0) for i in range(3000)], 0.1, toxicity.ToxicitySettings())
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert min(weight.get(i, 0) for i in range(8)) > 2 and model.bias < -1
    fresh = [(i % 2 == 0, sum(weight.get(f, 0) for f in doc(i % 2 == 0).tolist()) + model.bias > 0) for i in range(400)]
    assert sum(found for toxic, found in fresh if toxic) >= 180 and sum(found for toxic, found in fresh if not toxic) <= 6


def test_toxicity_scores_against_sums(hard, hard_rows):
    texts = [r[1] for r in hard_rows]
    hasher = WordHasher(letters_and_digits(), prefixes=toxicity.PREFIXES)
    sets = list(toxicity.held(hasher, pa.array(texts)))
    features = np.unique(np.concatenate([s[::3] for s in sets]))
    model = toxicity.ToxicityModel(features, np.linspace(-0.01, 0.01, len(features)), 0.5)
    weight = dict(zip(features.tolist(), model.weights.tolist(), strict=True))
    want = [1 / (1 + np.exp(-np.clip(0.5 + sum(weight.get(x, 0) for x in s.tolist()), -30, 30))) for s in sets]
    assert np.allclose(model.score(pa.array(texts)), want)
    assert len(toxicity.scored(hard, model, ["doc_id"]).collect()) == len(texts)


def test_toxicity_without_labels(spark, hard, empty):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learned(hard, none, F.lit(True))
    assert {r["score"] for r in toxicity.scored(hard, model, ["doc_id"]).collect()} == {0.0}
    assert toxicity.scored(empty, toxicity.learned(empty, none, F.lit(True)), ["doc_id"]).count() == 0


def test_repeated_labelled_ids_send_one_row(spark):
    """An id that owns most rows gives the driver one of them; another order of the rows changes nothing."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join([*rng.choice(words, 30), *(["bad", "worse"] if i % 4 == 0 else [])])) for i in range(200)]
    rows += [(8, rows[8][1])] * 5000 + [(12, "other text bad worse")] * 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 != 0)) for i in range(200)], "doc_id long, toxic int, quality int")
    settings = toxicity.ToxicitySettings(unlabelled=150)
    models = [toxicity.learned(d, labels, F.lit(True), settings) for d in (docs.repartition(3), docs.repartition(8).orderBy(F.desc("text")))]
    assert np.array_equal(models[0].features, models[1].features) and np.array_equal(models[0].weights, models[1].weights)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, models[0], ["doc_id"]).collect()}
    assert min(scores[i] for i in range(0, 200, 4)) > 0.5 > max(scores[i] for i in range(200) if i % 4)
    sizes, plain = [], quality.fitted
    quality.fitted = lambda features, *rest: sizes.append(len(features)) or plain(features, *rest)
    try:
        quality.learned(docs, labels, F.lit(True))
    finally:
        quality.fitted = plain
    assert sizes == [200]


def test_toxicity_fits_like_a_plain_loop():
    """The same documents, given whole, give the same model as features chosen and counted by hand."""
    rng = np.random.default_rng(6)
    docs = [np.unique(rng.integers(0, 300, 40)).astype(np.uint64) for _ in range(60)]
    settings = toxicity.ToxicitySettings(least=8, steps=30)
    names, n = toxicity.candidates(docs, settings)
    counts = {}
    for doc in docs:
        for feature in doc.tolist():
            counts[feature] = counts.get(feature, 0) + 1
    assert dict(zip(names.tolist(), n.tolist(), strict=True)) == {f: c for f, c in counts.items() if c >= 8}
    cut = [d[np.isin(d, names)] for d in docs]
    whole, part = toxicity.fitted_to(docs, docs[:30], 0.3, settings), toxicity.fitted_to(cut, docs[:30], 0.3, settings)
    assert np.array_equal(whole.features, part.features) and np.array_equal(whole.weights, part.weights) and whole.bias == part.bias


def test_first_boosting_cycle_by_hand():
    """One tree of depth two on one feature, with the gains summed row by row, and constants for the features that never vary."""
    rng = np.random.default_rng(7)
    features = np.zeros((300, len(quality.FEATURES)))
    features[:, 0] = rng.integers(0, 6, 300)
    label = (rng.random(300) < np.where(features[:, 0] > 2, 0.9, 0.2)).astype(float)
    settings = quality.AdditiveSettings(rounds=1, pairs=0, leaf=10)
    model = quality.fitted(features, label, settings)
    share = label.mean()
    base = np.log(share / (1 - share))

    def best_cut(rows, depth):
        values = sorted(set(features[rows, 0]))
        sums = lambda at: ((label[at] - share).sum(), len(at) * share * (1 - share))
        gain = lambda s: s[0] ** 2 / (s[1] + 1)
        whole, best = sums(rows), None
        for cut in values[1:] if depth else []:
            low, high = [rows[f] for f in (features[rows, 0] < cut, features[rows, 0] >= cut)]
            if min(len(low), len(high)) >= settings.leaf:
                found = gain(sums(low)) + gain(sums(high))
                if found > gain(whole) + 1e-12 and (best is None or found > best[0] + 1e-12):
                    best = found, low, high
        if best is None:
            return {v: whole[0] / (whole[1] + 1) for v in values}
        return best_cut(best[1], depth - 1) | best_cut(best[2], depth - 1)

    steps = best_cut(np.arange(300), 2)
    total = base + settings.rate * np.array([steps[v] for v in features[:, 0]])
    for _ in range(features.shape[1] - 1):  # the other features have one bin each, whose tree is a constant
        chance = 1 / (1 + np.exp(-total))
        total = total + settings.rate * (label - chance).sum() / ((chance * (1 - chance)).sum() + 1)
    assert np.allclose(model.score(features), 1 / (1 + np.exp(-total)))
