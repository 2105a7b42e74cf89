import random
import zlib

import numpy as np
import pytest

from graphloom.llm import language, quality

WORDS = {
    "aa": "the of and to in is that with for from this was".split(),
    "bb": "der die und nicht ein eine mit für auf ist schön".split(),
    "cc": "le la de et des une pour dans qui été".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", {"aa": "ing", "bb": "ung", "cc": "ment"}[lang]]) for _ in range(n))


def labelled(seed=0, n=240):
    rng = random.Random(seed)
    return [(i, text(rng, lang, rng.choice([4, 20, 90])), lang) for i in range(n) for lang in [rng.choice(["aa", "aa", "bb", "cc"])]]


def test_language(spark):
    rows = labelled()
    odd = [(900, None, "aa"), (901, "", None), (902, "12 34 !? --", "bb"), (903, text(random.Random(1), "bb", 3000), None), (904, "ü" * 60_000, None), (905, "😀😀", None), (None, text(random.Random(2), "cc", 30), None)]
    df = spark.createDataFrame([(i, t, lang, "s", "clash") for i, t, lang in rows + odd], "doc_id long, text string, lang string, source string, score string")
    model = language.train(df, language.LangParams(epochs=6))
    assert model.labels == ["aa", "bb", "cc"] and model.stats["accuracy"] >= 0.95
    got = language.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "accepted"]
    got = {r["doc_id"]: r for r in got.collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([got[i]["lang_pred"] == lang for i, lang in held]) >= 0.97
    assert np.mean([got[i]["accepted"] for i, _, _ in rows]) >= 0.95
    for i in (900, 901, 902, 905):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert got[903]["lang_pred"] == "bb" and got[None]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in got.values())


def test_language_is_learned_from_the_other_part_only(spark):
    """Wrong labels in the held-out part change nothing."""
    rows = labelled()
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    schema = "doc_id long, text string, lang string"
    a, b = (language.train(spark.createDataFrame(r, schema).repartition(n), language.LangParams(epochs=2)) for r, n in ((rows, 2), (wrong, 5)))
    assert a.labels == b.labels == ["aa", "bb", "cc"] and np.array_equal(a.scores, b.scores) and a.threshold == b.threshold


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in language.predict(df, language.train(df)).collect()] == [("und", 0.0)] * 2
    assert language.predict(df.limit(0), language.train(df.limit(0))).count() == 0


def test_subwords_by_hand():
    """Borders, letters and counts: 'Ab c' has a, b, c; _a ab b_ _c c_; _ab ab_ _c_ and what spans a single border."""
    assert language.subwords("").size == 0 and language.subwords("1 2").size == 0
    assert np.array_equal(np.sort(language.subwords("ab c")), np.sort(language.subwords("AB  1 c!")))
    assert language.subwords("a").size == 1 + 2 + 1


def test_rejection_is_calibrated(spark):
    """Noise is less sure than text, and the threshold keeps nearly all right answers."""
    df = spark.createDataFrame(labelled(3, 400), "doc_id long, text string, lang string")
    model = language.train(df, language.LangParams(epochs=6, reject=0.01))
    rng = random.Random(4)
    sure = [model.predict(text(rng, "bb", 40))[1] for _ in range(50)]
    noise = [model.predict(" ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(40)))[1] for _ in range(50)]
    assert np.mean(sure) > np.mean(noise) and 0 < model.threshold <= 0.5


def junk(rng):
    words = text(rng, "aa", 60).upper().split()
    return rng.choice([" ".join(w + "!!" for w in words), " | ".join(words).lower(), " ".join(["same"] * 50), " ".join(w.lower() + rng.choice(["***", "$$$", "%%%"]) for w in words)])


def quality_rows(n=900):
    rng = random.Random(8)
    good = [rng.random() < 0.85 for _ in range(n)]
    texts = [". ".join(text(rng, "aa", rng.randint(4, 12)).capitalize() for _ in range(rng.randint(2, 9))) + "." if g else junk(rng) for g in good]
    return [(i, t) for i, t in enumerate(texts)], [(i, int(g), 0) for i, g in enumerate(good) if i % 3], good


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels, good = quality_rows()
    odd = [(5000, None), (5001, ""), (5002, "word " * 40_000), (None, "A text. And more."), (3, rows[3][1])]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows + odd], "doc_id long, text string, predicted int")
    model = quality.train(df, spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int"), quality.QualityParams(epochs=25))
    return rows, good, df, model


def test_quality(scored):
    rows, good, df, model = scored
    assert 0.6 < model.prior <= 0.98
    got = quality.score(df, model)
    assert got.columns == ["doc_id", "text", "score", "predicted"]
    got = {r["doc_id"]: r for r in got.collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == good[i] for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[5000]["score"] == got[5001]["score"]


def test_quality_without_positives(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["score"], r["predicted"]) for r in quality.score(df, quality.train(df, labels)).collect()] == [(0.0, 0)] * 2
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels)).count() == 0


def test_risk_is_held_above_zero():
    """The prior of a known mixture is found, and the model tells its parts apart."""
    rng = np.random.default_rng(1)
    pos = rng.normal(1.5, 1, (1500, 5))
    unl = np.vstack([rng.normal(1.5, 1, (1050, 5)), rng.normal(-1.5, 1, (450, 5))])
    model = quality.fit(pos, unl, quality.QualityParams(epochs=30))
    assert abs(model.prior - 0.7) < 0.08
    new = np.vstack([rng.normal(1.5, 1, (500, 5)), rng.normal(-1.5, 1, (500, 5))])
    assert np.mean((model.margin(new) > 0) == (np.arange(1000) < 500)) > 0.97


def test_held_out_accuracy_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in language.op6_language_id(spark, sf).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.98
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op7_quality(spark, sf).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= 0.95


def test_samples_are_bounded_by_rows(spark):
    """Many rows of one id, equal and different ones: no more rows are sampled than the bound says."""
    rng = random.Random(12)
    base = [text(rng, "aa", 6) for _ in range(300)]
    rows = [(7, base[i % 300] + f" {i % 3000}", "aa") for i in range(6000)] + [(i, text(rng, "bb", 8), "bb") for i in range(100, 160)] + [(8, "der die und", "bb")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    bags = language.sample_bags(df, language.LangParams(rows=100, spans=(3,)))
    assert bags.lang.count("aa") <= 100 and 40 <= bags.lang.count("bb") <= 100 and bags.lang.count("aa") >= 90
    assert max(t for lang, t in zip(bags.lang, bags.turn, strict=True) if lang == "aa") == 50
    again = language.sample_bags(df.repartition(2), language.LangParams(rows=100, spans=(3,)))
    assert again.lang == bags.lang and np.array_equal(again.buckets, bags.buckets) and np.array_equal(again.turn, bags.turn)
    assert len(quality._sampled(df, 80, 6560)) == 80 and len(quality._sampled(df.limit(0), 80, 0)) == 0
    assert len(quality._sampled(df.filter("doc_id = 8"), 80, 500)) == 1


def plain_subwords(text):
    """Buckets of one- to three-letter subwords, letter by letter."""
    mask, m = 2**64 - 1, [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
    chars = [0]
    for c in [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0]:
        if c or chars[-1]:
            chars.append(c)
    raw = [c * m[0] for c in chars if c]
    raw += [(a * m[0] + b * m[1] & mask) ^ 0x5851F42D4C957F2D for a, b in zip(chars, chars[1:])]
    raw += [(a * m[0] + b * m[1] + c * m[2] & mask) ^ 0x14057B7EF767814F for a, b, c in zip(chars, chars[1:], chars[2:]) if b]
    return [((h & mask ^ (h & mask) >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 64 - language.BITS for h in raw] if len(chars) > 1 else []


def plain_language(model, text):
    """The average of the subwords' rows, one after the other, and a softmax."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    z = [float(b) for b in model.bias]
    ids = plain_subwords(text)
    for i in ids:
        z = [a + float(s) / len(ids) for a, s in zip(z, model.scores[i], strict=True)]
    e = [np.exp((a - max(z)) / model.temperature) for a in z]
    return model.labels[int(np.argmax(z))], max(e) / sum(e)


def test_language_against_a_plain_version(spark):
    """The whole query against a letter-by-letter version of the prediction, under the query's own model."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = language.op6_language_id(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, p = plain_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - p) < 1e-5 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    for odd in ("", "a", "Aß é", "1 2", "x" * 50, "İstanbul ǅ"):
        assert sorted(plain_subwords(odd)) == sorted(language.subwords(odd).tolist())


def plain_rates(text):
    """The described rates, counted one by one."""
    if not text:
        return [0.0] * quality.N_RATES
    k = quality.CLASSES
    classes = [quality._class_of(c) for c in text]
    single, pairs = [0] * k, [0] * (k * k)
    for c in classes:
        single[c] += 1
    for a, b in zip(classes, classes[1:]):
        pairs[a * k + b] += 1
    out = [(n / len(classes)) ** 0.5 for n in single + pairs]
    words = text.split()
    if not words:
        return out + [0.0] * 14
    seen = {w: words.count(w) for w in set(words)}
    lines = [x for x in text.split("\n") if x.strip()]
    out += [len(seen) / len(words), np.log(len(seen) + 1) / np.log(len(words) + 1), len({w.casefold() for w in seen}) / len(seen), sum(sorted(seen.values())[-3:]) / len(words)]
    out += [sum(words[i] == words[i + d] for i in range(len(words) - d)) / len(words) for d in (1, 2, 3, 4)]
    out += [sum(len(w) for w in words) / len(words) / 10, np.log1p(len(words)) / 10, len(lines) / len(words), 1 - len(set(lines)) / len(lines) if lines else 0.0]
    return out + [len({w[-1] for w in seen}) / 10, sum(n for w, n in seen.items() if len(w) > 1 and w.isupper()) / len(words)]


def test_quality_against_a_plain_version(spark):
    """The whole query against rates counted one by one and the layers applied to them, under the query's own model."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    a, b, c, d = model.layers
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = quality.op7_quality(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        x = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(plain_rates(texts[r["doc_id"]]), model.mean, model.scale, strict=True)]
        hidden = [np.tanh(sum(v * w for v, w in zip(x, a[:, j], strict=True)) + b[j]) for j in range(a.shape[1])]
        p = 1 / (1 + np.exp(-(sum(v * w for v, w in zip(hidden, c, strict=True)) + d)))
        assert abs(r["score"] - p) < 1e-6 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_risk_gradient_against_differences():
    """The step's gradient is that of the plainly written risk, or against its negative part where that is below 0."""

    def risk(zp, zu, prior):
        pos = prior * np.mean([np.log(1 + np.exp(-z)) for z in zp])
        return pos, np.mean([np.log(1 + np.exp(z)) for z in zu]) - prior * np.mean([np.log(1 + np.exp(z)) for z in zp])

    rng = np.random.default_rng(3)
    seen = set()
    for shift, prior in ((0.0, 0.4), (-4.0, 0.9)):
        zp, zu = rng.normal(2, 1, 5), rng.normal(shift, 1, 7)
        got, z = quality.risk_gradient(zp, zu, prior), np.concatenate([zp, zu])
        below = risk(zp, zu, prior)[1] < 0
        seen.add(bool(below))
        for i in range(len(z)):
            step = np.zeros(len(z))
            step[i] = 1e-6
            up, down = (risk((z + s)[:5], (z + s)[5:], prior) for s in (step, -step))
            slope = -(up[1] - down[1]) / 2e-6 if below else (sum(up) - sum(down)) / 2e-6
            assert abs(slope - got[i]) < 1e-6
    assert seen == {True, False}


def test_clashing_names_are_left_alone(spark):
    """Other names can be given for what is added, so that columns of those names stay."""
    df = spark.createDataFrame([(1, "der die das", "aa", 0.25, "mine")], "doc_id long, text string, lang string, score double, accepted string")
    model = language.train(df, language.LangParams(epochs=1))
    got = language.predict(df, model, names=("_l", "_s", "_a")).first()
    assert (got["score"], got["accepted"], got["_l"]) == (0.25, "mine", "aa")
    empty = quality.QualityModel(np.zeros(quality.N_RATES), np.ones(quality.N_RATES), None)
    assert quality.score(df, empty, names=("_s", "_p")).first()["score"] == 0.25
