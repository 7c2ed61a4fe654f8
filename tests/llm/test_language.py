"""The string kernel against sets of n-grams, and texts in which presence would fill up."""

import numpy as np
import pytest

from docloom.llm import langid, queries

SF = "/root/testdata/sf0.01"


def grams(text):
    """The distinct n-grams of letters, one blank for what separates them."""
    letters = "".join(c.lower() if c.isalpha() else " " for c in text)
    single = " ".join(letters.split())
    single = " " * (letters[:1] == " ") + single + " " * (letters[-1:] == " ")
    return {single[i : i + n] for n in langid.NGRAMS for i in range(len(single) - n + 1)} - {" "}


def test_kernel_equals_sets():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefghij éß,."), 150)) for _ in range(12)]
    x, _ = langid.presence(texts)
    model = langid.Model(x, ["a", "b", "c"] * 4)
    order = [i for k in range(3) for i in range(k, 12, 3)]
    want = np.array([[len(grams(a) & grams(texts[m])) / (len(grams(a)) * len(grams(texts[m]))) ** 0.5 for m in order] for a in texts])
    chance = max(len(grams(t)) for t in texts) / langid.SLOTS  # share of a string's n-grams that meet another's in a slot
    assert np.abs(model.kernel(x) - want).max() < 2 * chance < 0.06


def test_regression_equals_kernel_ridge():
    """With every row a landmark the folded weights are those of ridge regression on the kernel's own features."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdef" if i % 2 else "defghi"), 60)) for i in range(20)]
    x, _ = langid.presence(texts)
    model = langid.Model(x, ["one" if i % 2 else "two" for i in range(20)])
    order = [*range(1, 20, 2), *range(0, 20, 2)]
    k = model.kernel(x[order]).astype(float)
    y = np.array([[i % 2, 1 - i % 2] for i in order], float)
    want = k @ np.linalg.solve(k + langid.RIDGE * 10 * np.eye(20), y)
    assert np.abs(k @ model.beta - want).max() < 1e-2


@pytest.fixture(scope="module")
def trained(spark):
    return langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_long_noisy_texts(spark, trained):
    rng = np.random.default_rng(8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 1000").select("lang", "text").collect()
    for lang in ("de", "en", "es", "fr"):
        words = next(r.text for r in docs if r.lang == lang).split()
        for size in (300_000, 1_000_000):
            noise = ("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(size))
            text = " ".join(w if rng.random() > 0.1 else f"{w} {next(noise)}" for _ in range(size // sum(len(w) + 1 for w in words) + 1) for w in words)
            got, score = trained.predict([text, "", "12"])
            assert got == [lang, "und", "und"] and score[0] > 0.5 and score[1] == 0


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op6_language(spark, SF).collect() if r.held_out and truth[r.doc_id]]
    assert len(rows) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.99 * len(rows)


def test_sample_is_bounded(spark):
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 5}") for i in range(200)] + [(None, "x", "l0"), (7, None, "l1"), (8, "again", "l3"), (8, "again", "l3")], schema)
    assert langid.sample(docs, 10).count() == 50 and langid.sample(docs, 10, 20).count() == 20
    with pytest.raises(ValueError):
        langid.sample(docs, 10, 4)
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
