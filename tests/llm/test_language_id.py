import numpy as np
import pytest

from lodestone.llm import language_id

from .support import documents, empty


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    out = language_id.op9_language_id(spark, path)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    held = [r for r in out.collect() if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 30])
def test_codewords_are_apart(n):
    code = language_id.codebook(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= (1 if n == 2 else 2) and (np.abs(code.sum(0)) < n).all()


def test_features_don_t_depend_on_neighbours():
    texts = ["one text", "", "été 😀", "one text"]
    together = language_id.gram_features(texts)
    for i, t in enumerate(texts):
        assert np.array_equal(together[i], language_id.gram_features([t])[0])
    assert np.allclose((together**2).sum(1), 1, atol=1e-3)


def plain_features(text):
    """Hashed n-grams counted one by one."""
    codes, counts, n = [ord(c) for c in f" {text.lower()}  "], [0] * language_id.BUCKETS, 0
    for start in range(len(codes) - max(language_id.LENGTHS) + 1):
        for length in language_id.LENGTHS:
            h = 0
            for c in codes[start : start + length]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ (c * 0x9E3779B1 & 0xFFFFFFFF)
            h = h + length * 0x85EBCA6B & 0xFFFFFFFF
            h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
            counts[(h ^ h >> 13) & language_id.BUCKETS - 1] += 1
            n += 1
    return [(c / n) ** 0.5 for c in counts]


def test_features_and_decoding_equal_a_plain_walk():
    import math

    texts = ["the one cat sat on that mat", "der eine Hund saß dort drüben", "le chat était là hier soir", "el gato estaba allí ayer", "été 😀", "a"]
    for t in texts:
        assert np.allclose(language_id.gram_features([t])[0], plain_features(t), atol=1e-6)
    model = language_id.OutputCodes(["de", "en", "es", "fr"]).fit(language_id.gram_features(texts[:4]), np.array([1, 0, 3, 2]))
    langs, scores, unsure = model.predict(texts)
    for t, lang, score, doubt in zip(texts, langs, scores, unsure):
        x, loss = plain_features(t), []
        for word in model.code:  # the loss of each language's codeword against the bits' margins
            margins = [sum(a * b for a, b in zip(x, model.weights[:, k])) + model.bias[k] for k in range(len(word))]
            loss.append(sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, word)))
        order = sorted(range(4), key=lambda i: loss[i])
        assert lang == model.langs[order[0]] and abs(score - 1 / sum(math.exp(loss[order[0]] - v) for v in loss)) < 1e-4
        assert doubt == (loss[order[1]] - loss[order[0]] < language_id.AMBIGUOUS)


def test_odd_rows(spark):
    docs = documents(spark)
    model = language_id.learn(docs)
    out = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[1]["score"] == 0
    assert out[8]["lang_pred"] in model.langs and 0 <= out[8]["score"] <= 1
    none = language_id.learn(empty(spark))
    assert none.langs == [] and {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}
    single = language_id.OutputCodes(["en"])
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(docs, single).collect()} == {("en", 1.0), ("und", 0.0)}
    assert language_id.identify(empty(spark), model).count() == 0
