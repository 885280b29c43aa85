import numpy as np

from vecstrata.llm import langid

ROWS = [(f"the cat and the dog are here with {i} friends of the house", "en") for i in range(40)] + [
    (f"el gato y los perros están aquí con {i} amigos de la casa", "es") for i in range(40)
]


def test_learns_and_rejects_nothing_without_letters():
    model = langid.train(ROWS)
    assert model.predict("the friends of the dog")[0] == "en"
    assert model.predict("los amigos de la casa")[0] == "es"
    for text in (None, "", "123 ... !"):
        assert model.predict(text) == ("und", 0.0, True)
    assert 0 <= model.predict("é")[1] <= 1


def test_a_long_text_in_pieces_is_a_whole_text(monkeypatch):
    model = langid.train(ROWS)
    text = "the dog and " * 50
    whole = model.logits(text)
    monkeypatch.setattr(langid, "_PIECE", 64)
    assert abs(model.logits(text) - whole).max() < 0.2


def test_logits_match_brute_force():
    """Means of embeddings gathered n-gram by n-gram, for both layouts of the model."""
    few = langid.train(ROWS)
    many = langid.train([(f"{t} {c}x{c}", f"{lang}{c}") for c in "abcdefghij" for t, lang in ROWS[::5]])
    assert few.head is None and many.head is not None
    text = "El Gato, 7 amigos -- the house é"
    data = b" " + bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in text.encode()) + b" "
    rows = []
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            h = int.from_bytes(data[i : i + n], "little") * (2654435761 + 2 * 7919 * n) % (1 << 32) >> 17
            rows.append(h)
    for model in (few, many):
        mean = np.mean([model.table[h] for h in rows], axis=0, dtype=np.float64)
        want = (mean if model.head is None else mean @ model.head) + model.bias
        assert np.allclose(model.logits(text), want, atol=1e-5)
        p = np.exp(want / model.temperature) / np.exp(want / model.temperature).sum()
        assert np.isclose(model.predict(text)[1], p.max(), atol=1e-5) and model.predict(text)[0] == model.langs[int(p.argmax())]


def test_no_labels():
    assert langid.train([]).predict("abc") == ("und", 0.0, True)


def test_held_out_accuracy_and_no_leak(spark, sf):
    from vecstrata.llm.queries import op5_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_frame_edges(spark):
    docs = spark.createDataFrame([(1, "the dog", "en", "x"), (1, "the dog", "en", "x"), (None, None, None, None)], "doc_id long, text string, lang string, score string")
    model = langid.train(langid.training_rows(docs))
    assert sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(docs, model).collect()) == [(0, "und"), (1, "en"), (1, "en")]
    assert langid.training_rows(docs.limit(0)) == []


def test_training_rows_are_even_over_many_languages(spark):
    rows = [(f"text {i} of {k}", f"l{k:02d}") for k in range(30) for i in range(1000 if k < 15 else 30)] + [("long text " * 5000, "zz")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    count = {}
    for text, lang in langid.training_rows(docs, per_lang=60, rows=900):
        assert 0 < len(text) <= langid.TRAIN_CHARS
        count[lang] = count.get(lang, 0) + 1
    assert count == {f"l{k:02d}": 29 for k in range(30)} | {"zz": 1}
