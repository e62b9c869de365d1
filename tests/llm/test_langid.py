import base64

import numpy as np

from labelmill.llm import langid, queries
from labelmill.llm.text import crc_fold

HOW = langid.default_training()


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(HOW.vocabulary)
    with open(HOW.vocabulary, "rb") as f:
        known = {base64.b64decode(line.split()[0]): i for i, line in enumerate(f)}
    table = np.random.default_rng(0).random((pieces.n, 2))
    # Pieces and words of any length: one of the vocabulary's longest, and a word of over 48 bytes.
    words = [b" the", b" queue", " élève".encode(), b" x", b" responsibilities", b" responsibilities" + b"andantidisestablishmentarianism" * 2]
    got = langid.forward(pieces.found(words), table)
    for i, w in enumerate(words):
        sums = [np.ones(2), *[np.zeros(2) for _ in w]]
        for end in range(1, len(w) + 1):
            for start in range(end):
                if w[start:end] in known:
                    sums[end] = sums[end] + sums[start] * table[known[w[start:end]]]
        assert np.allclose(got[i, len(w)], sums[-1])


def test_expected_counts_explain_every_byte():
    pieces = langid.pieces_of(HOW.vocabulary)
    with open(HOW.vocabulary, "rb") as f:
        sizes = np.array([len(base64.b64decode(line.split()[0])) for line in f])
    words, counts = [b" the", b" queue"], np.array([3.0, 2.0])
    got = langid.expected(pieces.found(words), np.full((pieces.n, 1), 1 / pieces.n), counts)
    assert np.isclose(got @ sizes, 3 * 4 + 2 * 6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = queries.table(spark, sf, "documents").select("doc_id", "lang")
    rows = queries.op1_langid(spark, sf).join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (crc_fold(r["doc_id"], 5) == 0) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_rows(docs, no_docs):
    model = langid.train(docs, HOW)
    got = langid.identified(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert r["lang_pred"] in ("en", "fr", "und")
    nothing = langid.train(no_docs, HOW)
    assert {r["lang_pred"] for r in langid.identified(docs, nothing).collect()} == {"und"}
    assert langid.identified(no_docs, model).count() == 0


def test_long_word_of_an_unlearned_script_in_a_large_training():
    pieces = langid.pieces_of(HOW.vocabulary)
    with open(HOW.vocabulary, "rb") as f:
        known = {base64.b64decode(line.split()[0]): i for i, line in enumerate(f)}
    table = np.full((pieces.n, 2), HOW.floor)
    for lang, words in enumerate([(b" le", b" chat"), (b" the", b" cat")]):
        table[[known[w] for w in words], lang] += 1e12
    table /= table.sum(axis=0)
    long = "\u10d0\u10d1\u10d2\u10d3" * 8
    scorer = langid.Scorer(langid.Model(HOW.vocabulary, ("a", "b"), np.log([0.5, 0.5]), table))
    names, sure = scorer([f"the cat {long} the cat", f"le chat {long}", long])
    assert names[:2] == ["b", "a"] and np.allclose(sure, [1, 1, 0.5]) and np.isfinite(scorer.logs).all()
    # Both ways of summing agree where plain sums suffice, and the expected pieces of the long word spell it.
    short = pieces.found([b" the", " \u00e9l\u00e8ve".encode()])
    plain = langid.forward(short, table)
    with np.errstate(divide="ignore"):
        assert np.allclose(np.log(plain), langid.forward(short, np.log(table), langid.LOGS))
    sizes = np.zeros(pieces.n)
    sizes[list(known.values())] = [len(p) for p in known]
    words = langid.words_of(f"the {long}")
    got = langid.expected(pieces.found(words), table[:, 1:], np.array([2.0] + [3.0] * (len(words) - 1)))
    assert np.isclose(got @ sizes, 2 * 4 + 3 * sum(map(len, words[1:])))


def test_passes_bound_places_and_long_words_score(monkeypatch):
    monkeypatch.setattr(langid, "PASS_PLACES", 60)
    words = sorted([b" a" * n for n in (1, 1, 2, 5, 9, 9, 40, 3000)], key=len)
    ranges = list(langid.passes(words))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(words)))
    assert all(b - a == 1 or (b - a) * (len(words[b - 1]) + 1) <= 60 for a, b in ranges)
    pieces = langid.pieces_of(HOW.vocabulary)
    table = np.random.default_rng(1).random((pieces.n, 2))
    table /= table.sum(axis=0)
    scorer = langid.Scorer(langid.Model(HOW.vocabulary, ("a", "b"), np.log([0.5, 0.5]), table))
    names, sure = scorer(["ab" * 4000, "x"])
    assert np.isfinite(scorer.logs).all() and len(names) == 2 and all(0 < s <= 1 for s in sure)
