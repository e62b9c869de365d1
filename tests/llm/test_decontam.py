import random

from labelmill.llm import decontam
from labelmill.llm.decontam import Budget, Finder


def distance(pattern, text):
    """Edits of the pattern against the best run of the text, by the full matrix."""
    above = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row = [i]
        for j, t in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (p != t)))
        above = row
    return min(above)


def test_finder_against_full_matrix():
    random.seed(2)
    budget = Budget()
    for _ in range(200):
        items = [(i, " ".join(random.choices("abcdefgh", k=random.randint(1, 14)))) for i in range(4)]
        words = random.choices("abcdefgh", k=random.randint(0, 40))
        words[5:5] = [w if random.random() > 0.15 else random.choice("abcdefgh") for w in random.choice(items)[1].split()]
        want = {}
        for i, text in items:
            item = text.split()
            if len(item) < budget.min_words:
                if item == words:
                    want[i] = 0
            elif distance(item, words) <= budget.edits(len(item)):
                want[i] = distance(item, words)
        assert {i: e for i, e, _ in Finder(items, budget)(" ".join(words))} == want


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_long_patterns_and_ends():
    words = [f"w{i}" for i in range(500)]
    found = Finder([(1, " ".join(words))], Budget())(" x ".join([" ".join(words[:250]), " ".join(words[250:])]))
    assert found == [(1, 1, 501)]


def test_awkward_rows(spark, docs, no_docs):
    items = items_of(
        spark,
        [(1, "Quick brown fox, jumps over the crazy dog; near the old river!"), (2, "one"), (3, None), (4, ""), (5, "word " * 6), (5, "word " * 6), (None, "ONE")],
    )
    got = sorted(tuple(r) for r in decontam.matches(docs, items).select("doc_id", "item_id", "edits").na.fill(-1).collect())
    assert got == sorted([(1, 1, 1), (2, 1, 1), (7, 5, 0), (7, 5, 0), *[(d, i, 0) for d in (8, 9, 9) for i in (2, -1)]])
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns
    ids = [r["doc_id"] for r in clean.collect()]
    assert sorted(ids, key=str) == sorted([3, 4, 5, 6, 10, None, 11], key=str)
    # Items in several blocks find the same.
    small = Budget(block_bytes=40)
    assert sorted(tuple(r) for r in decontam.matches(docs, items, small).select("doc_id", "item_id", "edits").na.fill(-1).collect()) == got
    assert decontam.matches(no_docs, items).count() == 0
    assert decontam.matches(docs, items.where("false")).count() == 0
    assert decontam.clean(docs, items.where("false")).count() == docs.count()


def test_short_items_and_scripts_without_spaces_beside_other_words():
    chinese = "\u6c34\u7684\u6cb8\u70b9\u662f\u591a\u5c11\u6444\u6c0f\u5ea6"
    thai, kana = "\u0e01\u0e02\u0e04\u0e07\u0e08", "\u3042\u3044\u3046\u3002\u3048\u304a"
    items = [(1, "What is 12 * 7?"), (2, "two words"), (3, chinese + "\uff1f"), (4, thai), (5, kana), (6, "yes")]
    find = Finder(items, Budget())
    ids = lambda text: {i for i, _, _ in find(text)}
    assert ids("Please tell: what is 12 * 7? Yes, it is 84.") == {1}
    assert ids("three two words here") == {2} and ids("two other words, what is 12") == set()
    assert ids(f"\u95ee\u9898\uff1a{chinese}\uff0c\u7b54\u6848") == {3}
    # One character in five may differ.
    assert [(i, e) for i, e, _ in find("\u95ee" + chinese.replace("\u591a", "\u51e0") + "\u7b54")] == [(3, 1)]
    assert ids(f"\u0e2d{thai}\u0e2d") == {4} and ids(f"\u30a2{kana}\u30a4") == {5}
    assert ids("Yes!") == {6}
