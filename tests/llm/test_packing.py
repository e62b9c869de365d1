import heapq
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import packing
from labelmill.llm.packing import Packing, Plan, default_packing, fill_up, padding, shortest_pack_first
from labelmill.llm.tokens import PieceEncoder

HISTOGRAMS = st.dictionaries(st.integers(1, 63), st.integers(0, 40), max_size=30)


def one_by_one(histogram, length):
    """Uses of the packs when every rest is placed by itself."""
    packs = []
    for rest in sorted(histogram, reverse=True):
        for _ in range(histogram[rest]):
            if packs and packs[0] + rest <= length:
                heapq.heapreplace(packs, packs[0] + rest)
            else:
                heapq.heappush(packs, rest)
    return Counter(packs)


@given(HISTOGRAMS)
@settings(deadline=None)
def test_patterns_equal_placing_one_by_one(histogram):
    found = Counter()
    for p in shortest_pack_first(histogram, 64):
        found[p.used] += p.count
    assert found == one_by_one(histogram, 64)


@given(HISTOGRAMS, st.sampled_from([0, 100]))
@settings(deadline=None)
def test_every_id_lies_in_one_place(histogram, slack):
    patterns = fill_up(shortest_pack_first(histogram, 64), 64, slack)
    plan = Plan(patterns)
    rests = np.array([r for r, n in histogram.items() for _ in range(n)], np.int64)
    ranks = np.array([i for n in histogram.values() for i in range(n)], np.int64)
    if not len(rests):
        assert not patterns
        return
    row, start, size, sequence, offset = plan.places(rests, ranks)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r, a, n, q, o in zip(*(x.tolist() for x in (row, start, size, sequence, offset))):
        by_doc[r].append((a, n))
        by_sequence[q].append((o, n))
    assert sorted(by_doc) == list(range(len(rests)))
    for lists, ends in ((by_doc, rests), (by_sequence, None)):
        for key, parts in lists.items():
            at = 0
            for a, n in sorted(parts):
                assert a == at and n > 0
                at += n
            assert at == ends[key] if ends is not None else at <= 64
    assert sorted(by_sequence) == list(range(plan.sequences))
    total = sum(padding(sum(n for _, n in parts), 64) for parts in by_sequence.values())
    assert total < max(64, slack + 1)


def test_billions_of_documents():
    histogram = {i: random.Random(i).randint(0, 10**9) for i in range(1, 2048)}
    ids = sum(k * n for k, n in histogram.items())
    plan = packing.make_plan(histogram, Packing("", slack=0.002), ids)
    assert plan.sequences * 2048 <= ids * 1.0021


def pieces_of(spark, docs, form):
    rows = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r) for r in packing.pack(docs, form).collect()]
    by_sequence = defaultdict(list)
    for _, ids, r in rows:
        assert len(ids) == r["length"] > 0
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= form.length
    return rows, by_sequence


@pytest.mark.parametrize("length", [64, 2048])
def test_documents_come_back(spark, docs, length):
    form = Packing(default_packing().tokenizer, length=length)
    rows, by_sequence = pieces_of(spark, docs.repartition(3), form)
    tokenizer = PieceEncoder(form.tokenizer).tokenizer
    want = Counter((r["doc_id"], *tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1) for r in docs.collect())
    # Rows that repeat an id have equal texts, so their pieces are alike.
    for (doc, *ids), n in want.items():
        tokens = Counter()
        for part, r in [(part, r) for d, part, r in rows if d == doc]:
            assert r["doc_tokens"] == len(ids)
            assert ids[r["start"] : r["start"] + len(part)] == part
            tokens.update(range(r["start"], r["start"] + len(part)))
        assert tokens == Counter({i: n for i in range(len(ids))}), doc
    used = [sum(n for _, n in parts) for parts in by_sequence.values()]
    assert sum(padding(u, length) for u in used) < length


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, by_sequence = pieces_of(spark, docs, default_packing())
    assert {d for d, _, _ in rows} == {r["doc_id"] for r in docs.collect()}
    used = [sum(n for _, n in parts) for parts in by_sequence.values()]
    assert sum(padding(u, 2048) for u in used) <= max(2047, 0.002 * sum(used))


def test_empty(spark, no_docs):
    assert packing.pack(no_docs, default_packing()).collect() == []


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(file):
    import public_tokenizers

    encoder, rng = PieceEncoder(public_tokenizers.path(file)), random.Random(4)
    letters = " \n\t  　ab'sé1!.,<|endoftext|>\r\u0085\x1cÜΣË§"
    ends = ["", " the of", " word. ,", "<|endoftext|>", "a.\nB", "\n\nThe.", "x\n y", "<|ENDOFTEXT|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) + rng.choice(ends) for _ in range(3000)] + [None, ""]
    ids, counts = encoder.encode(pa.array(texts))
    upto = np.cumsum(counts)
    for text, end, n in zip(texts, upto.tolist(), counts.tolist()):
        assert ids[end - n : end].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, text
