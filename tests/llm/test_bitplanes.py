import random

import numpy as np
import pyarrow as pa
import pytest

from labelmill.llm import bitplanes
from labelmill.llm.bitplanes import Format, default_format


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 1 << 24, 1001).astype("<u4")
    planes = bitplanes.to_planes(ids, 3, kind)
    assert len(planes) == (3 if kind == "byte" else 24)
    assert (bitplanes.from_planes(planes, len(ids), 3, kind) == ids).all()


def test_encoder_equals_the_tokenizer():
    random.seed(1)
    encode = bitplanes.Encoder(default_format().tokenizer)
    letters = " \n\t  　ab'sé1!.,<|endoftext|>\r\u0085\x1c"
    texts = ["".join(random.choices(letters, k=random.randint(0, 14))) + random.choice(["", " the of", " word. ,", "<|endoftext|>"]) for _ in range(3000)]
    for text, ids in zip(texts, encode(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_hold_every_document(spark, docs, planes):
    base = default_format()
    form = Format(base.tokenizer, planes=planes, chunk_ids=7, segment_ids=40)
    path = bitplanes.ids_folder(spark)
    bitplanes.write_ids(docs, path, form)
    read = bitplanes.read_ids(spark, path)
    encode = bitplanes.Encoder(base.tokenizer)
    want = [
        (r["doc_id"], encode.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()
    ]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in read.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    index = sorted(bitplanes.index_of(read).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in index] == sorted([d for d, _ in want], key=lambda d: (d is not None, d or 0))
    start = 0
    for r in index:
        assert r["start"] == start
        start += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in [(len(i), bitplanes.crc32_of(i)) for d, i in want if d == r["doc_id"]]


def test_empty(spark, no_docs):
    path = bitplanes.ids_folder(spark)
    bitplanes.write_ids(no_docs, path, default_format())
    assert bitplanes.index_of(bitplanes.read_ids(spark, path)).collect() == []
