"""Token file and packing: exact round trips, contract figures by plain Python, odd input."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from riskspark.llm import chunks, packing, tokenfile

SCHEMA = "doc_id long, text string, part int, shard int, start string, items int"
ODD = ["a  b", " x", "x ", "a\n\nb", "a\tb \n c", "<|endoftext|> hi", "a　 b", "", "\n", "don't 12,000's  z", "x\x1cy z", "x\n y", "x \ny", "\x85 \xa0"]


def default_path():
    return chunks.path_of("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(default_path())


def ids_of(plain, text):
    return np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@given(st.lists(st.text("ab' .,\n\t　é中1<|", max_size=40), max_size=5))
@settings(max_examples=60, deadline=None)
def test_encoder_equals_library(texts):
    e = test_encoder_equals_library.__dict__.setdefault("e", chunks.ByteLevel(default_path(), keep=50))
    found = e.encode(texts)
    for k, t in enumerate(texts):
        assert found.of(k).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=30), max_size=6), st.integers(1, 400))
@settings(max_examples=60, deadline=None)
def test_shard_round_trip(docs, repeat):
    docs = [d * repeat for d in docs]
    names = [None if i == 2 else i - 3 for i in range(len(docs))]
    s = tokenfile.Shard(tokenfile.encode_shard(names, [np.array(d, "<u4").tobytes() for d in docs]))
    flat = [x for d in docs for x in d]
    assert s.ids().tolist() == flat
    assert [None if n else int(d) for d, n in zip(s.doc_ids, s.null)] == names
    if s.blocks > 1:
        assert s.ids(1, 2).tolist() == flat[tokenfile.BLOCK:2 * tokenfile.BLOCK]


def docs_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (None, "no id"), (5, "again"), (5, "again"), (3000, "word " * 60000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in rows], SCHEMA)


def test_token_file(spark, plain, tmp_path, monkeypatch):
    rows = docs_of(spark)
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 1 << 14)
    shards = tokenfile.write(frame(spark, rows), str(tmp_path / "file"))
    got = [tuple(r) for r in tokenfile.read_documents(shards).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(plain, t)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert shards.select("part", "shard").distinct().count() > 3


def test_packing(spark, plain):
    rows = docs_of(spark)
    got = packing.pack(packing.pieces(frame(spark, rows))).collect()
    want = []
    for d, t in rows:
        ids = ids_of(plain, t)
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        at, k = 0, 0
        while at < len(ids):
            end = first if k == 0 else at + 2048
            want.append((d, k, at, end - at, zlib.crc32(ids[at:end].tobytes())))
            at, k = end, k + 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.03 * sum(w[3] for w in want) / 2048 + 1


def test_evolution_beats_or_equals_its_start():
    lengths = [700, 640, 700, 650, 690, 700, 30, 600, 1400, 1300, 748, 648, 5, 2047, 1] * 12
    start = packing.Packing([], lengths, 2048).insert(list(range(len(lengths))))
    best = packing.from_assigned(packing.evolve(lengths, [], 2048, 1, generations=60)[0], lengths, 2048)
    assert best.score() <= start.score()
    assert sorted(i for b in best.bins for i in b) == list(range(len(lengths)))
    assert max(best.fill) <= 2048


def test_crossover_keeps_every_document_once():
    import random

    lengths = [random.Random(i).randint(1, 2000) for i in range(300)]
    a = packing.Packing([], lengths, 2048).insert(list(range(300)))
    b = packing.from_assigned(packing.evolve(lengths, [], 2048, 5, generations=3)[-1], lengths, 2048)
    child = packing.crossover(a, b, random.Random(1))
    assert sorted(i for x in child.bins for i in x) == list(range(300)) and max(child.fill) <= 2048


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tokenfile.read_documents(tokenfile.write(none)).count() == 0
    assert packing.pack(packing.pieces(none)).count() == 0
    one = none.unionByName(frame(spark, [(1, None)]))
    assert packing.pack(packing.pieces(one)).select("length", "offset").collect() == [(1, 0)]
    assert tokenfile.read_documents(tokenfile.write(one)).select("start", "n_tokens").collect() == [(0, 1)]


def test_encoder_works_in_small_steps_and_forgets():
    encoder = chunks.ByteLevel(chunks.path_of("byte_bpe_50k.json"))
    texts = [" ".join(f"w{k}x{i}" for i in range(9000)) for k in range(3)]
    library, most = encoder.tokenizer, []
    assert encoder.opens.any()  # asks the library once

    class Counted:
        def encode_batch_fast(self, some, **options):
            most.append(sum(map(len, some)))
            return library.encode_batch_fast(some, **options)

    encoder.tokenizer = Counted()
    found = encoder.encode(texts)
    assert max(most) < sum(map(len, texts)) / 2
    assert [found.of(k).tolist() for k in range(3)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.forget()
    assert not encoder.tails.place and not encoder.heads.place
