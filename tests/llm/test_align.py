"""Alignment and token counts against plain Python over whole encodes, and odd input."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from riskspark.llm import align, chunks, common, tokencount

A_PATH, B_PATH = align.paths(None, None)
SCHEMA = "doc_id long, text string, links string, n_a int, at string, grp int"
ODD = [
    "", " ", "  ", "a", "\n", "a\n", "\na", "a\n\nb", "a  b", " a", "a ", "a\tb \n c", "<|endoftext|> hi<|endoftext|>", "<s> x </s>", "<unk>", "<0x0A>",
    "▁ x", "a▁b", "x\x1cy", "日本 語\nか", "ﬁ Ａ é", "don't we'll 12,000's", "\U0001f600 \U0001f600\n\U0001f600", "﻿a b", "\x00 a", "a\r\nb", "\x85 \xa0 　"]


class Plain:
    """The contract by loops."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        want = b" " + text.encode()
        a = [(k, bytes(self.byte[c] for c in self.a.id_to_token(k))) for k in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in self.b.encode(text):
            piece = self.b.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()))
        same = b"".join(x for _, x in a) == want == b"".join(x for _, x in b)
        return (a, b) if same else ([], [])

    @staticmethod
    def ranges(side):
        out, at = [], 0
        for k, raw in side:
            out.append((k, at, at + len(raw)))
            at += len(raw)
        return out

    def row(self, text):
        a, b = map(self.ranges, self.tokens(text))
        ends = {e for _, _, e in a} & {e for _, _, e in b}
        groups, last = [], 0
        for end in sorted(ends):
            groups.append(([k for k, s, e in a if last < e <= end], [k for k, s, e in b if last < e <= end]))
            last = end
        links = [(next(k for k, _, e in a if e == end), next(k for k, _, e in b if e == end)) for end in sorted(ends)]
        overlaps = sum(s < f and t < e for _, s, e in a for _, t, f in b) if len(a) * len(b) < 100_000 else None
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        return len(a), len(b), len(groups), overlaps, hashlib.sha256(shown.encode()).hexdigest() if groups else "", links, groups


@pytest.fixture(scope="module")
def plain():
    return Plain()


def rows_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (None, "no id"), (5, "again"), (5, "again"), (3000, "word upon words " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA)


def test_alignment(spark, plain):
    rows = rows_of(spark)
    want = [(d, plain.row(t)) for d, t in rows]
    count = Counter(link for _, r in want for link in r[5])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    found = align.scored(align.align(frame(spark, rows))).collect()
    assert len(found) == len(rows)
    key = lambda r: tuple(repr(x) for x in r)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found), key=key)
    assert got == sorted(
        ((d, a, b, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha) for d, (a, b, g, _, sha, links, _) in want), key=key)
    overlaps = {r.doc_id: r.n_overlaps for r in found}
    assert all(o is None or d == 5 or overlaps[d] == o for d, (_, _, _, o, *_) in want)
    assert sum(r.n_groups > 0 for r in found) > 200 and any(r.n_groups == 0 and r.doc_id == 1000 + ODD.index("a▁b") for r in found)


def test_groups_are_given(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None)]
    found = align.tokens(frame(spark, rows)).orderBy("doc_id", "grp").collect()
    for d, t in rows:
        mine = [r for r in found if r.doc_id == d]
        groups = plain.row(t)[6]
        assert [(r.a_ids, r.b_ids) for r in mine] == groups and [r.grp for r in mine] == list(range(len(groups)))
        assert not mine or (mine[0].start == 0 and mine[-1].end == len(t.encode()) + 1 and all(x.end == y.start for x, y in zip(mine, mine[1:])))


@given(st.lists(st.text("ab' .,\n\t　é中1<|▁", max_size=60), max_size=4), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_segments_change_nothing(texts, chars):
    """Long texts are aligned in segments: any segment length gives the same row."""
    known = align.aligner(A_PATH, B_PATH)
    whole = align.summarise(texts, known)
    held, chunks.batches.__defaults__ = chunks.batches.__defaults__, (chars,)
    try:
        assert align.summarise(texts, known).equals(whole)
        assert tokencount.lengths(texts, B_PATH).tolist() == [len(x) for x in known.b.model.encode(texts)]
    finally:
        chunks.batches.__defaults__ = held


@pytest.mark.parametrize("lead,literal", [(False, False), (True, True), (True, False), (False, True)])
def test_chunks_equal_library(lead, literal):
    known = chunks.ByteLevel(A_PATH, lead, literal, keep=20)
    for _ in range(2):
        assert [known.encode(ODD).of(k).tolist() for k in range(len(ODD))] == known.whole_ids(ODD)
        assert known.lengths(ODD).tolist() == [len(x) for x in known.whole_ids(ODD)]


def test_pieces_equal_library():
    known = chunks.Pieces(B_PATH, keep=20)
    assert known.by_chunk
    assert [known.encode(ODD).of(k).tolist() for k in range(len(ODD))] == known.whole_ids(ODD)
    assert len(known.encode([]).ids) == 0


def test_counts(spark, plain):
    rows = rows_of(spark)
    found = tokencount.count(frame(spark, rows)).collect()
    want = [(d, len((t or "").encode()), len(plain.b.encode(t or ""))) for d, t in rows]
    key = lambda r: tuple(repr(x) for x in r)
    assert sorted([tuple(r) for r in found], key=key) == sorted([(*w, w[2] > 4096) for w in want], key=key)
    assert any(r.over_limit for r in found)
    byte = tokencount.count(frame(spark, rows), tokenizer=A_PATH, limit=3).collect()
    plain_a = Tokenizer.from_file(A_PATH)
    assert sorted([(r.doc_id, r.n_tokens) for r in byte], key=key) == sorted([(d, len(plain_a.encode(t or "", add_special_tokens=False).ids)) for d, t in rows], key=key)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert align.scored(align.align(none)).count() == 0 and tokencount.count(none).count() == 0 and align.tokens(none).count() == 0


def test_queries(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = {r.doc_id: r for r in common.QUERIES["op13_counts"](spark, "/root/testdata/sf0.01").collect()}
    assert {d: r.n_tokens for d, r in found.items()} == {d: len(plain.b.encode(t or "")) for d, t in rows}
    aligned = common.QUERIES["op12_align"](spark, "/root/testdata/sf0.01")
    assert aligned.count() == len(rows) and all(r.n_a and r.n_links == r.n_groups for r in aligned.where("doc_id < 50").collect() if dict(rows)[r.doc_id])
