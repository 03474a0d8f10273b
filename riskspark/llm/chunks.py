"""Token ids of whole texts through their space-delimited chunks, column by column.

Neither vocabulary kind used here joins pieces across a space that stands between two visible characters, nor across a
line break between two visible characters.  A batch of texts is split there by Arrow, its distinct chunks are found by
Arrow, only chunks new to the worker are encoded, and the ids of all texts are gathered with numpy.  Texts with other
white space at these places go to the library whole, as do all texts of a tokenizer for which the rule does not hold.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from typing import NamedTuple

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402

CHARS = 4_000_000
AT_ONCE = 1_000_000
KEEP = 600_000


class Ids(NamedTuple):
    """Ids of some texts: text k has ids[starts[k]:starts[k + 1]]."""

    ids: np.ndarray
    starts: np.ndarray

    def of(self, k: int) -> np.ndarray:
        return self.ids[self.starts[k]:self.starts[k + 1]]


def gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[first[k]:first[k] + sizes[k]] for all k, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - sizes), sizes) + np.arange(total)]


#: A space between two visible characters: no tokenizer used here joins pieces over it.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, chars: int = CHARS) -> list[str]:
    """Parts of a long text, cut at safe spaces, which go; about ``chars`` characters each (more where no such space is)."""
    out, at = [], 0
    while len(text) - at > chars:
        cut = SAFE.search(text, at + chars)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.end()
    return [*out, text[at:]]


def batches(texts: list[str | None], chars: int = CHARS):
    """(owner, segment) lists of about ``chars`` characters each; a null text is empty."""
    owners, parts, size = [], [], 0
    for k, text in enumerate(texts):
        for part in segments(text or "", chars):
            if parts and size + len(part) > chars:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(k)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


class Places(dict):
    """Chunk -> number in order of first sight."""

    def __missing__(self, chunk: str) -> int:
        k = self[chunk] = len(self)
        return k


class Known:
    """Chunks met so far, each with its ids; ``encode`` gives the ids and sizes of new ones."""

    def __init__(self, encode, keep: int = KEEP):
        self.encode, self.keep = encode, keep
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0
        self.first, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """Number of each chunk; new ones are encoded."""
        before = len(self.place)
        found = np.array(list(map(self.place.__getitem__, chunks)), np.int64)
        n = len(self.place)
        if n > before:
            ids, size = self.encode(list(itertools.islice(self.place, before, None)))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
            while n > len(self.first):
                self.first, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.first, self.size))
            self.ids[self.used:self.used + len(ids)] = ids
            self.first[before:n] = self.used + np.cumsum(size) - size
            self.size[before:n] = size
            self.used += len(ids)
        return found

    def trim(self) -> None:
        if len(self.place) > self.keep:
            self.clear()


def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in found], np.int64)
    return np.array(list(itertools.chain.from_iterable(found)), "<u4"), sizes


#: White space that no split deals with, and runs, starts and ends of white space.
ODD = (
    r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]"
    r"|[\x{9}\x{b}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


class Chunked:
    """Base of the encoders.  ``tail_ids`` gives ids and sizes of chunks that follow a space or begin with a line break,
    ``head_ids`` of those that begin a text; ``whole_ids`` asks the library.  Texts that match ``odd`` are never split."""

    by_chunk = True
    odd = ODD

    def __init__(self, keep: int = KEEP):
        self.tails, self.heads = Known(self.tail_ids, keep), Known(self.head_ids, keep)

    def encode(self, texts: list[str]) -> Ids:
        """Ids of all texts; at most ``AT_ONCE`` characters are split at a time, as chunks take many times their text."""
        parts, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= AT_ONCE):
                chars += len(texts[end])
                end += 1
            parts.append(self._some(texts[at:end]))
            at = end
        return parts[0] if len(parts) == 1 else self._joined(
            [p.ids for p in parts], np.concatenate([np.empty(0, np.int64)] + [np.diff(p.starts) for p in parts]))

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Ids per text; nothing else is built of texts that can be split."""
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False) if self.by_chunk else np.ones(len(texts), bool)
        out = np.zeros(len(texts), np.int64)
        whole = np.nonzero(odd)[0].tolist()
        for k, ids in zip(whole, self.whole_ids([texts[k] for k in whole])):
            out[k] = len(ids)
        if not odd.all():
            at, _, size, _ = self._chunks(column.filter(pa.array(~odd)))
            out[~odd] = np.add.reduceat(size, at)
            self._trim()
        return out

    @staticmethod
    def _joined(ids: list[np.ndarray], sizes: np.ndarray) -> Ids:
        return Ids(np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))))

    def _some(self, texts: list[str]) -> Ids:
        column = pa.array(texts, pa.large_string())
        if self.by_chunk:
            whole = np.nonzero(pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False))[0].tolist()
        else:
            whole = list(range(len(texts)))
        if not whole:
            return self._split(column)
        rest = np.setdiff1d(np.arange(len(texts)), whole)
        asked = [np.asarray(x, "<u4") for x in self.whole_ids([texts[k] for k in whole])]
        if not len(rest):
            return self._joined(asked, np.array([len(x) for x in asked], np.int64))
        split = self._split(column.take(pa.array(rest)))
        by_row = dict(zip(whole, asked)) | {k: split.of(i) for i, k in enumerate(rest.tolist())}
        ids = [by_row[k] for k in range(len(texts))]
        return self._joined(ids, np.array([len(x) for x in ids], np.int64))

    def _chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First chunk of each text; first id and number of ids of each chunk, and what the first ids point into."""
        # a line break goes to the head of the chunk behind it
        split = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        at = split.offsets.to_numpy().astype(np.int64)[:-1]
        coded = split.values.dictionary_encode()
        names, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        row = self.tails.rows(names)[index]
        first, size, source = self.tails.first[row], self.tails.size[row], self.tails.ids
        if self.head_ids != self.tail_ids:  # no space stands before the chunk that begins a text
            head = self.heads.rows([names[k] for k in index[at].tolist()])
            source = np.concatenate((source[:self.tails.used], self.heads.ids[:self.heads.used]))
            first[at], size[at] = self.heads.first[head] + self.tails.used, self.heads.size[head]
        return at, first, size, source

    def forget(self) -> None:
        """Drop the chunks met so far, as a task does at its end: the worker then serves tasks that do not need them."""
        self.tails.clear()
        self.heads.clear()

    def _trim(self) -> None:
        self.tails.trim()
        self.heads.trim()

    def _split(self, column: pa.Array) -> Ids:
        at, first, size, source = self._chunks(column)
        out = Ids(gathered(source, first, size), np.concatenate(([0], np.cumsum(np.add.reduceat(size, at)))))
        self._trim()
        return out


class ByteLevel(Chunked):
    """Byte-level BPE by the tokenizers library.  ``lead`` puts a space before every text; ``literal`` makes the strings
    of special tokens ordinary text."""

    JOINED, TEXTS = 512, 16

    def __init__(self, path: str, lead: bool = False, literal: bool = False, keep: int = KEEP):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.by_chunk = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        if not literal:
            self.odd = "|".join([ODD, *(r"\Q" + t["content"] + r"\E" for t in spec.get("added_tokens") or ())])
        self.lead = lead
        if lead:
            self.head_ids = self.tail_ids
        super().__init__(keep)

    def whole_ids(self, texts: list[str]) -> list[list[int]]:
        texts = [" " + t for t in texts] if self.lead else texts
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def tail_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks go to the library as one text, ``TEXTS`` of them at a time, as what it returns takes far more than the ids
        do: a chunk's first id is the one that begins with white space."""
        found = []
        for at in range(0, len(chunks), self.JOINED * self.TEXTS):
            spaced = [c if c[0] == "\n" else " " + c for c in chunks[at:at + self.JOINED * self.TEXTS]]
            texts = ["".join(spaced[k:k + self.JOINED]) for k in range(0, len(spaced), self.JOINED)]
            found.append(flat([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])[0])
        ids = np.concatenate([np.empty(0, "<u4"), *found])
        first = np.nonzero(self.opens[ids])[0]
        return ids, np.diff(np.append(first, len(ids)))

    def head_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat([e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])

    @functools.cached_property
    def opens(self) -> np.ndarray:
        return np.array([b[:1] in (b" ", b"\n") for b in self.token_bytes])

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        """Bytes of each id, by the byte-level alphabet."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
        out = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items():
            out[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        return out


SPACE = "▁"


class Pieces(Chunked):
    """SentencePiece by its own library, which puts a space before every text.

    Chunks stand alone if the vocabulary has no piece with a space behind a visible character or with a line break, and
    if a trial text comes back unchanged, so no normalisation joins or drops white space.
    """

    def __init__(self, path: str, keep: int = KEEP):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        trial = "a  b\nﬁ Ａ\n\nc "
        self.by_chunk = (
            not any("\n" in v or SPACE in v.lstrip(SPACE) for v in vocabulary)
            and b"".join(self.bytes_of(vocabulary[k]) for k in self.model.encode(trial)) == b" " + trial.encode())
        self.vocabulary = vocabulary
        self.head_ids = self.tail_ids
        super().__init__(keep)

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(SPACE, " ").encode()

    def whole_ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def tail_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library puts a space before each chunk, which goes again before a line break."""
        return flat([ids[1:] if c[0] == "\n" else ids for c, ids in zip(chunks, self.whole_ids(chunks))])

    @functools.cached_property
    def token_bytes(self) -> list[bytes]:
        return [self.bytes_of(v) for v in self.vocabulary]


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def byte_level(path: str, lead: bool = False, literal: bool = False) -> ByteLevel:
    """One encoder per worker and vocabulary."""
    return ByteLevel(path, lead, literal)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)
