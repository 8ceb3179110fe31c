"""Token counts of a byte-level BPE vocabulary (a tokenizers .json file), by prefix dynamic programming.

A piece (what the tokenizer's pattern cuts out) is encoded position by position: the encoding of its first i
bytes ends with exactly one token t such that t may follow the last token of the first i - len(t) bytes; a
pair of tokens may stand side by side if the bytes of both together encode to just these two. So one pass
yields the exact token count of every prefix, and the count of the whole at its end.

Texts are cut at single blanks and line feeds between other characters, where a piece always begins; these
chunks recur, and a worker keeps the results of CACHED of them. Chunks beside other white space are taken
together with it, by the pattern itself. Special strings (as <|endoftext|>) are one token, as the library's default has it.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted alike. Every character counts,
whatever a text's length; an empty table gives an empty one."""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, without

CACHED = 250_000


def _alphabet() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """A byte-level BPE vocabulary whose merges stand in the order of their ids (checked)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        spell = _alphabet()
        self.ranks = {bytes(spell[c] for c in t): i for t, i in model["vocab"].items()}
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(x >= y for x, y in zip(ids, ids[1:])):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.core = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.piece_ids = self.core._core_bpe.encode_single_piece
        self.longest = max(map(len, self.ranks))
        #: Every prefix of a token that encodes to itself: its id, or -1 where the prefix itself is no such token.
        self.heads: dict[bytes, int] = {}
        for t, i in self.ranks.items():
            if len(t) == 1 or self.piece_ids(t) == [i]:
                for end in range(1, len(t)):
                    self.heads.setdefault(t[:end], -1)
                self.heads[t] = i
        self.pairs: dict[int, bool] = {}
        self.pieces = _Kept(partial(_new_piece_counts, self))

    def may_follow(self, left: int, right: int) -> bool:
        if len(self.pairs) > 2 * CACHED:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self.piece_ids(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def prefix_tokens(self, piece: bytes) -> list[int]:
        """The token count of every prefix of one piece: n + 1 numbers, the first 0."""
        n, heads, pairs = len(piece), self.heads, self.pairs
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            left, count = last[start], counts[start] + 1
            for end in range(start + 1, n + 1):
                t = heads.get(piece[start:end])
                if t is None:
                    break
                if t >= 0 and not counts[end]:
                    ok = start == 0 or pairs.get(left << 20 | t)
                    if ok is None:
                        ok = self.may_follow(left, t)
                    if ok:
                        last[end], counts[end] = t, count
        return counts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def _at_characters(counts: list[int], text: str) -> list[int]:
    """The counts at the ends of a text's characters, from those at its bytes."""
    if text.isascii():
        return counts[1:]
    return [counts[i] for i in accumulate(len(c.encode()) for c in text)]


def _piece_counts(v: Vocabulary, piece: str) -> list[int]:
    return v.pieces[piece]


def _new_piece_counts(v: Vocabulary, piece: str) -> list[int]:
    counts = _at_characters(v.prefix_tokens(piece.encode()), piece)
    if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
        counts[1] = 2  # of 'll, 've and 're the first two characters are two pieces
    return array("i", counts)


def _run_counts(v: Vocabulary, text: str) -> list[int]:
    """The token count of every character prefix of ``text``, by the pattern; a run of white space before a word
    counts whole until the word's first letter comes, when its last character goes with or before the word."""
    out, base, pieces = [], 0, _pattern().findall(text)
    if not any(map(str.isspace, pieces)):
        for p in pieces:
            counts = _piece_counts(v, p)
            out += [base + c for c in counts] if base else counts
            base += counts[-1]
        return out
    i = 0
    while i < len(pieces):
        p = pieces[i]
        if p.isspace() and i + 1 < len(pieces):
            run = p
            while i + 1 < len(pieces) and pieces[i + 1].isspace():
                i += 1
                run += pieces[i]
            leads = i + 1 < len(pieces) and pieces[i + 1][0] == " "
            run += " " if leads else ""
            whole = _at_characters(v.prefix_tokens(run.encode()), run)
            out += [base + c for c in whole]
            if i + 1 < len(pieces):
                head = run[:-1]
                base += (whole[len(head) - 1] if head else 0) + (0 if leads else len(v.piece_ids(run[-1].encode())))
                if leads:
                    i += 1
                    word = pieces[i]
                    counts = _at_characters(v.prefix_tokens(word.encode()), word)
                    out += [base + c for c in counts[1:]]
                    base += counts[-1]
            i += 1
            continue
        counts = _piece_counts(v, p)
        out += [base + c for c in counts]
        base += counts[-1]
        i += 1
    return out


def _regular(chunk: str, first: bool) -> bool:
    """Whether a chunk neither begins nor ends in white space (but for the line feed that it is cut at)."""
    body = chunk[1:] if chunk[:1] == "\n" and not first else chunk
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


class _Kept(dict):
    """What ``make`` gives for a key, kept in two generations: once ``most`` keys are new, the older ones go."""

    def __init__(self, make, most: int = CACHED) -> None:
        self.make, self.old, self.most = make, {}, most

    def __missing__(self, key):
        if (out := self.old.get(key)) is None:
            out = self.new(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out

    def new(self, key):
        return self.make(key)


class _Chunks(_Kept):
    """A chunk that needs its neighbours raises LookupError."""

    def new(self, chunk: str):
        if not _regular(chunk, False):
            raise LookupError(chunk)
        return self.make(chunk if chunk[0] == "\n" else " " + chunk)


def _parts(text: str, chunks: _Chunks) -> Iterable:
    """The results of a text's chunks, in order."""
    cut = text.replace("\n", " \n").split(" ")
    if not _regular(cut[0], True):
        return [chunks.make(text)] if text else []
    try:
        return [chunks.make(cut[0]), *map(chunks.__getitem__, cut[1:])]
    except LookupError:
        return [chunks.make(text)]


def _by_special(text: str, special: Iterable[str]) -> list[tuple[str, str]]:
    """(plain text, the special string after it or "") until the text is over."""
    out = [(text, "")]
    for s in special:
        if s in text:
            out = [x for t, end in out for x in [*((y, s) for y in t.split(s)[:-1]), (t.split(s)[-1], end)]]
    return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        encode = self.v.core.encode_ordinary
        self.chunks = _Chunks(lambda s: struct.pack(f"<{len(ids := encode(s))}I", *ids))

    def __call__(self, text: str) -> bytes:
        if not any(s in text for s in self.v.special):
            return b"".join(_parts(text, self.chunks))
        out = []
        for plain, end in _by_special(text, self.v.special):
            out += [*_parts(plain, self.chunks), np.array([self.v.special[end]] if end else [], "<u4").tobytes()]
        return b"".join(out)


class PrefixCounter:
    """How the token count changes from each character prefix of a text to the next: one signed byte a character."""

    def __init__(self, path: str) -> None:
        self.v = vocabulary(path)
        if self.v.longest > 128:
            raise ValueError("a token is too long for steps of one byte")
        self.chunks = _Chunks(self._steps)

    def _steps(self, text: str) -> bytes:
        counts = _run_counts(self.v, text)
        return bytes([(y - x) & 255 for x, y in zip([0, *counts], counts)])

    def __call__(self, text: str) -> bytes:
        if not any(s in text for s in self.v.special):
            return b"".join(_parts(text, self.chunks))
        out = []
        for plain, end in _by_special(text, self.v.special):
            steps = b"".join(_parts(plain, self.chunks))
            out.append(steps)
            if end:  # a special string is ordinary text until its last character comes
                tail = np.array(_run_counts(self.v, plain + end[:-1]), np.int64)
                body = int(np.frombuffer(steps, np.int8).sum())
                counts = [body, *tail[len(plain) :].tolist(), body + 1]
                out.append(np.diff(np.array(counts, np.int64)).astype(np.int8).tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """A worker's own encoder, kept for its next tasks."""
    return _encoder(path)


def prefix_counts(df: DataFrame, text: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``, all by default) with n_bytes, n_tokens and steps: of every character, by how
    many tokens the count of the prefix that it ends differs from the one before (see ``tokens_at`` and
    ``longest_within``). Columns of these names are replaced. ``path``: the vocabulary file, at the same place on
    every executor."""
    added = ["n_bytes", "n_tokens", "steps"]
    kept = without(df.columns if keep is None else keep, added)
    schema = T.StructType([*df.select(*kept).schema.fields, *map(T.StructField, added, (T.LongType(), T.LongType(), T.BinaryType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counter(path)
        for b in batches:
            column = b.column(len(kept))
            sizes = pc.coalesce(pc.binary_length(column), 0).cast(pa.int64())
            steps = [of(t) if t else b"" for t in column.to_pylist()]
            totals = pa.array([int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], sizes, totals, pa.array(steps, pa.binary())], [*kept, *added])

    return df.select(*kept, F.col(text).alias(fresh("_text", kept))).mapInArrow(count, schema)


def tokens_at(steps: bytes, characters: int) -> int:
    """The exact token count of the text's first ``characters`` characters."""
    return int(np.frombuffer(steps, np.int8)[:characters].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """The most leading characters whose tokens fit ``budget`` (counts may fall as a word is completed)."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0
