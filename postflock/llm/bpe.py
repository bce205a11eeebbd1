"""Byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has one BPE encoding, and that encoding ends in
one token; the table ``last`` holds it for each prefix. A token that is a suffix
of the prefix is that last token exactly if the shorter prefix before it ends in
a token that may stand to its left. Whether two tokens may stand side by side is
a property of the two alone: undoing their merges from the youngest on must meet
no merge across the border that BPE would have made earlier. The table allows an
exact append (earlier entries stay) and an edit that redoes only what follows it
until the old encoding is met again.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .core import once_per_worker, pick

NONE = -1
#: Bits of a token in a pair of two.
SHIFT = 32
#: How many distinct chunks, pieces of the pattern and pairs of tokens a worker
#: remembers, and the same where it has other things to hold.
LIMITS, SMALL_LIMITS = (300_000, 1_000_000, 1_000_000), (120_000, 120_000, 300_000)
#: Rows passed on at a time.
ROWS = 500


class Vocabulary:
    """Ranks of a tiktoken file: ids are ranks, lower merges first."""

    def __init__(self, ranks: dict[bytes, int], borders: int = LIMITS[2]):
        self.ranks, self.borders = ranks, borders
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for word, rank in ranks.items():
            self.bytes_of[rank] = word
        self._parts: dict[int, tuple[int, int] | None] = {}
        # by left << SHIFT | right
        self._fits: dict[int, bool] = {}
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.longest = max(map(len, ranks), default=0)
        self.sizes = list(map(len, self.bytes_of))
        self._automaton()

    def _automaton(self) -> None:
        """Aho and Corasick's: a state is the longest end of what was read that begins
        a token. ``steps`` gives by state << 8 | byte the state after it, if that is one
        byte longer; ``fail`` the state of the longest shorter end; ``at`` the longest
        token at a state's end, and ``shorter`` the longest at a token's own end."""
        steps: dict[int, int] = {}
        self.steps, self.fail, self.at, self.shorter = steps, [0], [NONE], [NONE] * len(self.bytes_of)
        before, own = [(0, 0)], [NONE]
        for word, rank in self.ranks.items():
            if word and self.made(rank):
                state = 0
                for byte in word:
                    state, come = steps.setdefault(state << 8 | byte, len(own)), state
                    if state == len(own):
                        own.append(NONE)
                        before.append((come, byte))
                own[state] = rank
        self.fail, self.at = [0] * len(own), [NONE] * len(own)
        depth = [0] * len(own)
        for state in range(1, len(own)):
            depth[state] = depth[before[state][0]] + 1
        for state in sorted(range(1, len(own)), key=depth.__getitem__):
            come, byte = before[state]
            end = 0
            while come:
                come = self.fail[come]
                end = steps.get(come << 8 | byte, 0)
                if end:
                    break
            self.fail[state], self.at[state] = end, self.at[end]
            if own[state] >= 0:
                self.shorter[own[state]], self.at[state] = self.at[end], own[state]

    @classmethod
    def load(cls, path: str, borders: int = LIMITS[2]) -> "Vocabulary":
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(word): int(rank) for word, rank in pairs}, borders)

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and
        for tokens that no sequence of merges makes."""
        if token in self._parts:
            return self._parts[token]
        word, ranks = self.bytes_of[token], self.ranks
        run = [word[i : i + 1] for i in range(len(word))]
        while len(run) > 2:
            ranked = [(ranks.get(run[i] + run[i + 1], token), i) for i in range(len(run) - 1)]
            best, at = min(ranked)
            if best >= token:
                break
            run[at : at + 2] = [run[at] + run[at + 1]]
        found = (ranks[run[0]], ranks[run[1]]) if len(run) == 2 and all(x in ranks for x in run) else None
        self._parts[token] = found
        return found

    def made(self, token: int) -> bool:
        """Whether BPE of the token's bytes gives the token."""
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE keeps the two side by side: no merge across their border
        has priority over the merges that make them."""
        known = self._fits.get(left << SHIFT | right)
        if known is None:
            if len(self._fits) > self.borders:
                self._fits.clear()
            known = self._fits[left << SHIFT | right] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Time runs backwards: `before` is the moment (a merge's rank) up to which
        # the pair at the border stood next to each other unmerged. Of equal
        # moments BPE merges from the left, so a merge on the right side counts
        # as half a step later.
        before = 2 * len(self.bytes_of) + 2
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and 2 * across < before:
                # the bytes are a token, and these two are how it is made
                if self.parts(across) == (left, right):
                    return False
            of_left, of_right = self.parts(left), self.parts(right)
            when_left = 2 * left if of_left else -1
            when_right = 2 * right + 1 if of_right else -1
            if when_left < 0 and when_right < 0:
                return True
            if when_left > when_right:
                before, left = when_left, of_left[1]
            else:
                before, right = when_right, of_right[0]


class PrefixEncoder:
    """The table of one byte string, with exact appends and local edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last, self.state = vocabulary, b"", [NONE], 0
        self.append(data)

    def _entry(self, end: int) -> int:
        v, data, last = self.v, self.data, self.last
        for start in range(max(0, end - v.longest), end):
            token = v.ranks.get(data[start:end])
            if token is None or not v.made(token):
                continue
            if start == 0 or v.fits(last[start], token):
                return token
        raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Adds bytes; the entries there are stay as they are. Of the tokens that end
        at a byte, longest first, that is taken which may stand after what is before it."""
        v, last, state, end = self.v, self.last, self.state, len(self.data)
        steps, fail, at, shorter, sizes, known = v.steps.get, v.fail, v.at, v.shorter, v.sizes, v._fits.get
        for byte in more:
            found = steps(state << 8 | byte)
            while found is None and state:
                state = fail[state]
                found = steps(state << 8 | byte)
            state, end = found or 0, end + 1
            token = at[state]
            while token >= 0:
                left = last[end - sizes[token]]
                # none is left of the first token
                fits = True if left < 0 else known(left << SHIFT | token)
                if fits is None:
                    fits = v.fits(left, token)
                if fits:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError(f"no token ends at byte {end}: the vocabulary lacks a byte")
            last.append(token)
        self.data, self.state = self.data + more, state

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts ``new`` in place of bytes start..stop. Entries before the edit
        stay; after it they are redone until as many in a row as the longest
        token has bytes are what they were, from where all later ones are too."""
        old, kept, self.state = self.last, self.data[stop:], 0
        shift = len(new) - (stop - start)
        self.data, self.last = self.data[:start] + new + kept, self.last[: start + 1]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._entry(end))
            # an entry within the longest token of the edit may reach into it
            beyond = end - (start + len(new)) >= self.v.longest
            same = same + 1 if beyond and self.last[end] == old[end - shift] else 0
            if same >= self.v.longest:
                self.last += old[end - shift + 1 :]
                break
        for byte in self.data[-self.v.longest :] if self.v.longest else b"":  # no state reaches further back
            while self.state and self.state << 8 | byte not in self.v.steps:
                self.state = self.v.fail[self.state]
            self.state = self.v.steps.get(self.state << 8 | byte, 0)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.bytes_of[self.last[end]])
        return out[::-1]


class Encoder:
    """Whole texts, cut by a pattern; pieces are encoded by ``PrefixEncoder``.

    A chunk starts at a space after which no white space comes: every piece of
    the pattern ends before such a space, so chunks can be encoded one by one,
    and the ids of a chunk that comes again are kept (bounded by ``LIMITS``).
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, limits: tuple[int, int, int] = LIMITS):
        self.v, self.pattern = vocabulary, regex.compile(pattern)
        self.most_chunks, self.most_pieces, _ = limits
        self.wide = "<u2" if len(vocabulary.bytes_of) <= 1 << 16 else "<u4"
        self.unit = "H" if self.wide == "<u2" else "I"
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _pieces(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        if len(found) == 1:  # the chunk itself is kept
            return self.pieces.get(found[0]) or self._ids(found[0])
        try:
            return b"".join(map(self.pieces.__getitem__, found))
        except KeyError:
            return b"".join(map(self._piece, found))

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._ids(piece)
            if len(piece) <= 64:
                if len(self.pieces) >= self.most_pieces:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        # tiktoken gives a piece that is a token that token, merged or not
        whole = self.v.ranks.get(data)
        return self._packed([whole] if whole is not None else PrefixEncoder(self.v, data).ids())

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.unit}", *ids)

    def encode(self, text: str) -> np.ndarray:
        if SPACED.search(text):
            return np.frombuffer(self._pieces(text), self.wide)
        first, *rest = text.split(" ")
        kept = self.kept
        out = [self._pieces(first)]
        try:
            out += map(kept.__getitem__, rest)
        except KeyError:
            for chunk in rest[len(out) - 1 :]:  # from the first that is not kept on
                ids = kept.get(chunk)
                if ids is None:
                    ids = self._pieces(" " + chunk)
                    if len(kept) >= self.most_chunks:
                        kept.clear()
                    if len(chunk) <= 64:
                        kept[chunk] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), self.wide)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


SPACED = regex.compile(r" (?:\s|[\x1c-\x1f\x85]|$)")


def encoder(path: str, pattern: str, limits: tuple[int, int, int] = LIMITS) -> Encoder:
    return once_per_worker(("bpe", path, pattern, limits), lambda: Encoder(Vocabulary.load(path, limits[2]), pattern, limits))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """Ids of each text by BPE with the ranks in file ``vocabulary``.

    Returns a row for each row of ``docs`` (repeated rows stay): the key,
    n_tokens, ids_sha256 of the ids in decimal joined by commas and
    decoded_sha256 of the bytes that decoding these ids gives; with ``with_ids``
    also ids (array of int). A null text is as an empty one: no ids. A null key
    stays null. There is no limit on length: memory follows the longest text.
    ``vocabulary`` is a path that every executor has; ``limits`` bound what a worker
    remembers and change no result.
    """
    source = pick(docs, key=key, text=text)
    key_type = source.schema["key"].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches):
        coder = encoder(vocabulary, pattern, limits)
        number = coder.v.text_of
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            n, sha, back, all_ids = [], [], [], []
            for value in batch.column(1):
                found = coder.encode(value.as_py() or "")
                ids = found.tolist()
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(found.astype(np.int32))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)
