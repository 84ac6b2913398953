"""Token counts by a compiled finite-state transducer.

The cutting pattern and the merges of a byte-level BPE file together are one
deterministic transducer over UTF-8 bytes whose transitions carry the change in
the number of emitted tokens, so the count of a text is the sum along its path.
It is compiled from the file on demand, transition by transition, into a dense
table (state x byte -> next state and change), which all texts of a worker share.

A state holds what the future depends on: the pattern's mode; the longest
suffix of the open word that begins some longer token; for each position of
that suffix from which a token may still reach over, the last token of the
encoding that ends there and its count relative to now; and the bytes of an
unfinished character. A new token is appended where it and the last token
before it are a pair that the merges leave as it is, which makes the encoding of
every prefix unique: the step needs no look-back beyond the state.

Texts are cut into chunks of equal length at any byte, so one long text is work
for many lanes. A blank after a printable ASCII character puts the transducer
into one and the same state from any state, so the state map of a chunk is a
head up to its first such place, which depends on the entry, and a tail that
does not. Tails of all chunks run in lock step; a prefix scan composes the maps:
heads run in lock step as soon as the exit before them is known (chunks without
a reset pass the entry on), and all counts add up by text.

Work is one pass over the table without shuffle; a worker holds a few MB of
text, and a table of at most ``MAX_STATES`` states that is emptied when full.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
give repeated rows; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import texts_as_bytes

#: Bytes of a chunk, and of the texts that run in lock step together.
CHUNK, GROUP_BYTES = 512, 8_000_000
#: States of the table before it is emptied (128 transitions of 4 bytes each, or
#: 256 once a worker has met more than 128 different bytes).
MAX_STATES = 200_000
#: A transition is ``next state << 8 | change + BIAS``.
BIAS = 128
START, LETTER, DIGIT, OTHER, SPACE, QUOTE, QUOTE_R, QUOTE_L = range(8)
#: Fixed value: endings that the pattern keeps with an apostrophe.
SHORT, LONG = b"stmd", {QUOTE_R: b"e", QUOTE_L: b"l"}
#: An open word: (suffix, per position (last token, relative count) or None where nothing can reach over).
EMPTY = (b"", ((-1, 0),))
AFTER_BLANK_BYTES = frozenset(range(0x21, 0x7F))


class TokenTransducer:
    """The transducer of one byte-level BPE file, compiled as texts ask for it."""

    def __init__(self, path: str, max_states: int = MAX_STATES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"]:
            raise ValueError(f"{path}: not a byte-level BPE file")
        #: decides on characters that Python's Unicode tables do not have yet
        self.library = Tokenizer.from_file(path)
        byte_of = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        read = lambda token: b"".join(byte_of[c] for c in token)
        added = {t["content"] for t in spec["added_tokens"]}
        self.vocab = {read(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.rank = {(read(a), read(b)): k for k, (a, b) in enumerate(spec["model"]["merges"])}
        self.beginnings = {t[:k] for t in self.vocab for k in range(len(t))}
        self.special = sorted((t.encode() for t in added), key=len, reverse=True)
        self.apart: dict[tuple[int, int], bool] = {}
        self.kinds: dict[str, int] = {}
        self.max_states = max_states
        #: each byte's column of the table, in the order in which bytes were met
        self.column = np.full(256, -1, np.int64)
        self.met: list[int] = []
        self.shift = 7
        self.table = np.full(4096 << self.shift, -1, np.int32)
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.table.fill(-1)

    # -- the word automaton ------------------------------------------------
    def merged(self, data: bytes) -> list[bytes]:
        """Plain merging of a short byte string, used to compile pairs of tokens."""
        parts = [data[k:k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 30))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing) in an encoding."""
        got = self.apart.get((left, right))
        if got is None:
            a, b = self.bytes_of.get(left, b""), self.bytes_of[right]
            got = self.apart[left, right] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def step(self, word: tuple, byte: int) -> tuple[tuple, int]:
        """The open word after one more byte, and the change in its count."""
        suffix, ends = word
        longer = suffix + bytes([byte])
        for k, end in enumerate(ends):
            if end is not None and (token := self.vocab.get(longer[k:])) is not None and self.stay_apart(end[0], token):
                break
        else:
            raise ValueError(f"no token ends in {longer!r}")
        change = end[1] + 1
        now = [*(e and (e[0], e[1] - change) for e in ends), (token, 0)]
        live = [longer[j:] in self.beginnings for j in range(len(longer))] + [True]
        first = live.index(True)
        return (longer[first:], tuple(e if ok else None for e, ok in zip(now[first:], live[first:]))), change

    def feed(self, word: tuple, data: bytes) -> tuple[tuple, int]:
        change = 0
        for b in data:
            word, c = self.step(word, b)
            change += c
        return word, change

    # -- the pattern -------------------------------------------------------
    def kind(self, char: str) -> int:
        got = self.kinds.get(char)
        if got is None:
            got = (LETTER if regex.match(r"\p{L}", char) else DIGIT if regex.match(r"\p{N}", char)
                   else SPACE if regex.match(r"\s", char) else OTHER)
            if unicodedata.category(char) == "Cn":
                joined = [k for k, c in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!"))
                          if len(self.library.pre_tokenizer.pre_tokenize_str(c + char)) == 1]
                got = joined[0] if joined else SPACE
            self.kinds[char] = got
        return got

    def opened(self, before: bytes, char: bytes, kind: int) -> tuple[tuple, int]:
        """A new word; ``before`` is the blank that the pattern joins to it, or nothing."""
        if kind == SPACE:
            word, n = self.feed(EMPTY, char)
            return (SPACE, word, b"", (char, n)), n
        word, n = self.feed(EMPTY, before + char)
        mode = QUOTE if char == b"'" and not before else kind
        return (mode, word, b"", None), n

    def follow(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """Next state and change in the number of tokens if the text ended there."""
        mode, word, unread, last = state
        char = unread + bytes([byte])
        need = 1 if char[0] < 0x80 else 2 if char[0] < 0xE0 else 3 if char[0] < 0xF0 else 4
        if len(char) < need:
            return (mode, word, char, last), 0
        kind = self.kind(char.decode("utf-8"))
        if mode == SPACE:
            final, n = last
            if kind == SPACE:  # the run goes on
                word, change = self.feed(word, char)
                return (SPACE, word, b"", (char, change)), change
            if final == b" ":  # the run's last blank joins the word
                state, change = self.opened(b" ", char, kind)
                return state, change - n
            state, change = self.opened(b"", char, kind)
            return state, change - n + self.feed(EMPTY, final)[1]
        if mode == QUOTE:
            if char[0] in SHORT:  # closes at once; the next word starts afresh
                return (START, EMPTY, b"", None), self.feed(word, char)[1]
            if char in (b"r", b"v", b"l"):
                after, change = self.opened(b"", char, LETTER)
                return (QUOTE_L if char == b"l" else QUOTE_R, after[1], b"", (char, change)), change
        if mode in LONG and char == LONG[mode]:  # apostrophe and letter were counted as two words, now they are one
            apart = self.feed(EMPTY, b"'")[1] + last[1]
            return (START, EMPTY, b"", None), self.feed(EMPTY, b"'" + last[0] + char)[1] - apart
        same = {QUOTE: OTHER, QUOTE_R: LETTER, QUOTE_L: LETTER}.get(mode, mode)
        if kind == same:
            word, change = self.feed(word, char)
            return (kind, word, b"", None), change
        return self.opened(b"", char, kind)

    # -- the table ---------------------------------------------------------
    def state(self, state: tuple) -> int:
        got = self.number.get(state)
        if got is None:
            got = self.number[state] = len(self.states)
            self.states.append(state)
            if len(self.states) << self.shift > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
        return got

    def compile_missing(self, at: np.ndarray) -> None:
        """Fill in the transitions numbered ``state << shift | column``."""
        for x in np.unique(at).tolist():
            after, change = self.follow(self.states[x >> self.shift], self.met[x & (1 << self.shift) - 1])
            self.table[x] = self.state(after) << 8 | change + BIAS

    def columns(self, text: np.ndarray) -> np.ndarray:
        """Bytes as columns of the table, which widens when it must."""
        for b in np.flatnonzero(np.bincount(text, minlength=256) * (self.column < 0)).tolist():
            self.column[b] = len(self.met)
            self.met.append(b)
        if len(self.met) > 128 and self.shift == 7:
            self.shift = 8
            wide = np.full((len(self.table) >> 7, 256), -1, np.int32)
            wide[:, :128] = self.table.reshape(-1, 128)
            self.table = wide.ravel()
        return self.column[text]

    def run(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, entry: list[tuple]) -> tuple[list[tuple], np.ndarray]:
        """Run lanes ``text[start:end]`` (columns) in lock step; exit states and changes."""
        order = np.argsort(start - end, kind="stable")
        start, length = start[order], (end - start)[order]
        now = np.array([self.state(entry[k]) for k in order.tolist()], np.int64)
        total = -BIAS * length
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        for k, m in enumerate(active.tolist()):
            at = now[:m] << self.shift
            at += text[start[:m] + k]
            got = self.table[at]
            if got.min() < 0:
                if len(self.states) > self.max_states:
                    held = [self.states[s] for s in now.tolist()]
                    self.clear()
                    now = np.array([self.state(s) for s in held], np.int64)
                    at = (now[:m] << self.shift) + text[start[:m] + k]
                    got = self.table[at]
                self.compile_missing(at[got < 0])
                got = self.table[at]
            now[:m] = got >> 8
            got &= 255
            total[:m] += got
        exits: list[tuple] = [()] * len(order)
        for k, s in zip(order.tolist(), now.tolist()):
            exits[k] = self.states[s]
        changes = np.empty(len(order), np.int64)
        changes[order] = total
        return exits, changes

    def count(self, texts: Sequence[bytes]) -> np.ndarray:
        """Number of tokens of each text, by chunk state maps and their composition."""
        text = np.frombuffer(b"".join(texts), np.uint8)
        length = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(length) - length
        chunks = -(-length // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        start = first[owner] + CHUNK * (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
        end = np.minimum(start + CHUNK, (first + length)[owner])
        if not len(start):
            return np.zeros(len(texts), np.int64)
        opens = np.r_[True, owner[1:] != owner[:-1]]
        # resets: just after a blank that follows a printable ASCII character
        reset = np.flatnonzero((text[1:] == 32) & (text[:-1] > 32) & (text[:-1] < 127)) + 2
        at = np.searchsorted(reset, start + 2)  # the pair of bytes lies in this chunk
        found = np.r_[reset, len(text) + CHUNK][at]
        has = (found <= end) & ~opens
        found = np.where(opens, start, np.where(has, found, end))
        text = self.columns(text)
        blank, _ = self.opened(b"", b" ", SPACE)
        begin = (START, EMPTY, b"", None)
        constant = opens | has
        tails = np.flatnonzero(constant)
        exits, changes = self.run(text, found[tails], end[tails], [begin if o else blank for o in opens[tails]])
        counts = np.bincount(owner[tails], changes, minlength=len(texts)).astype(np.int64)
        leaves: list[tuple | None] = [None] * len(owner)
        for k, s in zip(tails.tolist(), exits):
            leaves[k] = s
        heads = np.flatnonzero(~opens)
        while len(heads):  # one round, plus one for each chunk in a row that has no reset
            ready = np.array([leaves[k - 1] is not None for k in heads.tolist()])
            now, heads = heads[ready], heads[~ready]
            exits, changes = self.run(text, start[now], found[now], [leaves[k - 1] for k in now.tolist()])
            counts += np.bincount(owner[now], changes, minlength=len(texts)).astype(np.int64)
            for k, s in zip(now.tolist(), exits):
                if not constant[k]:
                    leaves[k] = s
        return counts

    def count_texts(self, texts: Sequence[bytes | None]) -> np.ndarray:
        """As ``count``, with special tokens inside texts taken as one token each."""
        parts: list[bytes] = []
        owner: list[int] = []
        extra = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            split = [t] if t else []
            for s in self.special:
                split = [p for x in split for p in x.split(s)] if any(s in x for x in split) else split
            if t and len(split) > 1:
                extra[k] = len(split) - 1
            parts += split
            owner += [k] * len(split)
        return extra + np.bincount(owner, self.count(parts), minlength=len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def token_transducer(path: str) -> TokenTransducer:
    """The transducer of a file, shared by all tasks of a Python worker."""
    return TokenTransducer(path)


def count_tokens(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus n_bytes and n_tokens."""
    picked = docs.select(*keep, text)
    schema = T.StructType([*(picked.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])
    n_keep = len(keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = token_transducer(path)
        for batch in batches:
            texts = texts_as_bytes(batch.column(n_keep))
            sizes = [len(t or b"") for t in texts]
            n = np.zeros(len(texts), np.int64)
            a = held = 0
            for k, size in enumerate(sizes):
                held += size
                if held >= GROUP_BYTES or k == len(sizes) - 1:
                    n[a:k + 1] = transducer.count_texts(texts[a:k + 1])
                    a, held = k + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(sizes, pa.int64()), pa.array(n)],
                                             names=[*keep, "n_bytes", "n_tokens"])

    return picked.mapInArrow(count, schema)
