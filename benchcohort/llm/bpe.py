"""BPE encoding and decoding with a pair occurrence index.

A tokenizer file (a path, never copied) gives vocabulary, merges and the
end-of-word mark. Inside a task the texts of an Arrow batch are normalised and
cut into words; the words of the batch that were not met before are laid out
once as one array of symbols with links to their neighbours, and an index maps
each adjacent pair to all its positions in that array. Active ranks are applied
in ascending order from a heap: every listed position that still holds the pair
is merged, and only the lists of the two new neighbour pairs are extended. As
each merge makes a token of its own, a merge of rank r creates pairs of higher
rank only, so one sweep over ascending ranks equals merging word by word.

The work is one pass over the table, without shuffle: a task's memory holds a
batch, its symbols and two generations of a word cache, of ``CACHE_WORDS`` words
and those of a batch each: when the newer one is full it becomes the older one,
and words met again come back from there, so common words stay. Encoded words, ids and decoded text follow the tokenizer
file's own rules: special tokens found in a text are matched before
normalisation, letters are lower-cased after NFC, white space is dropped, and
decoding joins the tokens by blanks, as a file without decoder asks.

Defined results: a null or empty text has no tokens and empty id and decoded
strings; repeated rows give repeated rows; an empty table gives none; columns
that are not asked for are left out, so no name can clash.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: Words kept with their tokens by each Python worker.
CACHE_WORDS = 150_000
#: Most text (characters) of one output batch.
OUT_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class BpeModel:
    """Vocabulary, merges and cutting rules of a tokenizer file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None \
                or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True):
            raise ValueError(f"{path}: not a lower-casing BPE file with word ends")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.token_of = {i: t for t, i in vocab.items()}
        self.first = np.array([vocab[s] for s in byte_symbols()])
        self.last = np.array([vocab[s + end] for s in byte_symbols()])
        #: by rank: the pair and the token it makes; ranks by the left token and then the right one, and the other way
        self.made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.followed: dict[int, dict[int, int]] = {}
        self.preceded: dict[int, dict[int, int]] = {}
        for rank, (a, b, _) in enumerate(self.made):
            self.followed.setdefault(a, {})[b] = rank
            self.preceded.setdefault(b, {})[a] = rank
        if len({new for _, _, new in self.made}) != len(self.made):
            raise ValueError(f"{path}: a token is made by two merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of |= {i: t for t, i in self.special.items()}
        #: the same by the ids as text
        self.token_named = {str(i): t for i, t in self.token_of.items()}
        self.name_of = {i: str(i) for i in self.token_of}
        pairs = np.array([a << 32 | b for a, b, _ in self.made], np.int64)
        self.pair_order = np.argsort(pairs)  # ranks in the order of the pairs
        self.pairs = pairs[self.pair_order]
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.latin_words = latin_pattern(pattern)
        self.stand_in, self.lowered = newer_characters(path)
        self.newer = frozenset(map(chr, [*self.stand_in, *self.lowered]))
        self.back = {v: k for k, v in self.stand_in.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: word -> ids joined by blanks, in two generations
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def normalised(self, text: str) -> str:
        """NFC and lower case, each character by itself (no final sigma). White
        space is not collapsed, because no word contains any."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens stand for themselves."""
        if self.cut is None or "<" not in text:
            return self.words_of(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.words_of(part)
        return out

    def words_of(self, text: str) -> list[str]:
        if not text.isascii() and not self.newer.isdisjoint(text if len(text) < 64 else set(text)):
            plain = self.normalised(text).translate(self.lowered).translate(self.stand_in)
            return [w.translate(self.back) for w in self.words.findall(plain)]
        plain = self.normalised(text)
        if self.latin_words and is_latin(plain):
            return self.latin_words.findall(plain)
        return self.words.findall(plain)

    def pair_index(self, sym: np.ndarray, inside: np.ndarray) -> dict[int, list[int]]:
        """Rank -> places of its pair, for the neighbours that are in one word."""
        pair = sym[:-1] << 32 | sym[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        places = np.flatnonzero((self.pairs[at] == pair) & inside) if len(self.pairs) else np.zeros(0, np.int64)
        rank = self.pair_order[at[places]]
        order = np.argsort(rank, kind="stable")
        ranks, starts = np.unique(rank[order], return_index=True)
        return dict(zip(ranks.tolist(), (x.tolist() for x in np.split(places[order], starts[1:]))))

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        """Token ids of distinct words, by the pair occurrence index over all of them."""
        if not words:
            return []
        coded = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))
        data = np.frombuffer(b"".join(coded), np.uint8)
        symbols = self.first[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        last_of_word = np.zeros(len(data), bool)
        last_of_word[ends - 1] = True
        index = self.pair_index(symbols, ~last_of_word[:-1])
        after = np.where(last_of_word, -1, np.arange(1, len(data) + 1)).tolist()
        before = np.where(np.r_[True, last_of_word[:-1]], -1, np.arange(-1, len(data) - 1)).tolist()
        sym = symbols.tolist()
        followed, preceded, made = self.followed, self.preceded, self.made
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            a, b, new = made[rank]
            places = index.pop(rank)
            if a == b:
                places.sort()  # overlapping pairs merge from the left
            rights, lefts = followed.get(new), preceded.get(new)
            for i in places:
                j = after[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue
                k = after[j]
                sym[i], sym[j], after[i] = new, -1, k
                if k >= 0:
                    before[k] = i
                    if rights is not None and (rank := rights.get(sym[k])) is not None:
                        if rank in index:
                            index[rank].append(i)
                        else:
                            index[rank] = [i]
                            heapq.heappush(heap, rank)
                if lefts is not None and (h := before[i]) >= 0 and (rank := lefts.get(sym[h])) is not None:
                    if rank in index:
                        index[rank].append(h)
                    else:
                        index[rank] = [h]
                        heapq.heappush(heap, rank)
        left = np.array(sym)
        alive = left >= 0
        kept = np.r_[0, np.cumsum(alive)[ends - 1]].tolist()
        ids = left[alive].tolist()
        return [ids[i:j] for i, j in zip(kept, kept[1:])]

    def learn(self, texts: Sequence[list[str]]) -> None:
        """Bring the words of these texts into the newer generation of the cache."""
        met = set().union(*texts)
        unseen = met - self.cache.keys()
        if len(self.cache) + len(unseen) > CACHE_WORDS:
            self.older, self.cache = self.cache, {}
            unseen = met
        cache, older, name_of = self.cache, self.older, self.name_of
        for t, i in self.special.items():
            cache[t] = str(i)
        known = unseen & older.keys()
        cache.update((w, older[w]) for w in known)
        fresh = [w for w in unseen - known if w not in self.special]
        for w, ids in zip(fresh, self.encode_words(fresh)):
            cache[w] = " ".join([name_of[i] for i in ids])

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[list[int], list[str]]:
        """Numbers of tokens, and ids joined by blanks."""
        cut = [self.pieces(t) if t else [] for t in texts]
        self.learn(cut)
        cache = self.cache
        ids = [" ".join(map(cache.__getitem__, words)) for words in cut]
        return [x.count(" ") + 1 if x else 0 for x in ids], ids

    def decode_joined(self, ids: str | None) -> str:
        """Text of ids joined by blanks; ids outside the vocabulary are passed over."""
        names = (ids or "").split()
        try:
            return " ".join(map(self.token_named.__getitem__, names))
        except KeyError:
            return " ".join([self.token_named[i] for i in names if i in self.token_named])

    def decode(self, ids: Sequence[int]) -> str:
        """Text of token ids."""
        return self.decode_joined(" ".join(map(str, ids)))


def is_latin(text: str) -> bool:
    """No character beyond U+00FF."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Fixed value: the cutting pattern of the word-end BPE files.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The same cuts for texts below U+0100 with the character classes spelled out."""
    if pattern != WORD_END_PATTERN:
        return None
    latin = "".join(map(chr, range(256)))
    letters, digits, space = ("".join(map(re.escape, regex.findall(c, latin))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"[{letters}]+|[{digits}]|'(?:[stmd]|re|ve|ll)|[^{space}{letters}{digits}]+")


@functools.lru_cache(maxsize=2)
def newer_characters(path: str) -> tuple[dict[int, int], dict[int, int | str]]:
    """Characters that Python's Unicode tables do not have yet, where the regex
    module and the tokenizers library may be of different versions: those that
    the library does not count as letters or digits (with a private character
    that stands in for each while a text is cut), and their lower-case forms."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    letters = regex.compile(r"[\p{L}\p{N}]")
    young = [c for c in map(chr, range(0x370, 0x110000)) if unicodedata.category(c) == "Cn" and letters.match(c)]
    apart = [c for c in young if len(library.pre_tokenizer.pre_tokenize_str(f"a{c}")) > 1 and
             library.pre_tokenizer.pre_tokenize_str(f"!{c}")[0][1] == (0, 2)]
    lowered = {ord(c): low for c in young if (low := library.normalizer.normalize_str(c)) != c}
    return {ord(c): 0x100000 + k for k, c in enumerate(apart)}, lowered


@functools.lru_cache(maxsize=2)
def bpe_model(path: str) -> BpeModel:
    """The model of a file, loaded once by each Python worker."""
    return BpeModel(path)


def groups_of(texts: Sequence[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters together."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def bpe_encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus n_tokens, ids (decimal, joined by blanks) and decoded, the text
    that :func:`bpe_decode` makes of the ids."""
    picked = docs.select(*keep, text)
    schema = T.StructType([*(picked.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])
    n_keep = len(keep)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe_model(path)
        for batch in slices(batches):
            texts = batch.column(n_keep).to_pylist()
            for a, b in groups_of(texts, OUT_CHARS):
                n, ids = model.encode_batch(texts[a:b])
                decoded = list(map(model.decode_joined, ids))
                kept = [batch.column(c).slice(a, b - a) for c in range(n_keep)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=[*keep, "n_tokens", "ids", "decoded"])

    return picked.mapInArrow(encode, schema)


def bpe_decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` plus the decoded text of blank-joined ids (null: empty)."""
    picked = encoded.select(*keep, ids)
    schema = T.StructType([*(picked.schema[c] for c in keep), T.StructField("decoded", T.StringType())])
    n_keep = len(keep)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe_model(path)
        for batch in batches:
            texts = list(map(model.decode_joined, batch.column(n_keep).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(texts, pa.string())],
                                             names=[*keep, "decoded"])

    return picked.mapInArrow(decode, schema)
