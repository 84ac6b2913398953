"""Token operators against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from benchcohort.llm import bpe
from benchcohort.llm.bpe import BpeModel, bpe_decode, bpe_encode
from benchcohort.llm.tokencount import TokenTransducer, count_tokens

from .data import SCHEMA, documents

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a<|endoftext|>B <|startoftext|><|endoftext|>", "ΑΣ ΣΑΣ. İI", "it's 's'S 'LL ''ll 're're 'r 'rx 've'vx 'lx '",
       "aaa aaaa " * 40, "é x y z\x85w\x1cq  \n\n \t a\n b  ", "<|endof", "Å K ẞ ﬁ ², ½ x²", "a" * 3000, " " * 3000,
       "-" * 2000 + "\n" * 700, "日本語テキスト。 ไทย 😀😀 👩‍👩‍👧"]


def odd_texts():
    rng = random.Random(3)
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    near = " \n'strevlmd1!aé　 "
    return ODD + ["".join(rng.choice(every) for _ in range(30)) for _ in range(300)] \
        + ["".join(rng.choice(near) for _ in range(700)) for _ in range(60)]


@pytest.fixture(scope="module")
def texts():
    return odd_texts() + [r[1] for r in documents() if r[1] is not None]


def test_bpe_equals_the_library(texts):
    model, library = BpeModel(WORD), Tokenizer.from_file(WORD)
    want = library.encode_batch(texts, add_special_tokens=False)
    n, ids = model.encode_batch(texts)
    decoded = [model.decode_joined(x) for x in ids]
    for k, e in enumerate(want):
        assert n[k] == len(e.ids) and ids[k] == " ".join(map(str, e.ids)), repr(texts[k][:80])
        assert decoded[k] == library.decode(e.ids, skip_special_tokens=False)
        assert model.decode(e.ids) == decoded[k]


def test_bpe_cache_of_two_generations_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 40)
    small, large = BpeModel(WORD), BpeModel(WORD)
    want = large.encode_batch(texts)
    got = [small.encode_batch([t]) for t in texts]
    assert [x for n, _ in got for x in n] == want[0] and [x for _, ids in got for x in ids] == want[1]
    assert small.decode_joined("5 99999999 6 x") == small.decode([5, 6]) and small.decode_joined(None) == ""


def test_bpe_query_columns_equal_the_library(spark, tmp_path):
    from benchcohort.llm.queries import QUERIES
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    library, sha = Tokenizer.from_file(WORD), lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(k), len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_transducer_equals_the_library(texts):
    library = Tokenizer.from_file(BYTE)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    data = [t.encode() for t in texts]
    transducer = TokenTransducer(BYTE)
    assert transducer.count_texts(data).tolist() == want
    assert [int(transducer.count_texts([d])[0]) for d in data[:40]] == want[:40]


def test_transducer_with_a_table_that_is_emptied_again_and_again(texts):
    library = Tokenizer.from_file(BYTE)
    part = texts[:30]
    want = [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
    assert TokenTransducer(BYTE, max_states=60).count_texts([t.encode() for t in part]).tolist() == want


def test_long_text_is_cut_at_any_byte(texts):
    library = Tokenizer.from_file(BYTE)
    transducer = TokenTransducer(BYTE)
    for filler in ("é", "word ", "x", "日本 "):
        long = filler * 4000
        assert int(transducer.count([long.encode()])[0]) == len(library.encode(long, add_special_tokens=False).ids)


def test_dataframes_handle_nulls_repeats_and_clashing_names(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score", "ids").withColumnRenamed("kept", "n_tokens")
    library, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    encoded = bpe_encode(docs, WORD)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids, r.decoded) for r in encoded.collect()))
    want = []
    for k, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k is None, k or 0, len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    back = {r.doc_id: r.decoded for r in bpe_decode(encoded, WORD).collect()}
    assert all(back[r.doc_id] == r.decoded for r in encoded.collect() if r.doc_id is not None)
    counted = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in count_tokens(docs, BYTE).collect())
    assert counted == sorted((k is None, k or 0, len((t or "").encode()), len(byte.encode(t or "", add_special_tokens=False).ids))
                             for k, t, *_ in rows)
    empty = docs.limit(0)
    assert bpe_encode(empty, WORD).count() == 0 and count_tokens(empty, BYTE).count() == 0
