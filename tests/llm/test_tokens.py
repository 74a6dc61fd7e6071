"""Packing, token counts, byte-level BPE: against the libraries themselves."""

import hashlib
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from .conftest import DOCS, key, sorted_rows
from tillroll.llm import byte_bpe, packing, token_counts

WORD = P.path("word_bpe_49k.json")
BYTE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


def ids_of(word, text):
    return word.encode(text or "", add_special_tokens=False).ids


def test_piece_lengths():
    for n in [1, 2, 3, 2047, 2048, 2049, 4096, 10_000]:
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(x & (x - 1) == 0 and x <= 2048 for x in lengths)
        assert lengths == sorted(lengths, reverse=True)


def test_pieces_hold_every_id_once(docs, word):
    rows = packing.pieces(docs, WORD).collect()
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, bytes(r.ids)))
    want = {}
    for i, t in DOCS:
        ids = ids_of(word, t) + [1]
        want.setdefault((i, len(ids)), []).append(ids)
    assert set(got) == set(want)
    for k, texts in want.items():
        whole = sorted(struct.pack(f"<{k[1]}I", *ids) for ids in texts)
        found = sorted(got[k])
        if len(texts) == 1:
            assert b"".join(x[2] for x in found) == whole[0]
        else:
            assert sum(x[1] for x in found) == k[1] * len(texts)


def test_sequences_are_unique_and_unpadded(docs):
    rows = packing.packed_digests(docs).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 for r in rows)
    raw = packing.pieces(docs, WORD).collect()
    assert sorted((r.length, r.ids_crc32) for r in rows) == sorted((r.length, zlib.crc32(bytes(r.ids))) for r in raw)


def test_token_counts(docs, word):
    got = sorted_rows(token_counts.token_counts(docs, WORD), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = sorted(((i, len((t or "").encode()), len(ids_of(word, t)), len(ids_of(word, t)) > 2048) for i, t in DOCS), key=key)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1' \n\t!é<|>", max_size=60), st.integers(1, 9))
def test_chunk_maps_compose(text, size):
    """Any cut of a text into chunks gives the tokens of the whole."""
    t = token_counts.CountTransducer(WORD)
    maps = t.maps([text[a:a + size] for a in range(0, len(text), size)])
    prefixes = t.scan(maps)
    tok = Tokenizer.from_file(WORD) if not hasattr(test_chunk_maps_compose, "tok") else test_chunk_maps_compose.tok
    test_chunk_maps_compose.tok = tok
    for k, m in enumerate(prefixes, 1):
        assert t.total(m) == len(tok.encode(text[:k * size], add_special_tokens=False).ids)


def test_maps_are_composed_without_prefixes():
    """A long text without white space: no prefix of its open word is kept."""
    t = token_counts.CountTransducer(WORD)
    text = "x" * 2_000_000
    maps = t.maps([text[a:a + 16_000] for a in range(0, len(text), 16_000)])
    tracemalloc.start()
    assert t.reduce(maps).head == text
    assert tracemalloc.get_traced_memory()[1] < 5 * len(text)
    tracemalloc.stop()
    t.scan = None  # counts() doesn't need it
    whole = "two words and a half " * 4000
    assert t.counts([whole, "", "x"]) == [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch([whole, "", "x"], add_special_tokens=False)]


def test_empty_tables(no_docs):
    assert packing.packed_digests(no_docs).count() == 0
    assert token_counts.token_counts(no_docs, WORD).count() == 0
    assert byte_bpe.encode(no_docs, BYTE, P.PATTERN).count() == 0


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks(BYTE), special_tokens={})


def test_byte_bpe_round_trip(docs, tik):
    found = byte_bpe.decode(byte_bpe.encode(docs, BYTE, P.PATTERN), BYTE)
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found.collect()), key=key)
    want = []
    for i, t in DOCS:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), struct.pack(f"<{len(ids)}I", *ids), (t or "").encode()))
    assert got == sorted(want, key=key)


def test_byte_bpe_of_a_derived_frame(docs, tik):
    """Not a scan: written to a table first."""
    few = docs.filter("doc_id < 8").orderBy("text")
    assert byte_bpe.encode(few, BYTE, P.PATTERN, stable=False).count() == sum(1 for i, _ in DOCS if i is not None and i < 8)


def test_blocks_of_equal_content(spark, tik):
    """Blocks with the same rows share a name and still come out whole."""
    rows = spark.createDataFrame([(1, "same words here")] * 6, "doc_id long, text string").repartition(3)
    assert {r.n_tokens for r in byte_bpe.encode(rows, BYTE, P.PATTERN).collect()} == {len(tik.encode_ordinary("same words here"))}
    assert byte_bpe.encode(rows, BYTE, P.PATTERN).count() == 6


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé1' \n\t!\u00a0\x1c", max_size=30))
def test_pre_tokens_match_the_pattern(text):
    import regex

    block = byte_bpe.Block(P.PATTERN)
    block.add(1, text)
    words, [(_, numbers)] = block.close()
    assert [words[i] for i in numbers] == regex.findall(P.PATTERN, text)


def test_packing_of_numbers():
    n = np.array([0, 1, 255, 256, 70_000, 2**31], np.int64)
    assert byte_bpe.unpack(byte_bpe.pack(n)).tolist() == n.tolist()
    assert byte_bpe.unpack_words(byte_bpe.pack_words(["", " é", "x"])) == ["", " é", "x"]
    assert byte_bpe.unpack_words(byte_bpe.pack_words([])) == []


def test_decoding_by_the_token_table(spark, tik):
    """The token table as a frame gives the same bytes as the join in tasks."""
    ids = tik.encode_ordinary("Any text, 漢字!")
    table = {r.id: bytes(r.bytes) for r in byte_bpe.token_bytes(spark, BYTE).filter(f"id in ({','.join(map(str, set(ids)))})").collect()}
    assert b"".join(table[i] for i in ids) == "Any text, 漢字!".encode()
    assert hashlib.sha256(b"".join(table[i] for i in ids)).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aBtsrev'’ 5½-_.<|>/̸́éİſ\t\n\x1c  4", max_size=24), max_size=5))
def test_word_ids_are_the_library_s(texts_given):
    from tillroll.llm import word_tokens
    path = WORD
    texts_given = [*texts_given, "<|endoftext|>" if len(texts_given) == 3 else "it's"]
    ids, at = word_tokens.WordIds(path).encode(texts_given)
    want = [word_tokens.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts_given]
    assert [ids[s:e].tolist() for s, e in zip(at, at[1:])] == want
