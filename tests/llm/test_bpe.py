import base64

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import bpe

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MULTI = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def public():
    """The public library's encoder over the same vocabularies: the brute force to compare with."""
    import public_tokenizers as P
    import tiktoken

    def make(path):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return {path: make(path) for path in (RANKS, MULTI)}


def encode(texts, path):
    out = [None] * len(texts)
    for a, b, tokens, off, same in bpe.encode_column(bpe.compiled(path), pa.array(texts, pa.string())):
        for k in range(a, b):
            out[k] = tokens[off[k - a] : off[k - a + 1]].tolist()
            assert same[k - a]
    return out


HARD = ["", " ", "  a", "it's we'll 'S", "a\n\n b\t\tc ", "<|endoftext|>", "日本語 русский é ß", " x", "👩‍👩‍👧 123 4,5", "x" * 3000, "ab" * 40 + " " * 500 + "z", "'''ll", "a'b c'd"]


@pytest.mark.parametrize("path", [RANKS, MULTI])
def test_equals_the_public_encoder(public, path):
    assert encode(HARD, path) == [public[path].encode_ordinary(t) for t in HARD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text_equals_the_public_encoder(public, texts):
    assert encode(texts, RANKS) == [public[RANKS].encode_ordinary(t) for t in texts]


def test_json_and_rank_files_are_the_same_vocabulary():
    assert encode(HARD, bpe.VOCABULARY) == encode(HARD, RANKS)


def test_small_automaton_by_hand():
    # a b c; merges ab, then bc, then abc from ab + c
    labels = {0: b"a", 1: b"b", 2: b"c", 3: b"ab", 4: b"bc", 5: b"abc"}
    machine = bpe.Automaton(labels, [(0, 1, 3), (1, 2, 4), (3, 2, 5)])
    buf = np.frombuffer(b"abcbcab", np.uint8)
    tokens, off = machine.encode_words(buf, np.array([0, 3, 5]), np.array([3, 5, 7]))
    assert tokens.tolist() == [5, 4, 3] and off.tolist() == [0, 1, 2, 3]


def test_table_round_trip_nulls_repeats_and_clashing_columns(spark, docs):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (None, "x y"), (3, ""), (4, "né " * 50_000)]
    encoded = bpe.encode(docs(rows, "token_ids n_tokens round_trip"))
    back = sorted(((r.doc_id, r.text) for r in bpe.decode(encoded).collect()), key=str)
    assert back == sorted(rows, key=str)
    by = {r.doc_id: r for r in encoded.collect()}
    assert by[2].token_ids is None and by[2].n_tokens is None and by[2].round_trip is None
    assert by[3].token_ids == [] and by[3].n_tokens == 0
    assert by[4].n_tokens == len(by[4].token_ids)
    assert bpe.encode(docs([])).count() == 0


def test_every_document_equals_the_public_encoder(spark, sf, public):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op1_bpe(spark, sf).collect():
        assert r.token_ids == public[RANKS].encode_ordinary(texts[r.doc_id])
