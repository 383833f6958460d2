"""Byte-level BPE against the library."""

from __future__ import annotations

import hashlib
import os
import random
import sys
from array import array

import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_operators import LONG, ODD, SCHEMA  # noqa: E402

from arbordex.llm import byte_pairs  # noqa: E402
from arbordex.llm.queries import QUERIES  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"abcdestvr  \n\t',.0189", "é", "ß", "漢", "　", "\x1c", "\x85", "🎉", "<|endoftext|>", "'re", "\xa0"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.PairEncoder(PATH)


def ids_of(library, texts):
    return [array("I", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def test_odd_strings_give_the_librarys_ids(library, encoder):
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(5000)]
    want = ids_of(library, texts)
    assert [encoder.encode(t) for t in texts] == want
    assert [encoder.decode(w) for w in want] == texts


def test_every_kind_of_code_point_is_cut_as_the_library_cuts(library, encoder):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000][::23] + [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x180E, 0x200B, 0x2028]
    texts = [f"a{chr(c)}1 {chr(c)}b{chr(c)}{chr(c)} x" for c in points]
    assert [encoder.encode(t) for t in texts] == ids_of(library, texts)


def test_any_ids_decode_as_the_library_decodes(library, encoder):
    rng = random.Random(6)
    for _ in range(500):
        ids = rng.choices(range(50_257), k=rng.randrange(12))
        assert encoder.decode(array("I", ids).tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert encoder.decode(array("I", [60_000, 0]).tobytes()) == "!"


def test_array_and_heap_agree(encoder):
    rng = random.Random(7)
    for _ in range(3000):
        word = bytes(rng.choices(b"aeinrst hot", k=rng.randrange(1, 40)))
        assert encoder._scan(word) == encoder._heap(word)


@pytest.mark.parametrize("name", list(LONG))
def test_long_texts(library, encoder, name):
    assert encoder.encode(LONG[name]) == ids_of(library, [LONG[name]])[0]


def test_a_small_memory_changes_nothing(library):
    small = byte_pairs.PairEncoder(PATH, memo_chars=50)
    texts = [r[1] or "" for r in ODD]
    assert [small.encode(t) for t in texts] == ids_of(library, texts)
    assert small.chars < 1_000_000


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        byte_pairs.PairEncoder(public_tokenizers.path("word_bpe_49k.json"))


def want_rows(library, rows):
    texts = [t or "" for _, t in rows]
    return sorted(((d, len(i) // 4, sha(i), sha(t.encode())) for (d, _), t, i in zip(rows, texts, ids_of(library, texts), strict=True)), key=repr)


def test_query(spark, sf_dir, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_byte_pairs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == want_rows(library, rows)


def test_odd_rows_ids_and_no_rows(spark, library):
    big = [((1 << 53) + 1, "a"), (None, "b"), ((1 << 53) + 3, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in [(r[0], r[1]) for r in ODD] + big], "doc_id long, text string, ids string, n_tokens long").coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    assert sorted(map(tuple, byte_pairs.round_trip(table, PATH).collect()), key=repr) == want_rows(library, rows)
    encoded = byte_pairs.encode_documents(table, PATH)
    back = byte_pairs.decode_documents(encoded, PATH).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)
    assert byte_pairs.round_trip(table.where("false"), PATH).count() == 0
    assert byte_pairs.encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
