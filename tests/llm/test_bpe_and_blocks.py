import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.bpe import UNSURE, WordBpe, bpe_round_trip
from quillon.llm.token_blocks import BLOCK, ChunkEncoder, TokenFile, decode_blocks, encode_blocks, encode_file, read_token_files, worker_encoder, write_token_files

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
CONTENT = open(PATH, encoding="utf-8").read()
LIBRARY, OWN, CHUNKS = tokenizers.Tokenizer.from_file(PATH), WordBpe(CONTENT), ChunkEncoder(CONTENT)
ODD = ["", "ΣΑΣ İstanbul can't we'll I'D 123 !!!\x1cfoo\x1dbar a<|endoftext|>B <|STARTOFTEXT|>", "é́é ﬁ 日本語 \U0001f600‍", "x" * 300 + "!?" * 500 + "   z\x85y", "ab" * 40 + "ÀÉ" * 50, "a" * 4000]


def chunked(texts):
    out = []
    for _, ids, ends in CHUNKS.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, ends[:-1])]
    return out


def decoded(texts):
    return [(np.frombuffer(i, "<u4").tolist(), bytes(d).decode()) for _, a, b in OWN.encoded_and_decoded(pa.array(texts, pa.string())) for i, d in zip(a, b, strict=True)]


@pytest.mark.parametrize("text", ODD)
def test_as_the_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == expected
    assert OWN.decode(expected) == LIBRARY.decode(expected, skip_special_tokens=False)
    assert chunked([text]) == [expected]


def test_sure_letters_are_alike():
    """Where the text is cut here, the library's engine sees the same classes."""
    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(OWN.split_rule), "removed", invert=True)
    sure = [chr(c) for c in range(0x20, 0x1F650) if not 0xD800 <= c < 0xE000 and not UNSURE.match(chr(c))]
    for k in range(0, len(sure), 3000):
        text = "".join(sure[k : k + 3000])
        assert OWN.word_pattern.findall(text) == [w for w, _ in split.pre_tokenize_str(text)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == expected
    assert chunked([text]) == [expected]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aB'sé ÀØß×.,1<|endoftext>\n", max_size=30)), max_size=6))
def test_columns_of_texts(texts):
    expected = [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert chunked(texts) == expected
    assert decoded(texts) == [(ids, LIBRARY.decode(ids, skip_special_tokens=False)) for ids in expected]


def test_round_trip_frames(odd_docs, no_docs):
    got = bpe_round_trip(odd_docs, PATH, with_ids=True).collect()
    assert len(got) == odd_docs.count() and bpe_round_trip(no_docs, PATH).count() == 0
    for r, d in zip(got, odd_docs.collect(), strict=True):
        assert r["ids"] == LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3 * BLOCK))
def test_blocks_come_back(ids):
    ids = np.array(ids, np.uint32)
    offsets, payload = encode_blocks(ids)
    assert (decode_blocks(payload, offsets)[: len(ids)] == ids).all()
    if len(offsets) > 1:
        assert (decode_blocks(payload, offsets, 1, 2)[: len(ids) - BLOCK] == ids[BLOCK : 2 * BLOCK]).all()


def test_a_file_gives_single_documents():
    ids = np.arange(5000, dtype=np.uint32) * 7
    file = TokenFile(encode_file([3, None, 9], [10, 10, 5000], ids))
    assert file.doc_ids == [3, None, 9]
    assert [file.ids_of(k).tolist() for k in (0, 1)] == [ids[:10].tolist(), []] and (file.ids_of(2) == ids[10:]).all()
    assert (file.all_ids() == ids).all()
    with pytest.raises(ValueError):
        TokenFile(b"x" * 100)


def test_files_of_a_frame(spark, odd_docs, no_docs):
    encoder = lambda: worker_encoder(CONTENT)
    got = sorted((r for r in read_token_files(write_token_files(odd_docs, encoder, 2).df).collect()), key=lambda r: r["start"])
    docs = sorted(odd_docs.collect(), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or ""))
    start = 0
    for r, d in zip(got, docs, strict=True):
        ids = [*LIBRARY.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert read_token_files(write_token_files(no_docs, encoder, 2).df).count() == 0
