import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as formats

from lodestone.llm import sentencepiece_spans as spans

from .support import LONG, documents, empty

PATH = spans.default_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "  two  spaces ", "plain words, here.", "line\nbreak\ttab\r\n", "▁ real mark ▁▁", "Ünïcode 😀 日本語 \u200b", "a" * 5000, "<s> </s> <unk> <0x41>", "x\x00y", LONG[:30_000], "\U000e0001é́"]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_and_decoding_equal_the_library(text):
    ((ids, begins, ends),) = spans.model(PATH).encode([text])
    assert ids.tolist() == LIBRARY.encode(text)
    assert spans.model(PATH).decode(ids.tolist()) == LIBRARY.decode(ids.tolist())
    data = text.encode()
    assert b"".join(data[a:b] for a, b in zip(begins, ends)) == data


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(text):
    text = text.encode("utf-8", "ignore").decode()
    ((ids, begins, ends),) = spans.model(PATH).encode([text])
    assert ids.tolist() == LIBRARY.encode(text) and spans.model(PATH).decode(ids.tolist()) == LIBRARY.decode(ids.tolist())
    assert b"".join(text.encode()[a:b] for a, b in zip(begins, ends)) == text.encode()


@pytest.fixture(scope="module")
def normalising(tmp_path_factory):
    """The same vocabulary under a compiled character map with squeezed spaces."""
    proto = formats.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    other = formats.ModelProto()
    other.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = other.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path_factory.mktemp("model") / "nfkc.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


@pytest.mark.parametrize("text", ["ﬁne １２３ ｱｲｳ", "  spaced　 out  ", "Å ½ ﷺ ㍿ \u00ad", "no change", " ", "tab\tand\nline", "é é", "①②　③"])
def test_character_map_and_alignment_equal_the_library(normalising, text):
    library = sentencepiece.SentencePieceProcessor(model_file=normalising)
    ((ids, begins, ends),) = spans.PieceModel(normalising).encode([text])
    assert ids.tolist() == library.encode(text)
    pieces = library.encode(text, return_type="proto").pieces
    assert [(int(a), int(b)) for a, b in zip(begins, ends)] == [(p.begin, p.end) for p in pieces]  # byte offsets


def test_decoding_broken_bytes():
    for ids in ([3 + 0xE2, 3 + 0x82], [3 + 0xFF, 264, 3 + 0xE2], [28705, 264], [0, 264], [1, 264, 2], []):
        assert spans.model(PATH).decode(ids) == LIBRARY.decode(ids)


def test_odd_rows(spark):
    docs = documents(spark)
    out = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in spans.digests(docs, PATH).collect()}
    expected = set()
    for r in docs.collect():
        ids = LIBRARY.encode(r["text"] or "")
        expected.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert out == expected
    assert spans.digests(empty(spark), PATH).count() == 0
    back = spans.decode(spans.encode(docs, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(LIBRARY.decode(LIBRARY.encode(r["text"] or "")) for r in docs.collect())
