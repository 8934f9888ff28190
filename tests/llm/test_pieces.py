"""SentencePiece encoding against the library: ids, spans, decoded texts, other normalisers."""

import hashlib
import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
from tessera.llm import charmap, pieces  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "word", "The", "é", "é", " ", "  ", "\n", "\t", " ", ".", "▁", "\x00", "日本", "​", "🎉",
         "①", "ｱﾞ", "ﷺ", "¨", "　", "<s>", "</s>", "<0x41>", "1", "ﬁ", "\r\n", "x" * 70, "́", "한", "가"]


def texts(seed, n=1500):
    rnd = random.Random(seed)
    return ["", " ", "   ", "▁", " ▁ a", "a "] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 16))) for _ in range(n)]


def with_normaliser(name, **flags):
    """The model's pieces with another normaliser."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=name, **flags).serialized_normalizer_spec()
    with open(PATH, "rb") as f:
        rest = b"".join(raw for n, _, raw in charmap.fields(f.read()) if n != 3)
    return rest + b"\x1a" + charmap._encoded(len(spec)) + spec


MODELS = {"own": lambda: open(PATH, "rb").read(),
          "nfkc": lambda: with_normaliser("nmt_nfkc", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True),
          "folded": lambda: with_normaliser("nfkc_cf", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=True),
          "tight": lambda: with_normaliser("identity", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)}


@pytest.mark.parametrize("kind", MODELS)
def test_ids_spans_and_text_as_the_library(kind):
    data = MODELS[kind]()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = pieces.Codec(charmap.Model.parse(data))
    cases = texts(7)
    for t, (ids, begins, ends, decoded) in zip(cases, codec.encode(cases)):
        want = library.encode(t, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want], repr(t)
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], repr(t)
        assert decoded.decode() == library.decode(ids.tolist()), repr(t)


def test_whole_corpus(spark, corpus):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in corpus.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = pieces.digests(pieces.encode(corpus, PATH)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    for r in pieces.encode(corpus, PATH).join(corpus.select("doc_id", "text"), "doc_id").where("doc_id < 60").collect():
        data = r["text"].encode()
        assert b"".join(data[a:b] for a, b in zip(r["begins"], r["ends"])) == data


def test_empty_table(no_docs):
    assert pieces.encode(no_docs, PATH).collect() == []
