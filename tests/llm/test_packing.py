"""Packing against plain best fit and whole-text encoding."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tessera.llm import packing  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_plain_tokenizer(tokenizer):
    enc = packing.Encoder(PATH)
    assert enc.fast
    rnd = random.Random(3)
    parts = ["a", "é", "1", "²", "٣", " ", "  ", "\n", "\t", "\u00a0", ".", "'s", "'", ",", "!", "\x00", "\x1c", "\x85",
             "<|endoftext|>", "<|endof", "日本", "\u200b", "🎉", "\r\n", "don't", "word", "ǅ", "\u0345", "Ⅷ", "\u180e", "\u2028"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += ["x" * 5000 + " y", " " * 3000, "ab " * 2000 + "\n" * 700]
    for t in texts:
        assert enc.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_character_is_cut_alike(tokenizer):
    """Both libraries know the same letters, numbers and blanks."""
    enc = packing.Encoder(PATH)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c}.{c} " for c in chars[a:a + 64]) for a in range(0, len(chars), 64)]
    for t, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        assert enc.encode(t) == e.ids, hex(ord(t[1]))


def test_other_files_go_through_tokenizers(tmp_path):
    import json
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    enc = packing.Encoder(str(tmp_path / "t.json"))
    assert not enc.fast and enc.encode("word") == packing.Encoder(PATH).encode(" word")


def best_fit(lengths, room):
    """Piece-by-piece best fit decreasing: the sorted fills of all sequences."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            i = min(fits, key=lambda i: left[i])
            left[i] -= n
        else:
            left.append(room - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    room = rnd.choice([7, 16, 50])
    lengths = [rnd.randint(1, room) for _ in range(rnd.randint(0, 300))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    fills, ranks = {}, {n: [] for n in counts}
    for length, a, b, seq, per, at in packing.best_fit_plan(counts, room):
        for rank in range(a, b):
            ranks[length].append(rank)
            fills.setdefault(seq + (rank - a) // per, []).append((at + (rank - a) % per * length, length))
    assert all(sorted(r) == list(range(counts[n])) for n, r in ranks.items())
    for f in fills.values():
        end = 0
        for at, n in sorted(f):
            assert at == end
            end += n
        assert end <= room
    assert sorted(room - sum(n for _, n in f) for f in fills.values()) == best_fit(lengths, room)


def test_pack_whole_corpus(spark, corpus, tokenizer):
    rows = packing.pack(corpus, PATH, seq_len=64, keep_ids=True).collect()
    expected = []
    for r in corpus.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        start = 0
        for p, n in enumerate(packing.piece_lengths(len(ids), 64)):
            expected.append((r["doc_id"], p, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
            start += n
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    packed = {r["sequence_id"]: r["ids"] for r in packing.sequences(
        packing.pack(corpus, PATH, seq_len=64, keep_ids=True)).collect()}
    assert sum(map(len, packed.values())) == sum(r["length"] for r in rows) and max(map(len, packed.values())) <= 64


def test_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []
