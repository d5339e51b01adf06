import base64
import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import bpe, packing
from quillon.llm.bpe_words import WordTable, split
from tests.llm.conftest import ODD

TRICKY = ["don't 's  x\n\n y\n z   ", "'sfoo 'll're've", "  a", "a  ", "\n", "x×y ÷ 1² ½ “q” — …", "日本 語 　x\x85y", "it's''s '' 'd'ouch 're 12ab\x1cx", "a b", "é'té", "Ā'll", "\t'ss", "don'T", "<|endoftext|>"]
TEXTS = ODD + TRICKY


def encoding(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_and_round_trip_equal_the_library(table):
    enc = encoding("byte_bpe_multi_50k.tiktoken")
    got = {r["doc_id"]: r for r in bpe.encode_decode(table(TEXTS), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids), t
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_replay_equals_the_library_on_random_words():
    rng, path = random.Random(1), P.path("byte_bpe_multi_50k.tiktoken")
    words = [bytes(rng.choice(b"abAB an\xc3\xa9") for _ in range(rng.randint(1, 14))) for _ in range(3000)] + [b"a" * k for k in range(1, 40)] + [b""]
    enc = encoding("byte_bpe_multi_50k.tiktoken")
    got = bpe.replay(words, path)
    assert all(enc._encode_single_piece(w) == x for w, x in zip(words, got, strict=True) if w) and got[-1] == []
    assert bpe.replay([], path) == []
    assert all(bpe.decode(x, path) == w for w, x in zip(words, got, strict=True))


def test_words_alone_equal_the_library():
    rng, path = random.Random(2), P.path("byte_bpe_multi_50k.tiktoken")
    enc, ranks = encoding("byte_bpe_multi_50k.tiktoken"), bpe.load_ranks(path)
    for w in [bytes(rng.choice(b"abAB an\xc3\xa9the ing") for _ in range(rng.randint(1, 60))) for _ in range(500)]:
        assert bpe.plain_bpe(w, ranks) == enc._encode_single_piece(w)
    long = b"thequickbrown" * 80_000  # of a megabyte
    assert bpe.plain_bpe(long, ranks) == bpe.replay([long], path)[0] and bpe.decode(bpe.plain_bpe(long, ranks), path) == long


def test_tables_that_start_anew(table, monkeypatch):
    path, enc = P.path("byte_bpe_multi_50k.tiktoken"), encoding("byte_bpe_multi_50k.tiktoken")
    own = bpe.Digested(path, limit=20)
    texts = [" ".join(f"word{rng.randint(0, 50)}x{k}" for _ in range(30)) for k, rng in enumerate(map(random.Random, range(12)))]
    for t in [*texts, *texts]:
        buf, starts, lengths, ends = split([t.encode()], P.PATTERN)
        index = own.find(buf, starts, lengths, ends)
        decimal, decoded = own.digested()
        assert b"".join(decimal[w] for w in index).decode() == "".join(f"{i}," for i in enc.encode_ordinary(t))
        assert b"".join(decoded[w] for w in index).decode() == t and own.ids(index).tolist() == enc.encode_ordinary(t)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    path, enc = P.path("byte_bpe_multi_50k.tiktoken"), encoding("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(WordTable, "_hashes", lambda self, buf, starts, lengths: lengths.astype("uint64") + (1 << 50))
    own = bpe.Digested(path)
    for t in TEXTS * 2:
        buf, starts, lengths, ends = split([(t or "").encode()], P.PATTERN)
        assert own.ids(own.find(buf, starts, lengths, ends)).tolist() == enc.encode_ordinary(t or "")


def test_texts_beyond_a_block(table):
    enc, text = encoding("byte_bpe_multi_50k.tiktoken"), "many words, é and 12 more; " * 100_000
    got = bpe.encode_decode(table([text, "z"]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).filter("doc_id = 0").first()
    assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, enc.encode_ordinary(text))).encode()).hexdigest()


def test_ids_column(table):
    enc = encoding("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode(table(["a b", None]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert [r["ids"] for r in rows] == [enc.encode_ordinary("a b"), []]


def test_packing_covers_every_id_once(table):
    texts = TEXTS + ["word " * 3000, "many words here " * 700] + ["short"] * 40
    texts += ["a<|endoftext|>b", "x <|endoftext|>", "<|endoftext|><|endoftext|>\n"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    rows = packing.pack(table(texts).coalesce(1), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, ids in enumerate(want):
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            own = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
            at += r["length"]
        assert at == len(ids)
    limits = packing.Limits()
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= limits.tokens and len(own) <= limits.segments and sum(r["loss_tokens"] for r in own) <= limits.loss_tokens
    total = sum(map(len, want))
    assert len(sequences) <= total / 1024 + 2


def test_packing_under_tight_limits():
    import numpy as np

    p = packing.Packer(packing.Limits(tokens=16, segments=3, loss_tokens=10, context=2, window=10))
    items = [packing.Item(k, 0, np.zeros(n, np.uint32), n) for k, n in enumerate([40, 1, 1, 1, 1, 7, 9, 3, 16, 12, 2, 2])]
    out = [x for i in items for x in p.add(i)] + list(p.pack())
    by = defaultdict(list)
    for item, seq, _, loss in out:
        by[seq].append((len(item.ids), loss))
    assert all(sum(n for n, _ in v) <= 16 and len(v) <= 3 and sum(x for _, x in v) <= 10 for v in by.values())
    assert sum(len(i.ids) for i, *_ in out) == sum(len(i.ids) for i in items)


@pytest.mark.parametrize("run", [lambda df: bpe.encode_decode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), lambda df: packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN)])
def test_empty_table(table, run):
    assert run(table(["x"]).filter("false")).count() == 0
