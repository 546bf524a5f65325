import hashlib

import public_tokenizers
import sentencepiece

from labelweave.llm import sentencepieces as sp
from tests.llm.helpers import awkward, empty, sentence

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", " \n ", " a", "a ", "a  b", "a\n b", "a \nb", "\n  x", "<s> </s>", "▁ ▁▁x", "a▁b", "\t x\r\n",
    "x" * 400, "𝒳 ﬁ ①", "\x00", "a\n\n\nb   c",
]


def test_ids_are_those_of_the_library():
    library, texts = sentencepiece.SentencePieceProcessor(model_file=PATH), ODD + [sentence(k) for k in range(9)]
    for text, found in zip(texts, sp.encoder(PATH).ids(texts)):
        assert found.tolist() == library.encode(text), text


def test_spans_cover_the_bytes_of_their_pieces():
    coder = sp.encoder(PATH)
    for text, ids in zip(ODD, coder.ids(ODD)):
        raw = text.encode()
        begin, end = coder.spans(text, ids)
        assert (end - begin).sum() == len(raw)
        for piece, a, b in zip(map(int, ids), begin, end):
            if coder.model.is_byte(piece):
                assert raw[a:b] == bytes([int(coder.model.id_to_piece(piece)[1:-1], 16)])
            elif a < b:
                assert raw[a:b].decode().replace(" ", "▁") in (coder.model.id_to_piece(piece), coder.model.id_to_piece(piece)[1:])


def test_digests_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = awkward(spark)
    expected = []
    for row in docs.collect():
        ids = library.encode(row["text"] or "") + [2]
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((row["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    found = sp.digests(docs, PATH).collect()
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:4]) for r in found)
    assert all(r.spanned_bytes == r.n_bytes and r.spans_agree for r in found)
    assert sp.digests(empty(spark), PATH).count() == 0


def test_pieces_read_like_their_spans():
    coder = sp.encoder(PATH)
    for text, ids in zip(ODD, coder.ids(ODD)):
        assert coder.agree(text, ids), text
        if len(ids) > 2:
            assert not coder.agree(text, ids[:-1])


def test_cache_is_bounded_by_bytes(monkeypatch):
    import random

    rng = random.Random(1)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(3000)) for _ in range(200)]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    coder = sp.PieceEncoder(PATH)
    assert [i.tolist() for i in coder.ids(texts)] == [library.encode(t) for t in texts]
    assert coder.held < 10_000
    monkeypatch.setattr(sp, "CACHED_BYTES", 20_000)
    some = [" ".join(f"w{k}x{j}" for j in range(200)) for k in range(20)]
    for text in some + some:
        assert coder.ids([text])[0].tolist() == library.encode(text)
        assert coder.held <= 20_000 + 1000


def test_encode_then_decode(spark):
    docs = awkward(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    back = {r.doc_id: r.text for r in sp.decode(sp.encode(docs, PATH), PATH).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


def compiled(rules):
    """A character map as a model holds it: a double-array trie over the UTF-8 keys, then replacements."""
    texts, places = b"", {}
    for key, value in rules.items():
        places[key.encode()] = len(texts)
        texts += value.encode() + b"\0"
    units, taken = {0: 0}, {0}

    def below(prefix):
        out = {k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)}
        return sorted(out), prefix in places

    def place(prefix, at, label):
        letters, ends = below(prefix)
        base = 1
        while any((at ^ base ^ c) in taken for c in [*letters, *([0] if ends else [])]):
            base += 1
        taken.update(at ^ base ^ c for c in [*letters, *([0] if ends else [])])
        units[at] = (base << 10) | (256 if ends else 0) | label
        if ends:
            units[at ^ base] = (1 << 31) | places[prefix]
        for c in letters:
            place(prefix + bytes([c]), at ^ base ^ c, c)

    place(b"", 0, 0)
    import numpy as np

    array = np.zeros(max(units) + 257, "<u4")
    for at, unit in units.items():
        array[at] = unit
    return np.array([array.nbytes], "<u4").tobytes() + array.tobytes() + texts


def test_longest_prefixes_are_rewritten_and_aligned():
    rules = {"ﬁ": "fi", "①": "1", "é": "é", "ab": "X", "abc": "YZ", "​": ""}
    chars = sp.CharacterMap(compiled(rules))
    text = "ﬁt ①abcab ée​a"
    normal, source = chars.normalise(text)
    assert normal.decode() == "fit 1YZX éea"
    raw, at, expected = text.encode(), 0, []
    keys = sorted((k.encode() for k in rules), key=len, reverse=True)
    while at < len(raw):
        key = next((k for k in keys if raw.startswith(k, at)), None)
        if key:
            expected += [at] * len(rules[key.decode()].encode())
            at += len(key)
        else:
            expected.append(at)
            at += 1
    assert source.tolist() == expected + [len(raw)]
