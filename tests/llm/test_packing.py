import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from labelweave.llm import packing
from labelweave.llm.wordpieces import WordEncoder
from tests.llm.helpers import awkward, documents, empty, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", " ", "a.b c. d.. e... f, g,, 'tis don't it's. x", "İstanbul ΣΑΣ. Σ", "é́ ́x. ", "<|endoftext|> A",
    "<|ENDOFTEXT|>", "\x01 a \x01", "a b. c", "x" * 5000, "\x1c a\r\nb\x0b c", "１２ 3.4, 5. 6",
]


TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def test_words_one_by_one_give_the_ids_of_the_library():
    texts = ODD + [sentence(k) + "." for k in range(20)]
    found = WordEncoder.shared(PATH).encode(pa.array(texts))
    for text, raw in zip(texts, found):
        assert np.frombuffer(raw, "<u4").tolist() == ids(text), text


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once_and_without_gaps(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([rng.randint(1, 64), 64, 7]) for _ in range(500))
    packs = defaultdict(list)
    for length, rank, n, first, offset in packing.plan_packs(histogram, 64):
        for k in range(n):
            packs[first + k].append((offset, length))
    assert Counter(x for p in packs.values() for _, x in p) == histogram
    assert sorted(packs) == list(range(len(packs)))
    for pack in packs.values():
        at = 0
        for offset, length in sorted(pack):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.plan_packs({}, 64) == []


def test_pieces_hold_each_id_once(spark):
    docs = awkward(spark)
    found = packing.pack_documents(docs, PATH, size=128).collect()
    texts = defaultdict(list)
    for row in docs.collect():
        texts[row["doc_id"]].append(ids(row["text"] or "") + [2])
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    expected = Counter(
        (d, s, len(x[s : s + 128]), crc(x[s : s + 128]), len(x)) for d, xs in texts.items() for x in xs for s in range(0, len(x), 128)
    )
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == expected
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128


def test_no_documents(spark):
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_many_of_one_length_have_little_padding(spark):
    docs = documents(spark, [(k, sentence(k % 7, 5 + k % 3)) for k in range(300)])
    found = packing.pack_documents(docs, PATH, size=64).collect()
    used = sum(r.length for r in found)
    assert used / (64 * (1 + max(r.sequence_id for r in found))) > 0.9


def unspaced(n, chars=3000):
    rng = random.Random(n)
    return ["".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(chars)) for _ in range(n)]


def test_cache_is_bounded_by_bytes(monkeypatch):
    from labelweave.llm import wordpieces

    texts = unspaced(300)
    coder = WordEncoder(PATH)
    for text, raw in zip(texts, coder.encode(pa.array(texts))):
        assert np.frombuffer(raw, "<u4").tolist() == ids(text)
    assert coder.held < 100_000 and sum(map(len, coder.words)) < 100_000
    monkeypatch.setattr(wordpieces, "CACHED_BYTES", 20_000)
    coder.forget()
    some = [" ".join(f"w{k}x{j}" for j in range(200)) for k in range(20)]
    for text, raw in zip(some, coder.encode(pa.array(some))):
        assert np.frombuffer(raw, "<u4").tolist() == ids(text)
    for text, raw in zip(some, coder.encode(pa.array(some))):
        assert np.frombuffer(raw, "<u4").tolist() == ids(text)
        assert coder.held <= 20_000


@pytest.mark.parametrize("together", [1, 3])
def test_new_words_encoded_in_lots_give_the_same_ids(monkeypatch, together):
    from labelweave.llm import wordpieces

    monkeypatch.setattr(wordpieces, "LEARNT_TOGETHER", together)
    texts = ODD + [sentence(k) + "." for k in range(20)]
    for text, raw in zip(texts, WordEncoder(PATH).encode(pa.array(texts))):
        assert np.frombuffer(raw, "<u4").tolist() == ids(text), text


def test_tidy_passes_all_batches_and_then_gives_back(monkeypatch):
    from labelweave.llm import steps

    calls = []
    monkeypatch.setattr(steps, "give_back", lambda: calls.append("given back"))
    run = steps.tidy(lambda batches: (calls.append(b) or b for b in batches))
    assert list(run(iter([1, 2]))) == [1, 2]
    assert calls == [1, 2, "given back"]
    assert list(run(iter([]))) == []


def test_tokenizers_that_keep_case_or_space_are_read_whole(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    assert WordEncoder(PATH).wordwise
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    coder, library = WordEncoder(str(other)), Tokenizer.from_file(str(other))
    assert not coder.wordwise
    for text, raw in zip(ODD, coder.encode(pa.array(ODD))):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
