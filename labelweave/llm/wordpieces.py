"""Ids of a lower-casing, white-space-dropping word BPE, encoded word by word.

Where the file says that its normaliser lower-cases and its splitter never keeps
white space, the ids of a text are those of its words in a row; texts of any
other tokenizer are encoded whole. Words repeat: a batch of texts is encoded by
its distinct words, and each task keeps the words it has met, up to a number of
bytes. Words too long to come again (text without spaces) are not kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from labelweave.llm.steps import give_back

CACHED_BYTES = 80 << 20  # bound of what the words a task keeps take up
WORD_BYTES = 180  # of a kept word besides its characters and ids
LONG_CHARS = 64  # a longer word is not kept
BATCH_BYTES = 1 << 22
LEARNT_TOGETHER = 1 << 13  # new words that the library encodes at once
MARK = "\x01"  # stands between new words; its bytes form an id of their own
STOPS = ".,"

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.mark = self.model.encode(MARK, add_special_tokens=False).ids[0]
        self.stops = {s: self.plain(s) for s in STOPS}
        self.words: dict[str, bytes] = {}
        self.held = 0
        with open(path, encoding="utf-8") as file:
            self.wordwise = _is_wordwise(json.load(file))

    @classmethod
    def shared(cls, path: str) -> WordEncoder:
        """The encoder of this worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def forget(self) -> None:
        """Give back the words and buffers, as the worker process goes on with other work."""
        self.words, self.held = {}, 0
        give_back()

    def plain(self, text: str) -> bytes:
        ids = self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: pa.Array) -> Iterable[bytes]:
        """Little-endian 32-bit ids of each text; works on a bounded number of characters at a time.

        Texts that hold the start of a special token or the mark are encoded
        whole by the library.
        """
        texts = texts.cast(pa.large_string())
        if not self.wordwise:
            yield from map(self.plain, texts.to_pylist())
            return
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            end = int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + BATCH_BYTES)) + 1
            yield from self._encode_group(texts[begin:end])
            begin = end
        give_back()

    def _encode_group(self, texts: pa.Array) -> Iterable[bytes]:
        odd = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring(texts, MARK))
        whole = {i: self.plain(texts[i].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        if whole:
            texts = pc.if_else(odd, "", texts)
        # The normaliser lowers letters anyway; A-Z can be lowered before words are told apart.
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = split.flatten().dictionary_encode()
        ids = pa.array(self._of_words(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        data = memoryview(ids.buffers()[2] or b"")
        places = split.offsets.to_numpy() - split.offsets[0].as_py()
        begins = np.frombuffer(ids.buffers()[1], "<i8")[places].tolist() if len(ids) else [0] * (len(texts) + 1)
        for i in range(len(texts)):
            yield whole[i] if i in whole else bytes(data[begins[i] : begins[i + 1]])

    def _of_words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.words.get, words))
        new = [w for w, ids in zip(words, found) if ids is None]
        if not new:
            return found
        # A full stop or comma behind a letter and before a space is split off by the model too.
        stopped = {w for w in new if w[-1:] in self.stops and w[-2:-1].isascii() and w[-2:-1].isalpha()}
        bare = {w[:-1] if w in stopped else w for w in new}
        learnt = self._learn([w for w in bare if w not in self.words])
        for w in stopped:
            learnt[w] = (learnt.get(w[:-1]) or self.words[w[:-1]]) + self.stops[w[-1]]
        out = [learnt[w] if ids is None else ids for w, ids in zip(words, found)]
        kept = {w: ids for w, ids in learnt.items() if len(w) <= LONG_CHARS}
        more = WORD_BYTES * len(kept) + sum(map(len, kept.values())) + 4 * sum(map(len, kept))
        if self.held + more > CACHED_BYTES:
            # What these texts hold is likely to come again.
            kept |= {w: ids for w, ids in zip(words, found) if ids is not None}
            more = WORD_BYTES * len(kept) + sum(map(len, kept.values())) + 4 * sum(map(len, kept))
            self.words, self.held = {}, 0
        if more <= CACHED_BYTES:
            self.words |= kept
            self.held += more
        return out

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for begin in range(0, len(new), LEARNT_TOGETHER):
            out |= self._learn_some(new[begin : begin + LEARNT_TOGETHER])
        return out

    def _learn_some(self, new: list[str]) -> dict[str, bytes]:
        text = f" {MARK} ".join(new)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(new) - 1:
            raise ValueError("a word gave the id of the mark")
        raw, begin, out = ids.tobytes(), 0, {}
        for word, cut in zip(new, [*cuts.tolist(), len(ids)]):
            out[word] = raw[4 * begin : 4 * cut]
            begin = cut + 1
        return out


def _is_wordwise(spec: dict) -> bool:
    """Whether ids of words can be joined: letters are lowered, runs of white space are one, and pieces keep none of it."""
    steps = spec["normalizer"] or {}
    steps = steps.get("normalizers", [steps])
    spaces = [s for s in steps if s.get("type") == "Replace"]
    cutters = spec["pre_tokenizer"] or {}
    first = cutters.get("pretokenizers", [cutters])[0]
    pattern = first.get("pattern", {}).get("Regex", r"\s")
    return (
        {s.get("type") for s in steps} <= {"NFC", "Replace", "Lowercase"}
        and any(s.get("type") == "Lowercase" for s in steps)
        and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in spaces)
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and regex.search(pattern, " \t\n") is None
        and spec["model"]["type"] == "BPE"
    )
