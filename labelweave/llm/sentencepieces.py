"""Offset-preserving SentencePiece encoding, and decoding.

A text is normalised by the longest prefixes in the model's compiled character
map, noting for every byte made where it comes from; pieces are runs of
normalised bytes, so the notes project each piece to a span of original bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.llm.steps import text_of

SPACE = "▁"
CACHED_BYTES = 96 << 20  # bound of what the words a worker keeps take up
WORD_BYTES = 180  # of a kept word besides its characters and ids
LONG_CHARS = 64  # a longer word, text without spaces mostly, is not kept
WORDS = re.compile(r" *[^ ]+| +$")
GROUP_CHARS = 1 << 21


class CharacterMap:
    """Longest-prefix rewriting by a compiled map: a double-array trie over
    UTF-8 bytes, then zero-terminated replacements. An empty map copies."""

    def __init__(self, compiled: bytes) -> None:
        self.units, self.texts = np.zeros(0, "<u4"), b""
        if compiled:
            size = int(np.frombuffer(compiled[:4], "<u4")[0])
            self.units = np.frombuffer(compiled[4 : 4 + size], "<u4")
            self.texts = compiled[4 + size :]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest key that ``raw`` has at ``at``, and its replacement."""
        units, found = self.units, None
        node = self._below(int(units[0]))
        for k in range(at, len(raw)):
            node ^= raw[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != raw[k]:
                break
            node ^= self._below(unit)
            if unit >> 8 & 1:
                begin = int(units[node]) & 0x7FFFFFFF
                found = (k + 1 - at, self.texts[begin : self.texts.index(b"\0", begin)])
        return found

    @staticmethod
    def _below(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end its place in the source bytes."""
        raw = text.encode("utf-8")
        if not len(self.units):
            return raw, np.arange(len(raw) + 1)
        out, source, at = [], [], 0
        while at < len(raw):
            hit = self.longest(raw, at)
            if hit is None:
                lead = raw[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out.append(raw[at : at + n])
                source.extend(range(at, at + n))
            else:
                n, new = hit
                out.append(new)
                source.extend([at] * len(new))
            at += n
        return b"".join(out), np.array([*source, len(raw)])


class PieceEncoder:
    """One model file in a worker process."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            spec = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self.rules = spec.normalizer_spec
        self.map = CharacterMap(self.rules.precompiled_charsmap)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        special = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(n)]
        self.bytes_of = np.array(
            [0 if s else 1 if self.model.is_byte(i) else len(p.encode()) for i, (p, s) in enumerate(zip(pieces, special))]
        )
        self.decimal = [str(i).encode() for i in range(n)]
        self.space = self.model.piece_to_id(SPACE)
        self.newline = self.model.piece_to_id("<0x0A>")
        plain = [p for i, p in enumerate(pieces) if not special[i]]
        # Words can be encoded one by one if no piece goes from a word into the next.
        self.wordwise = (
            spec.trainer_spec.model_type == spec.trainer_spec.BPE
            and n <= 1 << 16
            and not self.rules.precompiled_charsmap
            and self.rules.add_dummy_prefix
            and not self.rules.remove_extra_whitespaces
            and self.rules.escape_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and not any(p.type == p.USER_DEFINED for p in spec.pieces)
            and spec.trainer_spec.byte_fallback
            and self.model.is_byte(self.newline)
            and not any("\n" in p or SPACE in p.lstrip(SPACE) for p in plain)
        )
        self.held = 0
        self.surface = [
            b"" if s else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, (p, s) in enumerate(zip(pieces, special))
        ]
        self.known: dict[str, bytes] = {"\n": np.array([self.newline], "<u2").tobytes()}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Exactly the library's ids of each text, without begin and end ids."""
        whole = {i for i, t in enumerate(texts) if not self.wordwise or SPACE in t}
        split = [[] if i in whole else self._words(t) for i, t in enumerate(texts)]
        known = self.known
        found = [list(map(known.get, words)) for words in split]
        new = list({w for words, ids in zip(split, found) if None in ids for w, i in zip(words, ids) if i is None})
        if new:
            spaced = [w[1:] for w in new if w[0] == " "]
            bare = [w for w in new if w[0] != " "]
            learnt = {" " + w: ids if w else [self.space] for w, ids in zip(spaced, self.model.encode(spaced, num_threads=1))}
            broken = self.model.encode(["\n" + w for w in bare], num_threads=1) if bare else []
            learnt |= {w: ids[2:] for w, ids in zip(bare, broken)}
            fresh = {w: np.array(ids, "<u2").tobytes() for w, ids in learnt.items()}
            for w, ids in fresh.items():
                if len(w) > LONG_CHARS:
                    continue
                if self.held > CACHED_BYTES:
                    known.clear()
                    known["\n"] = np.array([self.newline], "<u2").tobytes()
                    self.held = 0
                known[w] = ids
                self.held += WORD_BYTES + 4 * len(w) + len(ids)
            found = [
                [fresh[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids
                for words, ids in zip(split, found)
            ]
        return [
            np.array(self.model.encode(t), "<u4") if i in whole else np.frombuffer(b"".join(found[i]), "<u2")
            for i, t in enumerate(texts)
        ]

    def _words(self, text: str) -> list[str]:
        """Parts that are encoded one by one: runs of spaces with the word behind them, and line breaks."""
        if not text:
            return []
        out = []
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append("\n")
            else:
                line = " " + line  # the model starts every text with a space
            out += WORDS.findall(line)
        return out

    def agree(self, text: str, ids: np.ndarray) -> bool:
        """Whether every piece reads like the normalised bytes of its span (an unknown character has none to compare)."""
        normal, _ = self.map.normalise(text)
        normal = normal.replace(SPACE.encode(), b" ")  # the model reads both alike
        if self.rules.remove_extra_whitespaces:
            normal = b" ".join(x for x in normal.split(b" ") if x)
        first = b" " if self.rules.add_dummy_prefix and normal else b""
        return b"".join(map(self.surface.__getitem__, ids.tolist())) == first + normal

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of each piece in the bytes of ``text``.

        Pieces of the inserted first space are empty. A byte piece covers its
        byte. Spans are in order; without deleting rules they cover the text.
        """
        normal, source = self.map.normalise(text)
        raw = np.frombuffer(normal, np.uint8)
        width = np.where(raw == 32, 3, 1) if self.rules.escape_whitespaces else np.ones(len(raw), int)
        if self.rules.remove_extra_whitespaces:
            space = raw == 32
            inner = np.r_[False, space[:-1]] if len(raw) else space
            width[space & inner] = 0
            edge = np.flatnonzero(~space)
            width[: edge[0] if len(edge) else len(raw)] = 0
            width[edge[-1] + 1 if len(edge) else 0 :] = 0
        place = np.repeat(source[:-1], width)
        if self.rules.add_dummy_prefix and len(raw):
            place = np.r_[[0, 0, 0], place]
        ends = np.cumsum(self.bytes_of[ids])
        place = np.append(place, source[-1])
        begin = place[np.minimum(np.r_[0, ends[:-1]].astype(int) if len(ends) else ends, len(place) - 1)]
        end = place[np.minimum(ends, len(place) - 1)]
        return begin, end


def _groups(batch: pd.DataFrame) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of a batch, some characters at a time."""
    ids, texts, chars = [], [], 0
    for doc_id, text in zip(batch["doc_id"], batch["text"]):
        ids.append(doc_id)
        texts.append(text)
        chars += len(text)
        if chars >= GROUP_CHARS:
            yield ids, texts
            ids, texts, chars = [], [], 0
    if texts:
        yield ids, texts


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode(docs: DataFrame, model: str, end_id: int | None = 2) -> DataFrame:
    """doc_id, ids, begins, ends of every whole text.

    Ids are those of the library; begins and ends are byte offsets in the
    UTF-8 text. A null text counts as empty; the end id has an empty span at
    the end of the text. Other columns are ignored, repeated rows repeat.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(model)
        for batch in batches:
            for doc_id, text, ids in ((d, t, i) for g in _groups(batch) for d, t, i in zip(*g, coder.ids(g[1]))):
                begin, end = coder.spans(text, ids)
                if end_id is not None:
                    stop = len(text.encode("utf-8"))
                    ids, begin, end = np.append(ids, end_id), np.append(begin, stop), np.append(end, stop)
                row = pd.DataFrame({"doc_id": pd.array([doc_id], "Int64")})
                yield row.assign(ids=[ids.astype(int)], begins=[begin.astype(int)], ends=[end.astype(int)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return source.mapInPandas(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the library's text of ``ids``; null ids count as none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(model)
        for batch in batches:
            texts = [coder.model.decode([] if ids is None else [int(i) for i in ids]) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str, end_id: int = 2) -> DataFrame:
    """What ``encode`` and ``decode`` give for each row, as counts and digests.

    spanned_bytes is the number of source bytes that the spans of its pieces
    cover; it is n_bytes when nothing is lost. spans_agree says whether all pieces
    read like the bytes their spans project to. Ids and texts stay in the task.
    """
    schema = (
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spanned_bytes long, n_bytes long, spans_agree boolean"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(model)
        decimal, decode_ids = coder.decimal, coder.model.decode
        for batch in batches:
            out = []
            for doc_id, text, found in ((d, t, i) for g in _groups(batch) for d, t, i in zip(*g, coder.ids(g[1]))):
                begin, end = coder.spans(text, found)
                ids = [*found.tolist(), end_id]
                written = hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest()
                back = hashlib.sha256(decode_ids(ids).encode("utf-8")).hexdigest()
                n_bytes = len(text) if text.isascii() else len(text.encode("utf-8"))
                out.append((doc_id, len(ids), written, back, int((end - begin).sum()), n_bytes, coder.agree(text, found)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return source.mapInPandas(run, schema)
