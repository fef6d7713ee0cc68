"""Encoding and decoding with a merge-type sentence-piece model, exactly, without merging whole texts.

A model of this kind merges adjacent symbols by score until nothing can be merged. A row of tokens is
its result for a text if and only if each token alone, and each two neighbours, are the result for their
own characters. So a text is covered from left to right by the longest tokens (all matches come from one pass of an
Aho-Corasick automaton); a token that its predecessor does not tolerate, which merging the two anew
tells, gives way to a shorter one; where none is left, the position is marked as failed in a bit
field, and the predecessor is tried again shorter. Each position fails at most once.

No token reaches over the end of a word, so texts are cut there and words met before are looked up.
Models are read, never trained.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagescout.llm.texts import text_chunks

#: The mark of a space inside pieces.
SPACE = "▁"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words (in each of two generations) and token pairs kept per Python worker; it changes no result what is kept.
KNOWN_WORDS, KNOWN_PAIRS, KNOWN_LENGTH = 300_000, 500_000, 48

# Bytes that are no character: each becomes one replacement character.
codecs.register_error("pagescout_each_byte", lambda e: ("�", e.start + 1))


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a message as model files hold them."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """Encodes and decodes texts under one model file."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            parts = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in parts if k == 1]
        trainer = dict(_fields(next((v for k, v in parts if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in parts if k == 3), b"")))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("only merge-type models with byte fallback and without text normalization are read")
        names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not read")
        self.score = {n: struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for n, p, k in zip(names, pieces, kinds, strict=True) if k == NORMAL}
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if k == NORMAL}
        by_name = {n: i for i, n in enumerate(names)}
        self.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        spoken = {NORMAL: lambda n: n.replace(SPACE, " ").encode(), UNKNOWN: lambda n: unknown, CONTROL: lambda n: b"", BYTE: lambda n: bytes([int(n[3:5], 16)])}
        self.spoken = [spoken[k](n) for n, k in zip(names, kinds, strict=True)]
        self.spoken_column = pa.array(self.spoken, pa.binary())
        self.begins = [k == NORMAL and n.startswith(SPACE) for n, k in zip(names, kinds, strict=True)]
        # Tokens that merging can make; a character that stands in longer pieces only is one, too.
        self.letters = letters = {c for n in self.score for c in n}
        self.tokens = sorted(letters | {n for n in self.score if self.merge(n) == [n]})
        number = {t: i for i, t in enumerate(self.tokens)}
        self.length = [len(t) for t in self.tokens]
        #: The next shorter token at the same place; -1 behind the shortest.
        self.shorter = [next((number[t[:i]] for i in range(len(t) - 1, 0, -1) if t[:i] in number), -1) for t in self.tokens]
        self.token_ids = [(self.ids[t],) if t in self.ids else self._byte_ids(t) for t in self.tokens]
        self.matcher = ahocorasick.Automaton()
        for token, i in number.items():
            self.matcher.add_word(token, (i, len(token) - 1))
        self.matcher.make_automaton()
        # Words end before a space mark that follows anything else and around control characters
        # without pieces, if no piece reaches over such a place.
        alone = re.escape("".join(c for c in map(chr, range(32)) if c not in letters))
        crossing = any(SPACE in n.lstrip(SPACE) for n in self.score)
        self.words = re.compile("(?s:.+)" if crossing else f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Tokens of a short text by merging, the best score first, of equal ones the leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _byte_ids(self, text: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in text.encode())

    def fit(self, left: int, right: int) -> bool:
        """Whether merging leaves both tokens as they are when they stand side by side."""
        pair = [self.tokens[left], self.tokens[right]]
        known = self.merge("".join(pair)) == pair
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        self.pairs[left * len(self.tokens) + right] = known
        return known

    def cover(self, word: str) -> list[int]:
        """Token numbers of a text: longest matches, shortened where neighbours do not fit.

        The text consists of characters that the model has.
        """
        size, length, pairs, many = len(word), self.length, self.pairs, len(self.tokens)
        longest = [0] * size
        for end, (token, back) in self.matcher.iter(word):  # ends ascend, so the longest one stays
            longest[end - back] = token
        failed = None
        out: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            end = at + length[token]
            if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                if last < 0 or (fits := pairs.get(last * many + token)) or (fits is None and self.fit(last, token)):
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = self.shorter[token]
            if token < 0:  # nothing can stand here: the predecessor has to be shorter
                failed = failed or bytearray((size >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word. Characters that no piece has stand alone and become their bytes."""
        ids = self.token_ids
        if self.letters.issuperset(word):
            found = [ids[token] for token in self.cover(word)]
        else:
            found = []
            for known, part in groupby(word, self.letters.__contains__):
                found += [ids[token] for token in self.cover("".join(part))] if known else map(self._byte_ids, part)
        return tuple(chain.from_iterable(found))

    def _encoded(self, text: str) -> Iterator[int]:
        if not text:
            return iter(())
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        parts = list(map(self.known.get, words))
        for i, ids in enumerate(parts):
            if ids is None:
                word = words[i]
                # The word may have come up in this text before, or in the generation before.
                ids = parts[i] = self.known.get(word) or self.older.get(word) or self.word_ids(word)
                if len(word) <= KNOWN_LENGTH:
                    if len(self.known) >= KNOWN_WORDS:
                        self.known, self.older = {}, self.known
                    self.known[word] = ids
        return chain.from_iterable(parts)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without marks of its beginning or end."""
        return list(self._encoded(text))

    def encode_all(self, texts: list[str]) -> pa.ListArray:
        """Ids of each text, as an Arrow column."""
        ids = [np.fromiter(self._encoded(t), np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    def decode(self, ids: list[int]) -> str:
        """The text of ids. The space that encoding puts in front is taken off again."""
        return self._text(ids, b"".join(map(self.spoken.__getitem__, ids)))

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """:meth:`decode` of each list of an Arrow column without NULL."""
        ends = ids.offsets.to_numpy()
        flat = ids.values.slice(ends[0], ends[-1] - ends[0])
        pieces = pa.ListArray.from_arrays(pa.array(ends - ends[0]), self.spoken_column.take(flat))
        joined, flat = pc.binary_join(pieces, pa.scalar(b"")).to_pylist(), flat.to_numpy()
        return pa.array([self._text(flat[a:b], data) for a, b, data in zip(ends[:-1] - ends[0], ends[1:] - ends[0], joined, strict=True)], pa.string())

    def _text(self, ids: list[int] | np.ndarray, data: bytes) -> str:
        first = next((i for i in ids if self.spoken[i]), None)
        if first is not None and self.begins[first]:
            data = data[1:]
        return data.decode("utf-8", "pagescout_each_byte")


@lru_cache(maxsize=2)
def piece_model(file: str) -> PieceModel:
    return PieceModel(file)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Place of an installed public model file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` for every row of ``docs``: the token ids of its whole text.

    ``file`` is a model file found on every executor. NULL and empty texts have an empty list. Rows are
    encoded one by one: repeated rows and NULL ids come out as they went in, other columns are not
    read, an empty table gives an empty result.
    """
    file = file or model_path()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(file)
        for part, texts in text_chunks(batches):
            ids = model.encode_all([(t or b"").decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, file: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, text`` for every row of ``encoded``; a NULL or empty list is the empty text.

    An id that the model does not have fails the job, as the list then belongs to another model.
    """
    file = file or model_path()
    rows = encoded.select(encoded[id_col].alias("doc_id"), F.coalesce(encoded[ids_col], F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(file)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, model.decode_all(part.column(1))], names=["doc_id", "ids", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`decode_ids`."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
