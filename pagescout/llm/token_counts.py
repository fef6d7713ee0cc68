"""Token counts by byte-pair merging, without making tokens.

A piece of text starts as one symbol per byte. A heap holds the adjacent pairs that can be
merged, by rank and place; symbols form a linked list. Every merge makes two symbols one, so the
count of a piece is its bytes less its merges. Tokenizers are read, never trained.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pagescout.llm.texts import text_chunks

#: Fixed values of byte-level BPE: how a text is cut into pieces before merging.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d"
    r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Counts kept per Python worker; beyond it the store starts anew, which changes no result.
KNOWN_PIECES = 1_000_000


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files of this kind."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PieceCounter:
    """Counts tokens of texts under one vocabulary file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {bytes([b]): b for b in range(256)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = as_bytes(a), as_bytes(b)
            made = self.ids.setdefault(left + right, len(self.ids))
            self.merges[self.ids[left], self.ids[right]] = (rank, made)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def merge_count(self, piece: bytes) -> int:
        """Tokens of one piece: bytes less merges."""
        symbol = list(piece)
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = self.merges
        heap = [(m[0], i, m[1], symbol[i], symbol[i + 1]) for i in range(size - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapify(heap)
        done = 0
        while heap:
            _, i, made, left, right = heappop(heap)
            j = after[i]
            # The pair may be gone: one of its symbols was merged since it was pushed.
            if symbol[i] != left or j >= size or symbol[j] != right:
                continue
            symbol[i], symbol[j] = made, -1
            done += 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if m := merges.get((made, symbol[k])):
                    heappush(heap, (m[0], i, m[1], made, symbol[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbol[h], made))):
                heappush(heap, (m[0], h, m[1], symbol[h], made))
        return size - done

    def count(self, text: str) -> int:
        """Tokens of a whole text. A special string inside it is one token."""
        total, known, start = 0, self.known, 0
        parts = []
        if self.special:
            for hit in self.special.finditer(text):
                parts.append(text[start : hit.start()])
                total, start = total + 1, hit.end()
        parts.append(text[start:])
        for part in parts:
            for piece in self.pieces.findall(part):
                n = known.get(piece)
                if n is None:
                    if len(known) >= KNOWN_PIECES:
                        known.clear()
                    n = self.merge_count(piece.encode())
                    if len(piece) <= 64:
                        known[piece] = n
                total += n
        return total


@lru_cache(maxsize=2)
def piece_counter(file: str) -> PieceCounter:
    return PieceCounter(file)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, file: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    ``file`` is a byte-level BPE vocabulary, found on every executor. NULL and empty texts have
    no bytes and no tokens. Rows are counted one by one: repeated rows and NULL ids come out as
    they went in, other columns are not read, an empty table gives an empty result.
    """
    file = file or vocabulary_path()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(file)
        for part, texts in text_chunks(batches):
            tokens = [counter.count(t.decode()) if t else 0 for t in texts]
            size = [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
