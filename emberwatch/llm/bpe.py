"""BPE encoding that encodes what documents share once, by content-defined chunks."""

from __future__ import annotations

import hashlib
import os
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from emberwatch.llm.text import encoded, per_batch

VOCABULARY = "word_bpe_49k.json"

#: A cut follows a byte where the rolling hash of the last WINDOW bytes ends in MASK_BITS zeros.
WINDOW, MASK_BITS = 16, 8
#: Kept results per worker. A full store of words becomes the older one, whose words in use come
#: over; a full store of chunks starts anew. Either costs time only and changes nothing.
MOST_CHUNKS, MOST_WORDS = 10_000, 200_000

#: A fixed pseudo-random number for each byte value.
_GEAR = np.random.default_rng(42).integers(0, 2**32, 256, dtype=np.uint32)

Piece = tuple[int, bytes, str]  # tokens, ids as little-endian 32-bit integers, decoded text
EMPTY: Piece = (0, b"", "")

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores are Spark's


def cut_points(data: bytes) -> list[int]:
    """Ends of chunks by content: equal passages are cut alike wherever they stand.

    The hash is a sum of a byte's number shifted by its distance, over the last WINDOW bytes,
    so a cut depends on these bytes only.
    """
    numbers = _GEAR[np.frombuffer(data, np.uint8)]
    rolled = numbers.copy()
    step = 1
    while step < WINDOW:  # doubles the number of bytes that the sum covers
        rolled[step:] += rolled[:-step] << np.uint32(step)
        step *= 2
    cuts = np.flatnonzero(rolled >> np.uint32(32 - MASK_BITS) == 0) + 1
    return [*cuts[cuts < len(data)].tolist(), len(data)]


class Chunk:
    """Open start and end, and the words between: first as such, then encoded."""

    __slots__ = ("head", "tail", "words", "solid", "piece")

    def __init__(self, content: bytes):
        self.words = content.split()
        self.solid = self.words == [content]
        self.head = b"" if content[:1].isspace() or not self.words else self.words.pop(0)
        self.tail = b"" if content[-1:].isspace() or not self.words else self.words.pop()
        self.piece: Piece = EMPTY


class ChunkEncoder:
    """Encodes and decodes whole texts; equal to the tokenizer's own result.

    A tokenizer file without a decoder decodes to its tokens' names with a space between.

    White space ends every token of this tokenizer and is dropped, so the words of a chunk that
    stand between two white spaces have the same ids in any text. Only a chunk's ends can
    change: what stands before its first and after its last white space is left open, and the
    open ends that meet at a join are encoded again as one. A chunk without white space is open
    as a whole and goes on to the next join.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = {number: name for name, number in names.items()}
        self.words: dict[bytes, Piece] = {}
        self.older: dict[bytes, Piece] = {}
        self.chunks: dict[bytes, Chunk] = {}

    def _learn(self, words: set[bytes]) -> None:
        """Have all these words in the store; encode the new ones."""
        if len(self.words) > MOST_WORDS:
            self.words, self.older = {}, self.words
        missing = words.difference(self.words)
        known = missing.intersection(self.older)
        self.words.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new = list(missing.difference(known))
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            texts = [word.decode("utf-8", "surrogatepass") for word in part]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for word, encoding in zip(part, found, strict=True):
                ids = encoding.ids
                told = " ".join([self.tokens[i] for i in ids])
                self.words[word] = (len(ids), array("I", ids).tobytes(), told)

    def _joined(self, pieces: list[Piece]) -> Piece:
        pieces = [piece for piece in pieces if piece[0]]
        if not pieces:
            return EMPTY
        counts, ids, told = zip(*pieces, strict=True)
        return sum(counts), b"".join(ids), " ".join(told)

    def _split(self, text: str | None) -> list[bytes | Chunk]:
        """The text's chunks in order, with the words that stand across joins between them."""
        data = encoded(text)
        out: list[bytes | Chunk] = []
        open_end = b""
        start = 0
        for end in cut_points(data) if data else []:
            chunk = self.chunks.get(content := data[start:end])
            if chunk is None:
                chunk = self.chunks[content] = Chunk(content)
            start = end
            if chunk.solid:
                open_end += content
                continue
            if open_end or chunk.head:
                out.append(open_end + chunk.head)
            out.append(chunk)
            open_end = chunk.tail
        return [*out, open_end] if open_end else out

    def encode(self, texts: list[str | None]) -> list[Piece]:
        """Ids and decoded text of each text; all that is new in them is encoded in one go."""
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks = {}
        split = [self._split(text) for text in texts]
        new = {part for parts in split for part in parts if isinstance(part, Chunk) and part.words}
        words = {part for parts in split for part in parts if isinstance(part, bytes)}
        self._learn(words.union(*(chunk.words for chunk in new)))
        for chunk in new:
            chunk.piece = self._joined([self.words[word] for word in chunk.words])
            chunk.words = []
        return [
            self._joined([p.piece if isinstance(p, Chunk) else self.words[p] for p in parts])
            for parts in split
        ]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _path(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, token_ids (array), decoded.

    `path` names a tokenizers file that every executor has (the installed vocabulary if none) and
    whose tokens never hold white space. A null or empty text has no ids and decodes to an empty
    text; repeated rows each give a row, an empty table none.
    """

    def encode(rows: dict[str, list]) -> dict[str, list]:
        found = _encoder(_path(path)).encode(rows["text"])
        ids = [np.frombuffer(p[1], "<u4").astype("i4") for p in found]
        return {"doc_id": rows["doc_id"], "token_ids": ids, "decoded": [p[2] for p in found]}

    return per_batch(
        docs.select("doc_id", "text"), encode, "doc_id long, token_ids array<int>, decoded string"
    )


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As `bpe_encode`, but with digests of both in place of the ids and the text."""

    def digest(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for n, ids, told in _encoder(_path(path)).encode(rows["text"]):
            out["n_tokens"].append(n)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(encoded(told)).hexdigest())
        return {"doc_id": rows["doc_id"]} | out

    return per_batch(
        docs.select("doc_id", "text"),
        digest,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{folder}/documents.parquet"))
