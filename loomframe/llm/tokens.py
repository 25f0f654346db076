"""Token counts, byte-level BPE encoding and decoding, and word-vocabulary encoding, all over whole texts in Arrow batches.

All encoders share one plan: a text is cut at places no token can cross, spans
that come again are looked up in a bounded memo, and only new spans go to the
library. Null texts are empty; empty texts have no tokens. Extra columns of the
input never take part, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.chunks import SpanMemo, by_document, safe_spans, sliced, text_bytes, windows, word_spans

#: Longest unsplit span, in bytes, that is encoded in one piece.
LEAF = 4096


def _named(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


# --- token counts -----------------------------------------------------------


@lru_cache(maxsize=4)
def piece_counter(model_path: str) -> SpanMemo:
    """Counts of spans between single spaces, each as it stands after a space.

    The model puts a word mark before a text and for each space. No piece of it
    holds a mark after another character, which is checked here, so no piece
    crosses such a space, and a span without its space encodes as it does in place.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    mark = "▁"
    splits = not any(mark in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size()))
    if not splits or model.encode(" a") == model.encode("a") or model.encode("a b", out_type=str) != [mark + "a", mark + "b"]:
        raise ValueError("the vocabulary has no safe place to cut")

    def encode(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = model.encode([x.decode() for x in spans], num_threads=1)
        return np.empty(0, np.uint32), np.fromiter(map(len, rows), np.int64, len(rows))

    return SpanMemo(encode, with_ids=False)


def token_counts(df: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null or empty text: 0 bytes, 0 tokens. Null and repeated ids stay as they are; an empty table gives none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = piece_counter(model_path)
        for batch in sliced(batches):
            data, offsets = text_bytes(batch.column("text"))
            tokens = np.zeros(batch.num_rows, np.int64)
            for lo, hi, piece, at in windows(data, offsets, words=False, skip=1):
                starts, ends = safe_spans(piece, at, with_space=False)
                tokens[lo:hi] += by_document(memo(piece, starts, ends)[1], starts, at)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": np.diff(offsets), "n_tokens": tokens, "over_limit": tokens > limit})

    return _named(df, id_column, text_column).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


# --- byte-level BPE ---------------------------------------------------------


class ByteBPE:
    """A byte-level BPE of the tokenizers library's file format, with the ids that library gives.

    Merges run in tiktoken, built from the same file. An unsplit run longer than
    ``leaf`` bytes is encoded as a tree: leaves first, in parallel, then each pair
    of neighbours is joined by encoding a growing window around the join until
    its first and last tokens are those that stand there already. A token sequence
    is the encoding of its bytes exactly when each pair of neighbours is, so
    agreement at both edges makes the joined sequence exact.
    """

    def __init__(self, path: str, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.leaf = leaf
        specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        unmapped = {c: b for b, c in byte_letters().items()}
        ranks, vocab = {}, spec["model"]["vocab"]
        order = [(bytes([b]), c) for c, b in unmapped.items()]
        for merge in spec["model"]["merges"]:
            joined = "".join(merge if isinstance(merge, list) else merge.split(" "))
            order.append((bytes(unmapped[c] for c in joined), joined))
        to_id = []
        for token, text in order:
            if token not in ranks:
                ranks[token] = len(ranks)
                to_id.append(vocab[text])
        self.to_id = np.array(to_id + list(specials.values()), np.uint32)
        self.to_rank = np.zeros(int(self.to_id.max()) + 1, np.int64)
        self.to_rank[self.to_id] = np.arange(len(self.to_id))
        self.pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.specials = {text: len(ranks) + k for k, text in enumerate(specials)}
        self.core = tiktoken.Encoding("byte-bpe", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=self.specials)
        self.words = regex.compile(self.pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.token = [*ranks, *(x.encode() for x in self.specials)]
        self.memo = SpanMemo(self._spans)

    def bpe(self, piece: bytes) -> list[int]:
        """Ranks of one run that no pattern splits."""
        return self.core._core_bpe.encode_single_piece(piece)

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            window = self.bpe(b"".join(self.token[x] for x in (*a, *b)))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 4

    def tree(self, piece: bytes) -> list[int]:
        leaves = [piece[k : k + self.leaf] for k in range(0, len(piece), self.leaf)]
        with ThreadPoolExecutor(2) as pool:  # the merges run outside the interpreter's lock
            rows = list(pool.map(self.bpe, leaves))
        while len(rows) > 1:
            rows = [self.joined(rows[k], rows[k + 1]) if k + 1 < len(rows) else rows[k] for k in range(0, len(rows), 2)]
        return rows[0] if rows else []

    def ranks(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self.core.encode_to_numpy(text, allowed_special="all")
        out: list[int] = []

        def plain(part: str) -> None:
            for m in self.words.finditer(part):
                out.extend(self.tree(piece) if len(piece := m[0].encode()) > self.leaf else self.bpe(piece))

        at = 0
        for m in self.special.finditer(text):
            plain(text[at : m.start()])
            out.append(self.specials[m[0]])
            at = m.end()
        plain(text[at:])
        return np.array(out, np.uint32)

    def _spans(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.ranks(x.decode()) for x in spans]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        return (self.to_id[np.concatenate(rows)] if counts.sum() else np.empty(0, np.uint32)), counts

    def encode_windows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, document after the last, ids, ids of each document); a long text comes in parts."""
        data, offsets = text_bytes(column)
        for lo, hi, piece, at in windows(data, offsets, words=False):
            starts, ends = safe_spans(piece, at, with_space=True)
            ids, counts = self.memo(piece, starts, ends)
            yield lo, hi, ids, by_document(counts, starts, at)

    def decode(self, ids: np.ndarray) -> str:
        return self.core.decode_bytes(self.to_rank[ids].tolist()).decode("utf-8", "replace")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_bpe(path: str, leaf: int = LEAF) -> ByteBPE:
    return ByteBPE(path, leaf)


def bpe_encode(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each whole text; null or empty text: no ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in sliced(batches):
            rows: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for lo, _, ids, counts in bpe.encode_windows(batch.column("text")):
                for k, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                    rows[lo + k].append(part)
            flat = [np.concatenate(x) if x else np.empty(0, np.uint32) for x in rows]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            values = np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))], ["doc_id", "ids"])

    return _named(df, id_column, text_column).mapInArrow(encode, "doc_id long, ids array<int>")


def bpe_decode(df: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """doc_id, text of each row's ids; null or no ids: empty."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


def bpe_round_trip(df: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, whether the decoded text is the text (lossless), and with_ids also ids.

    Ids are hashed as little-endian unsigned 32-bit integers, the decoded text as UTF-8, both part by part,
    so a long text is never decoded as a whole. Batches are cut by bytes, so besides one row's ids no more are held
    than those of ``SLICE`` bytes. Null or empty text: 0 tokens and the hashes of nothing. Null and repeated ids stay
    as they are, a row each; an empty table gives no rows.
    """

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in sliced(batches):
            n = batch.num_rows
            tokens, hashes, texts = np.zeros(n, np.int64), [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            flat: list[np.ndarray] = []
            for lo, _, ids, counts in bpe.encode_windows(batch.column("text")):
                begin = 0
                for k, end in enumerate(np.cumsum(counts).tolist(), lo):
                    part, begin = ids[begin:end], end
                    tokens[k] += len(part)
                    hashes[k].update(part.astype("<u4").tobytes())
                    texts[k].update(bpe.decode(part).encode())
                if with_ids:
                    flat.append(ids.astype(np.int32))
            data, offsets = text_bytes(batch.column("text"))
            raw = memoryview(data)
            same = [hashlib.sha256(raw[a:b]).digest() == h.digest() for a, b, h in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts)]
            columns = [batch.column("doc_id"), pa.array(tokens), pa.array([h.hexdigest() for h in hashes], pa.string()), pa.array([h.hexdigest() for h in texts], pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"]
            if not with_ids:
                yield pa.record_batch(columns, names)
                continue
            ends = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            del flat
            yield pa.record_batch([*columns, lists], [*names, "ids"])

    return _named(df, id_column, text_column).mapInArrow(trip, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean" + (", ids array<int>" if with_ids else ""))


# --- word vocabulary --------------------------------------------------------


class WordBPE:
    """The word vocabulary of the tokenizers library: white space is dropped, so every word stands alone.

    Words of Latin letters, digits and common signs, whose normal form and case are
    the same everywhere, are merged in tiktoken, with an end mark after each part;
    all others, and any with a special token's sign, go to the library itself.
    """

    END = "\x01"
    #: Printable ASCII and Latin letters; not U+0130, whose lower case has two characters, and no numbers but digits.
    PLAIN = re.compile("[\x21-\x7e¡-©«-¬®-±´¶-¸»¿-įı-ɏ]*")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        unmapped = {c: b for b, c in byte_letters().items()}
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ended = token.endswith(suffix)
            return bytes(unmapped[c] for c in (token.removesuffix(suffix) if ended else token)) + (self.END.encode() if ended else b"")

        letters = byte_letters()
        order = [(bytes([b]), letters[b]) for b in range(256)] + [(bytes([b]) + self.END.encode(), letters[b] + suffix) for b in range(256)]
        for merge in model["merges"]:
            joined = "".join(merge if isinstance(merge, list) else merge.split(" "))
            order.append((raw(joined), joined))
        ranks, ids = {}, []
        for token, text in order:
            if token not in ranks:
                ranks[token] = len(ranks)
                ids.append(model["vocab"].get(text, 0))
        self.to_id = np.array(ids, np.uint32)
        self.is_end = np.array([token.endswith(self.END.encode()) and len(token) > 1 for token in ranks])
        self.core = tiktoken.Encoding("word-bpe", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.memo = SpanMemo(self._words)

    def _words(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = [x.decode() for x in spans]
        plain = [bool(self.PLAIN.fullmatch(w)) and "<|" not in w for w in words]
        parts = [self.PARTS.findall(w.lower()) if ok else [] for w, ok in zip(words, plain)]
        flat = [x for row in parts for x in row]
        ranks = self.core.encode_to_numpy(self.END.join(flat) + self.END) if flat else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.flatnonzero(self.is_end[ranks]) + 1])
        at = ends[np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)]
        counts, ids = np.diff(at), self.to_id[ranks]
        others = [k for k, ok in enumerate(plain) if not ok]
        if others:
            rows = np.split(ids, at[1:-1])
            for k, e in zip(others, self.library.encode_batch([words[k] for k in others], add_special_tokens=False)):
                rows[k] = np.array(e.ids, np.uint32)
            counts, ids = np.array([len(x) for x in rows]), np.concatenate(rows)
        return ids, counts

    def encode_windows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        data, offsets = text_bytes(column)
        for lo, hi, piece, at in windows(data, offsets):
            starts, ends = word_spans(piece, at)
            ids, counts = self.memo(piece, starts, ends)
            yield lo, hi, ids, by_document(counts, starts, at)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)

