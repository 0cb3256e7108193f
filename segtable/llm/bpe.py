"""Byte-level BPE with word ends: encoding by batched merge rounds, and decoding.

A text is cut at ASCII white space; what lies between (a *chunk*) always gives the same
tokens, so each worker merges each distinct chunk once and then looks it up.  New chunks are
merged together: the symbols of all their words lie in one flat array, and each round merges
in every word its lowest-ranked pair, found by binary search over the sorted pair keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, ids array<int>, decoded string"
_NONE = np.iinfo(np.int32).max
_loaded: dict[str, Encoder] = {}


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Encoder:
    """One vocabulary.  ``keep``: how many chunks are remembered before starting afresh."""

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        # The library's own Unicode rules, for chunks that are not ASCII.
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        self.end, vocab = model["end_of_word_suffix"], model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): v for k, v in special.items()}
        self.special_at = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")")
        self.names = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for name, i in [*vocab.items(), *special.items()]:
            self.names[i] = name
        self.letter = byte_letters()
        self.to_letter = {b: self.letter[b] for b in range(128)}
        self.inner = {c: vocab[c] for c in self.letter}
        self.last = {c: vocab[c + self.end] for c in self.letter}
        self.size = np.int64(len(self.names))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.size) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.held = 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words in byte letters, flat, and where each word starts."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        inner, last = self.inner, self.last
        sym = np.array([inner[c] for c in "".join(words)], np.int64)
        stop = np.cumsum(size)
        sym[stop - 1] = [last[w[-1]] for w in words]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), _NONE, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks(sym[inside], sym[inside + 1])
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, head)
            count = np.diff(np.r_[head, len(sym)])
            live = np.repeat(low < _NONE, count)
            if not live.all():
                done.append((word[~live], sym[~live]))
                sym, word, rank = sym[live], word[live], rank[live]
                low, count = low[low < _NONE], count[low < _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, count))
            # Of overlapping pairs (one symbol three times or more) each other one, from the left.
            chain = np.r_[False, (hit[1:] == hit[:-1] + 1)]
            if chain.any():
                start = np.maximum.accumulate(np.where(chain, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            rank[hit] = _NONE
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            at = moved[hit]
            sym, word, rank = sym[stay], word[stay], rank[stay]
            again = np.unique(np.concatenate([at, at - 1]))
            again = again[(again >= 0) & (again < len(sym) - 1)]
            same = word[again] == word[again + 1]
            rank[again[~same]] = _NONE
            again = again[same]
            rank[again] = self.ranks(sym[again], sym[again + 1])
            if len(at) and at[-1] == len(sym) - 1:
                rank[-1] = _NONE
        where = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(where, kind="stable")
        return ids[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(words)))])

    def pieces(self, text: bytes) -> list[str]:
        """The words, in byte letters, of a text without special tokens."""
        if text.isascii():
            low = text.decode().lower()
            found = self.ascii.findall(low)
            return found if low.isprintable() else [w.translate(self.to_letter) for w in found]
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text.decode()))]

    def learn(self, chunks: list[bytes]) -> None:
        """Remember the tokens of new chunks."""
        number: dict[str, int] = {}
        parts: list[list[int]] = []
        for chunk in chunks:
            mine = []
            for piece in self.special_at.split(chunk) if b"<|" in chunk else (chunk,):
                if piece in self.special:
                    mine.append(-1 - self.special[piece])
                elif piece:
                    mine += [number.setdefault(w, len(number)) for w in self.pieces(piece)]
            parts.append(mine)
        ids, at = self.merge(list(number)) if number else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((i for p in parts for i in p), np.int64, int(size.sum()))
        token = flat < 0
        count = np.where(token, 1, at[np.maximum(flat, 0) + (0 if token.all() else 1)] - at[np.maximum(flat, 0)] if number else 1)
        out = gather(ids, np.where(token, 0, at[np.maximum(flat, 0)]), np.where(token, 0, count)) if number else np.zeros(0, np.int32)
        if token.any():
            whole = np.empty(int(count.sum()), np.int32)
            begin = np.cumsum(count) - count
            mark = np.zeros(len(whole), bool)
            mark[begin[token]] = True
            whole[mark], whole[~mark] = -1 - flat[token], out
            out = whole
        each = np.zeros(len(parts), np.int64)
        np.add.at(each, np.repeat(np.arange(len(parts)), size), count)
        first = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(each)])
        self.flat = np.concatenate([self.flat, out])
        self.place.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.held += sum(map(len, chunks))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat, and each text's offsets."""
        if len(self.place) > self.keep or self.held > 32 << 20:
            self.forget()
        split = [t.split() for t in texts]
        place = self.place
        new = {w for s in split for w in s if w not in place}
        if new:
            self.learn(list(new))
        at = np.fromiter((place[w] for s in split for w in s), np.int64)
        count = self.starts[at + 1] - self.starts[at]
        ids = gather(self.flat, self.starts[at], count)
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.concatenate([[0], np.concatenate([[0], np.cumsum(count)])[ends]])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' names joined by one space, as a vocabulary without a decoder gives."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each row, one after another."""
    begin = np.cumsum(count) - count
    return flat[np.arange(int(count.sum())) + np.repeat(start - begin, count)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of each whole text, and the text that they decode to.

    ``path``: a tokenizer file that every executor has (each has the library installed).
    The result equals the library's encoding without added special tokens; special tokens
    that stand in a text are recognised.  A null or empty text has no ids and decodes to the
    empty string.  Rows are independent: no shuffle, repeated rows give repeated results, a
    null doc_id stays null, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            size, a = batch.column(1).cast(pa.large_binary()), 0
            lens = np.array([0 if v is None else v for v in pa.compute.binary_length(size).to_pylist()], np.int64)
            total = np.cumsum(lens)
            while a < batch.num_rows:
                done = total[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(total, done + (2 << 20), "right")))
                ids, off = e.encode([x or b"" for x in size.slice(a, b - a).to_pylist()])
                decoded = [e.decode(ids[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
                a = b

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
