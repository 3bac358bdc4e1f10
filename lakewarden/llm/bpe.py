"""Byte-level BPE over the public vocabulary files: speculate and verify.

Texts are cut into words at positions found by array operations on character classes. Each
distinct word gets a proposal by greedy longest match over the vocabulary. A proposal is the
BPE result exactly when every token of it encodes to itself and every two neighbours stay as
they are when the bytes of both are encoded together; those pair checks are looked up as
arrays, each unknown pair being merged once. Only words that fail are merged exactly.

Results equal those of the ``tokenizers`` library with ``add_special_tokens=False``; the
string of the special token in a text becomes its id, as there. A null text is empty and has
no ids. Texts of any length are handled whole; nothing depends on how rows are batched.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Hashed, mix, only, raw, slices

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: The characters of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the pre-tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE_WORDS = 300_000
NEVER = np.int64(1) << 40
COMMON = 0x3000
CACHE_PAIRS = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.cache
def _classes(below: int) -> np.ndarray:
    major = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((major.get(unicodedata.category(chr(c))[0], OTHER) for c in range(below)), np.uint8, below)
    out[[c for c in WHITE_SPACE if c < below]] = SPACE
    return out


def _printable_bytes() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Lookup:
    """Array look-up of 64-bit keys: open tables, each for the keys that collided in the one before."""

    def __init__(self, keys: np.ndarray, bits: int = 19):
        self.keys, self.mask = keys, (1 << bits) - 1
        self.tables, left = [], np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left], len(self.tables))
            made = np.full(1 << bits, -1, np.int32)
            made[at] = left
            self.tables.append(made)
            left = left[made[at] != left]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return mix(keys.astype(np.uint64) + np.uint64(level)).astype(np.int64) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 for unknown ones."""
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, made in enumerate(self.tables):
            i = made[self._slot(keys[rest], level)]
            hit = (i >= 0) & (self.keys[i] == keys[rest])
            found[rest[hit]] = i[hit]
            rest = rest[(i >= 0) & ~hit]
            if not len(rest):
                break
        return found


class Known:
    """A whole number for each 64-bit key met so far, in sorted arrays: as a dictionary of Python numbers they take ten times the memory."""

    def __init__(self, kind: type):
        self.keys, self.values = np.zeros(0, kind), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], -1).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Takes in different keys that are not known yet."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.values = np.insert(self.keys, at, keys[order]), np.insert(self.values, at, values[order])


class Encoder:
    """One vocabulary with its caches; built once per Python worker by ``encoder``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = _printable_bytes()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.id_of = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and token.encode() not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = {}
        for rank, (a, b) in enumerate(pairs):
            merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        ranked = np.array(list(merges.values()), np.int64).reshape(-1, 2)
        self.merge_ranks, self.merge_ids = np.append(ranked[:, 0], NEVER), np.append(ranked[:, 1], 0)
        self.find_merge = Lookup(np.array([(a << 32) | b for a, b in merges], np.int64))
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.empty = size  # an id of no bytes
        self.bytes_of: list[bytes] = [b""] * (size + 1)
        for token, i in (self.id_of | self.special).items():
            self.bytes_of[i] = token
        self.length_of = np.array([len(t) for t in self.bytes_of], np.int64)
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        plain = sorted(self.id_of.items(), key=lambda x: x[1])
        ids = np.array([i for _, i in plain], np.int64)
        self.vocab_ids = np.append(ids, -1)
        self.find_token = Lookup(Hashed(self.all_bytes)(self.start_of[ids], self.start_of[ids] + self.length_of[ids]))
        self.lengths = sorted({len(t) for t in self.id_of}, reverse=True)
        self.pairs = Known(np.int64)
        self._forget()

    def _forget(self) -> None:
        self.slot = Known(np.uint64)
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def merged(self, data: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once: in each round every word merges its best-ranked
        neighbouring pair, the leftmost on ties. ``data`` holds the words' bytes, ``counts`` their
        lengths (1 or more). Returns (word, id) rows in order of words."""
        ids, word = self.single[data], np.repeat(np.arange(len(counts)), counts)
        rank, into = self._ranks(ids[:-1], ids[1:])
        rank, into = np.append(rank, NEVER), np.append(into, 0)
        rank[np.flatnonzero(word[1:] != word[:-1])] = NEVER  # the last token of a word has no right neighbour
        words, tokens = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            ties = np.flatnonzero((rank == np.repeat(least, size)) & (rank < NEVER))
            best = ties[np.append(True, word[ties[1:]] != word[ties[:-1]])] if len(ties) else ties
            stay = np.repeat(least < NEVER, size)
            words.append(word[~stay])
            tokens.append(ids[~stay])
            ids[best] = into[best]
            stay[best + 1] = False
            last = np.zeros(len(ids), bool)  # merged tokens that now end their word
            last[best] = (best + 2 >= len(ids)) | (word[np.minimum(best + 2, len(ids) - 1)] != word[best])
            fresh = np.zeros(len(ids), bool)
            fresh[best] = True
            ids, word, rank, into, last, fresh = (x[stay] for x in (ids, word, rank, into, last, fresh))
            new = np.flatnonzero(fresh)
            right = new[~last[new]]
            left = new[new > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[new[last[new]]] = NEVER
            for i in (right, left):
                rank[i], into[i] = self._ranks(ids[i], ids[i + 1])
        word, token = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, tokens))
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's merge (``NEVER`` where there is none) and the id it makes."""
        i = self.find_merge((left << 32) | right)
        return self.merge_ranks[i], self.merge_ids[i]

    def _joined(self, *tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each row of token ids, one row after the other, and the rows' lengths."""
        row = np.stack(tokens, 1)
        return self.decode(row.ravel()), self.length_of[row].sum(1)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where words begin, and the number of the first word of each text."""
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        if len(lead) != len(points):
            raise ValueError("a text is not valid UTF-8")
        n = len(points)
        kind = _classes(COMMON if n == 0 or points.max() < COMMON else 0x110000)[points]
        heads = np.zeros(n + 1, bool)  # text and segment starts
        char_offsets = np.searchsorted(lead, offsets)
        heads[char_offsets] = True
        inner = []
        for word in self.special:
            s = word.decode()
            p = text.find(s)
            while p >= 0:
                if char_offsets[np.searchsorted(char_offsets, p, "right")] >= p + len(s):
                    heads[p] = heads[p + len(s)] = True
                    inner.append((p, p + len(s)))
                    p = text.find(s, p + len(s))
                else:
                    p = text.find(s, p + 1)
        run = heads[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        after = np.flatnonzero(run[1:] & ~heads[1:n] & (kind[:-1] == SPACE)) + 1
        start[after - 1] = True
        start[after[points[after - 1] == 0x20]] = False
        quotes = np.flatnonzero((points == 0x27) & start)
        for ending in ENDINGS:
            m = len(ending)
            quote = quotes[quotes + m < n]
            for j, c in enumerate(ending):
                quote = quote[(points[quote + 1 + j] == ord(c)) & ~heads[quote + 1 + j]]
            start[quote + 1] = False
            nxt = quote + 1 + m
            start[nxt[nxt < n]] = True
        for a, b in inner:
            start[a + 1: b] = False
        first = np.flatnonzero(start)
        return lead[first], np.searchsorted(first, char_offsets)

    def _proposals(self, hashed: Hashed, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of each word: (word, token) rows in order of words."""
        words, tokens, pos, live = [], [], begin.copy(), np.arange(len(begin))
        while len(live):
            token = np.full(len(live), -1, np.int64)
            open_ = np.arange(len(live))
            room = (end - pos)[live]
            for length in self.lengths:
                if length > room.max():
                    continue
                try_ = open_[room[open_] >= length]
                if len(try_):
                    at = pos[live[try_]]
                    token[try_] = self.vocab_ids[self.find_token(hashed(at, at + length))]
                    open_ = open_[token[open_] < 0]
                    if not len(open_):
                        break
            words.append(live)
            tokens.append(token)
            pos[live] += self.length_of[token]
            live = live[pos[live] < end[live]]
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _holds(self, codes: np.ndarray) -> np.ndarray:
        """For each (left, right) pair: do the two stay apart when encoded together? (left, -1): does
        the token encode to itself?"""
        code, distinct = pd.factorize(codes)
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs = Known(np.int64)
        known = self.pairs(distinct)
        new = distinct[known < 0]
        if len(new):
            left, right = new >> 32, new & 0xFFFFFFFF
            lone = right == 0xFFFFFFFF
            data, counts = self._joined(left, np.where(lone, self.empty, right))
            word, token = self.merged(data, counts)
            n, first = np.bincount(word, minlength=len(new)), np.searchsorted(word, np.arange(len(new)))
            ok = (n == np.where(lone, 1, 2)) & (token[first] == left)
            ok &= lone | (token[np.minimum(first + 1, len(token) - 1)] == right)
            self.pairs.add(new, ok)
            known[known < 0] = ok
        return known.astype(bool)[code]

    def _learn(self, data: np.ndarray, hashed: Hashed, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encodes new words into the cache."""
        named = {}
        for i in np.flatnonzero(np.isin(end - begin, [len(s) for s in self.special])).tolist():
            if (s := data[begin[i]: end[i]].tobytes()) in self.special:
                named[i] = self.special[s]
        word, token = self._proposals(hashed, begin, end)
        failed = np.zeros(len(begin), bool)
        failed[word[~self._holds((token << 32) | 0xFFFFFFFF)]] = True
        joint = np.flatnonzero(word[1:] == word[:-1])
        if len(joint):
            failed[word[joint[~self._holds((token[joint] << 32) | token[joint + 1])]]] = True
        special = np.zeros(len(begin), bool)
        special[list(named)] = True
        failed &= ~special
        again, size = np.flatnonzero(failed), (end - begin)[failed]
        where = np.repeat(begin[again] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        exact_word, exact = self.merged(data[where], size)
        good = ~failed[word] & ~special[word]
        word = np.concatenate([word[good], again[exact_word], np.array(list(named), np.int64)])
        token = np.concatenate([token[good], exact, np.array(list(named.values()), np.int64)])
        token = token[np.argsort(word, kind="stable")].astype(np.int32)
        base = len(self.slot)
        self.flat = np.concatenate([self.flat, token])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.bincount(word, minlength=len(begin)))])
        self.slot.add(hashes, np.arange(base, base + len(begin)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begin, texts = self.cut(data, offsets)
        end = np.append(begin[1:], len(data))
        hashed = Hashed(data)
        code, distinct = pd.factorize(hashed(begin, end))
        if len(self.slot) > CACHE_WORDS:
            self._forget()
        slot = self.slot(distinct)
        if len(new := np.flatnonzero(slot < 0)):
            seen = np.zeros(len(distinct), np.int64)
            seen[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            self._learn(data, hashed, distinct[new], begin[seen[new]], end[seen[new]])
            slot[new] = np.arange(len(self.slot) - len(new), len(self.slot))
        slots = slot[code]
        counts = (self.at[1:] - self.at[:-1])[slots]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.at[slots] - (ends - counts), counts) + np.arange(ends[-1])]
        ids_at = np.concatenate([[0], ends])[texts]
        if not np.array_equal(self.decode(ids), data):
            # two words of one hash: every word is merged anew, without hashes
            word, ids = self.merged(data, end - begin)
            ids_at = np.searchsorted(word, texts)
            if self.special:
                raise_on = [s for s in self.special if s in data.tobytes()]
                if raise_on:
                    raise ValueError("hash collision in a slice with special tokens; use smaller slices")
        return ids, ids_at

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a sequence of ids."""
        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.all_bytes[np.repeat(self.start_of[ids] - (ends - lengths), lengths) + np.arange(ends[-1])]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_tokens per row; the order of rows and repeated rows are kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in slices(batches):
            ids, at = bpe.encode(*raw(part.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(np.diff(at))], ["doc_id", "ids", "n_tokens"])

    source = only(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens bigint")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id, text: the text of each row's ids, as decoding with special tokens kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in batches:
            texts = [None if row is None else bpe.decode(np.array(row, np.int64)).tobytes().decode("utf-8", "replace") for row in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    source = only(encoded, doc_id="doc_id", ids=ids)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row: encodes, decodes the ids again, digests both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in slices(batches):
            ids, at = bpe.encode(*raw(part.column(1)))
            back = bpe.decode(ids)
            to = np.concatenate([[0], np.cumsum(bpe.length_of[ids])])[at]
            ids, back = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
            rows = range(part.num_rows)
            digests = [hashlib.sha256(ids[4 * at[i]: 4 * at[i + 1]]).hexdigest() for i in rows]
            texts = [hashlib.sha256(bytes(back[to[i]: to[i + 1]]).decode("utf-8", "replace").encode()).hexdigest() for i in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = only(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
