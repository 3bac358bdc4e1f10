"""Alignment of two tokenizers over the same text.

Both encode the text with a space before it: A is byte-level BPE, B a piece model that adds the space itself. Tokens
become byte ranges. In each batch ``merge_asof``, keyed by document, finds for each token start the other side's
covering token; the union of both directions is every pair of tokens that overlap. Where both tokens of a
pair end together, a group ends; such pairs are the links.

Of tokens that end together one is a suffix of the other, so there are no more different links than bytes in both
vocabularies (``most_links``). That bounds the table of corpus-wide counts, which goes to all tasks.

B's texts are cut before each run of spaces; no piece has a space after another character (checked when the model is
read), so segments are encoded on their own, each distinct one once per worker. A batch whose pieces do not give its
bytes again is encoded once more text by text with the library.

Texts that are null, empty, no valid UTF-8, or whose joined bytes differ from space and text have no tokens. Strings of special tokens
are plain text. Very long texts are handled whole, repeated rows are rows of their own, a null id stays; an empty table gives
no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, vocabulary_path
from .common import Hashed, only, raw, slices, small_batches, staged

CACHE_SEGMENTS = CACHE_WORDS = 150_000
SLICE = 1 << 18
SLICE_LINKS = 1 << 18
BATCH_BYTES = 4 << 20
SPACE = 0x20


@functools.lru_cache(maxsize=1)
def plain_encoder(path: str) -> Encoder:
    """A's encoder; strings of special tokens are plain text."""
    made = Encoder(path)
    made.special = {}
    return made


class Pieces:
    """B's encoder with the bytes of its pieces and a cache of segments."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(a != "▁" and b == "▁" for s in names for a, b in zip(s, s[1:])):
            raise ValueError("pieces go on after a space; segments are not independent")
        self.bytes_of = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(s[3:5], 16)]) if self.model.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.start_of = np.cumsum(self.length_of) - self.length_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lone_space = names.index("▁")
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space, which the model adds itself."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []
        return [[self.lone_space] if t == " " else ids for t, ids in zip(texts, found)]

    def text(self, data: bytes) -> np.ndarray:
        """Ids of one whole text (with the space before it)."""
        return np.array(self._encoded([data.decode("utf-8", "replace")])[0], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.length_of[ids]
        if not len(ids):
            return np.zeros(0, np.uint8)
        ends = np.cumsum(lengths)
        return self.all_bytes[np.repeat(self.start_of[ids] - (ends - lengths), lengths) + np.arange(ends[-1])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (each begins with a space, or is empty), and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space = data == SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        code, distinct = pd.factorize(Hashed(data)(begin, end))
        if len(self.slot) > CACHE_SEGMENTS:
            self._forget()
        slot = np.fromiter((self.slot.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        if len(new := np.flatnonzero(slot < 0)):
            seen = np.zeros(len(distinct), np.int64)
            seen[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            whole = data.tobytes()
            found = self._encoded([whole[a:b].decode("utf-8", "replace") for a, b in zip(begin[seen[new]].tolist(), end[seen[new]].tolist())])
            base = len(self.slot)
            self.flat = np.concatenate([self.flat, *[np.array(ids, np.int32) for ids in found]])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(ids) for ids in found])])
            self.slot.update(zip(distinct[new].tolist(), range(base, base + len(new))))
            slot[new] = np.arange(base, base + len(new))
        slots = slot[code]
        counts = (self.at[1:] - self.at[:-1])[slots]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.at[slots] - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[np.searchsorted(begin, offsets)]


@functools.lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _valid(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
        return True
    except UnicodeDecodeError:
        return False


def _rows(at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


@dataclass
class Aligned:
    """Tokens of both sides of one slice of texts, and every pair that overlaps, in the order of their ends."""

    a: np.ndarray  # ids of A, all texts
    b: np.ndarray
    a_at: np.ndarray  # where each text's ids begin
    b_at: np.ndarray
    a_end: np.ndarray  # byte offsets in the slice
    b_end: np.ndarray
    left: np.ndarray  # pairs, as positions in a and b
    right: np.ndarray

    @property
    def linked(self) -> np.ndarray:
        """Which pairs end together."""
        return self.a_end[self.left] == self.b_end[self.right]


def align_slice(texts: pa.Array, a_model: Encoder, b_model: Pieces) -> Aligned:
    spaced = pc.if_else(pc.greater(pc.binary_length(texts := pc.fill_null(texts.cast(pa.large_string()), "")), 0), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), pa.scalar("", pa.large_string()))
    data, offsets = raw(spaced)
    if not _valid(data):
        good = np.array([_valid(data[x:y]) for x, y in zip(offsets[:-1], offsets[1:])])
        data, offsets = data[np.repeat(good, np.diff(offsets))], np.concatenate([[0], np.cumsum(np.where(good, np.diff(offsets), 0))])
    b, b_at = b_model.encode(data, offsets)
    if not np.array_equal(b_model.decode(b), data):
        # of a text that differs, the library's own answer decides: such texts have no tokens
        made, good = [], np.ones(len(offsets) - 1, bool)
        for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:])):
            ids = b[b_at[i]: b_at[i + 1]]
            if not np.array_equal(b_model.decode(ids), data[x:y]):
                ids = b_model.text(data[x:y].tobytes())
                if not np.array_equal(b_model.decode(ids), data[x:y]):
                    good[i], ids = False, ids[:0]
            made.append(ids)
        b, b_at = np.concatenate([np.zeros(0, np.int32), *made]), np.concatenate([[0], np.cumsum([len(m) for m in made])])
        data, offsets = data[np.repeat(good, np.diff(offsets))], np.concatenate([[0], np.cumsum(np.where(good, np.diff(offsets), 0))])
    if len(a_model.slot) > CACHE_WORDS:
        a_model._forget()
    a, a_at = a_model.encode(data, offsets)  # byte-level: its bytes are the text's
    a_end, b_end = np.cumsum(a_model.length_of[a]), np.cumsum(b_model.length_of[b])
    a_start, b_start = a_end - a_model.length_of[a], b_end - b_model.length_of[b]
    sides = [pd.DataFrame({"doc": _rows(at), "start": start, name: np.arange(len(start))}) for name, at, start in (("a", a_at, a_start), ("b", b_at, b_start))]
    if not len(a):
        none = np.zeros(0, np.int64)
        return Aligned(a, b, a_at, b_at, a_end, b_end, none, none)
    over_a = pd.merge_asof(sides[0], sides[1], on="start", by="doc")
    over_b = pd.merge_asof(sides[1], sides[0], on="start", by="doc")
    inside = b_start[over_b["b"].to_numpy()] > a_start[over_b["a"].to_numpy()]  # equal starts are in the first direction
    left = np.concatenate([over_a["a"].to_numpy(), over_b["a"].to_numpy()[inside]])
    right = np.concatenate([over_a["b"].to_numpy(), over_b["b"].to_numpy()[inside]])
    order = np.argsort(left + right, kind="stable")  # both grow along the text: each step leaves one token or both
    return Aligned(a, b, a_at, b_at, a_end, b_end, left[order], right[order])


def most_links(a_model: Encoder, b_model: Pieces) -> int:
    """Bound of the number of different links: one token's bytes are a suffix of the other's."""
    return int(a_model.length_of.sum() + b_model.length_of.sum())


@functools.cache
def _written(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. most - 1 and a byte for what follows, one after the other, and where each begins."""
    texts = [f"{i} ".encode() for i in range(most)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def shown_groups(x: Aligned) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3`` of each text: the bytes of all texts, and where each begins; every text ends with one more ``;``."""
    link = x.linked
    last_a, last_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    last_a[x.left[link]], last_b[x.right[link]] = True, True
    a_ends, b_ends = np.flatnonzero(last_a), np.flatnonzero(last_b)  # as many: a group has one of each
    a_group, b_group = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    place_a = np.arange(len(x.a)) + np.concatenate([[0], b_ends + 1])[a_group]
    place_b = np.arange(len(x.b)) + np.append(a_ends + 1, 0)[b_group]
    n = len(x.a) + len(x.b)
    ids, after = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = x.a, x.b
    after[place_a[last_a]], after[place_b[last_b]] = ord("|"), ord(";")
    digits, starts = _written(1 + int(ids.max(initial=0)) | 0xFFFF)
    size = starts[ids + 1] - starts[ids]
    ends = np.cumsum(size)
    out = digits[np.repeat(starts[ids] - (ends - size), size) + np.arange(ends[-1] if n else 0)]
    out[ends - 1] = after
    return out, np.concatenate([[0], ends])[x.a_at + x.b_at]


def _codes(x: Aligned) -> np.ndarray:
    link = x.linked
    return (x.a[x.left[link]].astype(np.int64) << 32) | x.b[x.right[link]]


def overlaps(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per pair of tokens that overlap: doc_id, a_pos, b_pos (their numbers in the text), a_id, b_id, end_together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SLICE):
            x = align_slice(part.column(1), plain_encoder(a_path), pieces(b_path))
            row = _rows(x.a_at)[x.left]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(x.left - x.a_at[row]), pa.array(x.right - x.b_at[row]), pa.array(x.a[x.left].astype(np.int32)), pa.array(x.b[x.right].astype(np.int32)), pa.array(x.linked)],
                ["doc_id", "a_pos", "b_pos", "a_id", "b_id", "end_together"],
            )

    source = only(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, a_pos bigint, b_pos bigint, a_id int, b_id int, end_together boolean")


def groups(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, links (array of a_id << 32 | b_id in order), groups_sha256 of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SLICE):
            x = align_slice(part.column(1), plain_encoder(a_path), pieces(b_path))
            shown, at = shown_groups(x)
            view = memoryview(shown.tobytes())
            hashes = ["" if a == b else hashlib.sha256(view[a: b - 1]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            row = _rows(x.a_at)[x.left[x.linked]]
            n = np.bincount(row, minlength=part.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(_codes(x)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(x.a_at)), pa.array(np.diff(x.b_at)), pa.array(n), pa.array(n), lists, pa.array(hashes, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "links", "groups_sha256"],
            )

    source = only(docs, doc_id=doc_id, text=text)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, links array<bigint>, groups_sha256 string")


def _by_links(batches: Iterator[pa.RecordBatch], links: str = "links") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The same rows in pieces of about ``SLICE_LINKS`` links, a longer list by itself: rows, how many links each has, and the links."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(links))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + SLICE_LINKS, "right")))
            yield batch.slice(first, last - first), np.diff(ends[first:last], prepend=done), lists.slice(first, last - first).flatten().to_numpy()
            first = last


def link_counts(found: DataFrame) -> DataFrame:
    """link, n: how often each pair of ids is linked in all rows of ``groups``.

    A task keeps one table of its different links, no more than ``most_links``, and adds piece after piece to it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, _, links in _by_links(batches):
            more, times = np.unique(links, return_counts=True)
            met, at = np.unique(np.concatenate([link, more]), return_inverse=True)
            total = np.zeros(len(met), np.int64)
            total[at[: len(link)]] = n
            total[at[len(link):]] += times
            link, n = met, total
        yield pa.RecordBatch.from_arrays([pa.array(link), pa.array(n)], ["link", "n"])

    return found.select("links").mapInArrow(run, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A link's count is that of its pair of ids over all rows; ``n_best`` counts links whose count is the highest of their B id.
    """
    spark = docs.sparkSession
    found = staged(groups(docs, a_path or vocabulary_path(), b_path or vocabulary_path("piece_bpe_32k.model"), doc_id, text))
    with small_batches(spark, BATCH_BYTES):
        counted = link_counts(found).toPandas()  # at most ``most_links`` rows, whatever the corpus
    order = np.argsort(counted["link"].to_numpy())
    link, n = counted["link"].to_numpy()[order].astype(np.int64), counted["n"].to_numpy()[order].astype(np.int64)
    b = link & 0xFFFFFFFF
    highest = np.zeros(1 + int(b.max(initial=0)), np.int64)
    np.maximum.at(highest, b, n)
    sent = spark.sparkContext.broadcast((link, n, n == highest[b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = sent.value
        for part, sizes, links in _by_links(batches):
            ends = np.cumsum(sizes)
            i = np.searchsorted(link, links)
            total = lambda v: np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(v)])[ends]]))
            keep = [part.column(part.schema.get_field_index(c)) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(total(best[i].astype(np.int64))), pa.array(total(n[i])), part.column(part.schema.get_field_index("groups_sha256"))],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    with small_batches(spark, BATCH_BYTES):
        return staged(found.mapInArrow(run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"))
