"""Repeated passages by suffix order, built column by column over many short documents.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are
judged on the input, whole texts, as UTF-8 bytes; nothing crosses documents.

1. Texts are cut at places that their content names, about every 256 bytes. A chunk is the windows of ``length`` bytes that start between two
   cuts, with all their bytes. Equal chunks are one: those of larger documents go at once, as the least document's starts there too, and take no further part.
2. Texts are dealt to blocks of about ``BLOCK_BYTES`` by a hash of their id. Every other window has a key, the
   least hash of the ``GRAM``-byte strings in it, so equal windows have equal keys; neighbours mostly share theirs and form a run. Each
   block sends its different keys, one row each. A key stays when two documents have it.
3. Each block cuts the runs of such keys into pieces: a run's windows with all their bytes, at most ``2 * length - GRAM``. Of
   equal pieces in a block the one of the least document is sent; the others go at once. Pieces of one key meet in
   one task; a key with more than ``MOST_RUNS`` runs is dealt by whole windows instead, of which a block sends each once.
4. Pieces, equal ones once, are a collection whose windows are its documents. Their suffix order is built column by column, from the last to the
   first: every round puts one more symbol (two bytes) before each document's suffix. The symbols before the suffixes, in suffix order, are the
   collection's Burrows-Wheeler transform; dealing them stably by symbol gives the next order, and two neighbours share all symbols when they did and the new one is
   the same. A suffix that shares all with no other belongs to a window that occurs once; it leaves. After ``length / 2`` rounds windows that
   agree stand side by side; the least document of each such stretch decides for all in it. Every round is one sequential pass
   over the columns of a collection. Collections end where a key ends once they hold ``COLLECTION_BYTES``, and arrive sorted from
   Spark's shuffle files: those are the sequential external files, arrays in memory are bounded by a collection.
5. Spans found go back to their blocks, where runs are joined and the bytes cut out.

Steps 2 to 5 are one plan: the texts are shuffled once, and that exchange is read three times. Only keys, chunks and pieces cross the network besides.

Null text is empty. Texts shorter than ``length`` lose nothing. Rows of one id are one document: they take nothing from each
other, each has a row in the result. A row with a null id has no order: it loses nothing and takes nothing. Very long texts are handled whole, in one
block. An empty table gives no rows. Other columns are not looked at, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Hashed, mix, only, raw, signed, slices, staged

LENGTH, GRAM, SYMBOL = 50, 16, 2
BLOCK_BYTES = 4 << 20
SLICE = 1 << 20
COLLECTION_BYTES = 1 << 20
CHUNK_BITS = 8  # a cut at one in 256 places
MOST_RUNS = 10_000
INFO_BITS = 21  # of them one says whether several documents of the block have the key, the others count its runs
MOST_INFO = (1 << (INFO_BITS - 1)) - 1


class Runs:
    """Runs of windows with one key in texts that lie one after the other: text, start, number of windows, key.

    Windows that start at a place of ``gone`` take no part. Keys keep the bits of ``mask``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: Hashed, length: int, gram: int, gone: np.ndarray | None = None, mask: int = -1):
        windows = np.maximum(np.diff(offsets) - length + 1, 0)
        ends = np.cumsum(windows)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            self.text = self.start = self.count = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.int64)
            return
        at = np.arange(len(data) - gram + 1)
        least, width, reach = hashed(at, at + gram), length - gram + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[: len(least) - reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach:])
        start = np.repeat(offsets[:-1] - (ends - windows), windows) + np.arange(total)
        if gone is not None and gone.any():
            start = start[~gone[start]]
            total = len(start)
        key = least[start]
        new = np.ones(total, bool)
        new[1:] = (key[1:] != key[:-1]) | (np.diff(start) > 1)  # between texts lie at least length - 1 bytes without windows
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, total))
        cuts = (count + width - 1) // width  # of bounded length, also in texts that repeat one character
        run = np.repeat(np.arange(len(first)), cuts)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, count = first[run] + nth * width, np.minimum(width, count[run] - nth * width)
        self.start, self.count, self.key = start[first], count, signed(mix(key[first]) & np.uint64(mask & 0xFFFFFFFFFFFFFFFF))
        self.text = np.searchsorted(offsets, self.start, "right") - 1


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each row, one row after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _parts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of stretches of about ``SLICE`` bytes of a block's texts."""
    data, offsets = raw(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def _in_order(block: pa.Table) -> pa.Table:
    """A block's rows by id and text; rows equal in both are interchangeable, so a row's number means the same each time."""
    return block.take(pc.sort_indices(block, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def _numbered(block: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts of the rows with an id, empty for others, their ids, and which have one."""
    ids = block.column("doc_id").combine_chunks()
    known = pc.is_valid(ids)
    return pc.if_else(known, block.column("text").combine_chunks(), ""), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), known.to_numpy(zero_copy_only=False)


def _chunks_of(length: int, gram: int):
    """c, check (what names a chunk), doc, uid, block, at, windows of every chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = raw(part.column(3))
            windows = np.maximum(np.diff(offsets) - length + 1, 0)
            if not windows.any():
                continue
            hashed = Hashed(data)
            place = np.zeros(len(data) + 1, bool)  # where a chunk starts
            at = np.arange(len(data) - gram + 1)
            place[at[(hashed(at, at + gram) >> np.uint64(64 - CHUNK_BITS)) == 0]] = True
            place[_spread(offsets[:-1] + windows, np.diff(offsets) - windows)] = False  # too late for a window
            place[offsets[:-1][windows > 0]] = True
            start = np.flatnonzero(place)
            text = np.searchsorted(offsets, start, "right") - 1
            stop = np.minimum(np.append(start[1:], len(data)), offsets[text] + windows[text])
            end = stop + length - 1
            edge = np.lib.stride_tricks.sliding_window_view(data, 8)
            check = edge[start].copy().view(np.int64).ravel() ^ (edge[end - 8].copy().view(np.int64).ravel() * 31 + (end - start))
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(hashed(start, end))), pa.array(check), part.column(1).take(rows), part.column(2).take(rows), part.column(0).take(rows), pa.array(start - offsets[text]), pa.array(stop - start)],
                ["c", "check", "doc", "uid", "block", "at", "windows"],
            )

    return run


def _gone(block: pa.Table, offsets: np.ndarray, met: pa.Table) -> np.ndarray:
    """Which window starts of a block (in order) go already, by the chunks of ``met`` (uid, at, windows)."""
    out = np.zeros(int(offsets[-1]) + 1, np.int32)
    met = met.filter(pc.is_valid(met.column("uid")))
    uid, at, windows = (met.column(c).to_numpy() for c in ("uid", "at", "windows"))
    mine = block.column("uid").to_numpy()
    order = np.argsort(uid, kind="stable")
    low, high = np.searchsorted(uid[order], mine, "left"), np.searchsorted(uid[order], mine, "right")
    row = np.repeat(np.arange(len(mine)), high - low)
    which = order[_spread(low, high - low)]
    np.add.at(out, offsets[row] + at[which], 1)
    np.add.at(out, offsets[row] + at[which] + windows[which], -1)
    return np.cumsum(out) > 0


def _keys_of(length: int, gram: int, mask: int):
    def run(block: pa.Table, met: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "info": pa.array([], pa.int64())})
        number = block.column("block")[0].as_py()
        block = _in_order(block)
        texts, ids, _ = _numbered(block)
        offsets = raw(texts)[1]
        gone = _gone(block, offsets, met)
        keys, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, data, at in _parts(texts):
            r = Runs(data, at, Hashed(data), length, gram, gone[offsets[first]:], mask)
            keys.append(r.key)
            docs.append(ids[first + r.text])
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(key, kind="stable")  # ids stay in order within a key
        key, doc = key[order], doc[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(key)) - 1 if len(new) else new
        runs = np.minimum(last - new + 1, MOST_INFO)
        return pa.table({"key": pa.array(key[new]), "info": pa.array((number << INFO_BITS) | (runs << 1) | (doc[new] != doc[last]))})

    return run


def _pieces_of(length: int, gram: int, mask: int):
    kinds = [("key", pa.int64()), ("block", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("windows", pa.int64()), ("bytes", pa.binary())]

    def run(block: pa.Table, shared: pa.Table) -> pa.Table:
        met, shared = shared, shared.filter(pc.is_valid(shared.column("key")))
        if not block.num_rows or not shared.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kinds})
        number = block.column("block")[0].as_py()
        block = _in_order(block)
        texts, ids, _ = _numbered(block)
        starts = raw(texts)[1]
        over = _gone(block, starts, met)
        known, wide = shared.column("key").to_numpy(), shared.column("wide").to_numpy()
        order = np.argsort(known)
        known, wide = known[order], wide[order]
        found: list[tuple] = []
        for first, data, offsets in _parts(texts):
            hashed = Hashed(data)
            r = Runs(data, offsets, hashed, length, gram, over[starts[first]:], mask)
            i = np.minimum(np.searchsorted(known, r.key), len(known) - 1)
            hit = known[i] == r.key
            text, start, count, key, split = r.text[hit], r.start[hit], r.count[hit], r.key[hit], wide[i[hit]]
            if split.any():
                each = _spread(start[split], count[split])
                text = np.concatenate([text[~split], np.repeat(text[split], count[split])])
                key = np.concatenate([key[~split], signed(mix(hashed(each, each + length)))])
                start, count = np.concatenate([start[~split], each]), np.concatenate([count[~split], np.ones(len(each), np.int64)])
            size = count + length - 1
            flat = data[_spread(start, size)]
            found.append((first + text, start - offsets[text], count, key, signed(hashed(start, start + size)), flat, size))
        row, at, count, key, content, flat, size = (np.concatenate(x) for x in zip(*found))
        doc, begin = ids[row], np.cumsum(size) - size
        # of equal pieces the first in the order of ids stands for those of larger ids
        order = np.lexsort((at, row, content))
        head = np.append(True, content[order][1:] != content[order][:-1]) if len(order) else np.zeros(0, bool)
        stands = np.zeros(len(order), np.int64)
        stands[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        gone = doc > doc[stands]
        sure = np.flatnonzero(gone & (size == size[stands]))
        same = flat[_spread(begin[sure], size[sure])] == flat[_spread(begin[stands[sure]], size[sure])]
        equal = np.add.reduceat(same, np.cumsum(size[sure]) - size[sure], dtype=np.int64) == size[sure] if len(sure) else np.zeros(0, bool)
        gone[:] = False
        gone[sure[equal]] = True
        stay = np.flatnonzero(~gone)
        sent = np.where(gone, 0, size)
        kept = flat[_spread(begin[stay], size[stay])]
        places = np.concatenate([[0], np.cumsum(sent)]).astype(np.int32)
        valid = pa.array(~gone).buffers()[1]
        packed = pa.Array.from_buffers(pa.binary(), len(gone), [valid, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(kept))])
        columns = [np.where(gone, signed(mix(row.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(24)))), key), np.full(len(row), number), row, doc, at, count]
        return pa.table([*[pa.array(c.astype(np.int64)) for c in columns], packed], names=[n for n, _ in kinds])

    return run


def suffix_order(data: np.ndarray, end: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings of ``symbols`` two-byte symbols before each of the places ``end``, of those that occur more than once.

    Returns where each begins, in the order of their symbols, and whether it differs from the one before it. Each round puts one
    symbol before every suffix: the column of symbols before the suffixes is dealt stably, neighbours agree when they did in the round before.
    """
    symbol = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:] if len(data) > 1 else np.zeros(0, np.uint16)
    at, group = end.astype(np.int32), np.zeros(len(end), np.int32)
    new = np.zeros(len(end), bool)
    for _ in range(symbols):
        if not len(at):
            break
        column = symbol[at - SYMBOL]
        order = np.argsort(column, kind="stable")
        column, at, group = column[order], at[order] - SYMBOL, group[order]
        new = np.ones(len(at), bool)
        new[1:] = (column[1:] != column[:-1]) | (group[1:] != group[:-1])
        stay = ~(new & np.append(new[1:], True))
        at, new = at[stay], new[stay]
        group = np.cumsum(new, dtype=np.int32)
    return at, new


def least_documents(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each window start in the pieces: the least document whose piece holds the window."""
    windows = np.maximum(end - begin - length + 1, 0)
    start = _spread(begin, windows)
    owner = np.repeat(doc, windows)
    out = np.full(len(data) + 1, np.iinfo(np.int64).max)
    out[start] = owner
    at, new = suffix_order(data, start + length, length // SYMBOL)
    if len(at):
        least = np.minimum.reduceat(out[at], np.flatnonzero(new))
        out[at] = least[np.cumsum(new) - 1]
    return out


def _distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal pieces once: which pieces stay, and the number among those of each piece's equal."""
    content = Hashed(data)(begin, begin + size)
    order = np.lexsort((doc, size, content))
    c, s = content[order], size[order]
    same = np.flatnonzero((c[1:] == c[:-1]) & (s[1:] == s[:-1])) + 1
    a, b, n = begin[order[same - 1]], begin[order[same]], s[same]
    equal = np.add.reduceat(data[_spread(a, n)] == data[_spread(b, n)], np.cumsum(n) - n, dtype=np.int64) == n if len(n) else np.zeros(0, bool)
    head = np.ones(len(order), bool)
    head[same[equal]] = False
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(head) - 1
    return order[head], number


def _spans(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """block, row, start, end of what goes, of whole keys of pieces (or of pieces that go at once: null bytes)."""
    block, row, doc, at, windows = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "row", "doc", "at", "windows"))
    packed = batch.column(batch.schema.get_field_index("bytes"))
    sent = pc.is_valid(packed).to_numpy(zero_copy_only=False)
    mine = np.flatnonzero(sent)
    column = packed.filter(pa.array(sent)).cast(pa.large_binary())
    _, places, values = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[places[0]: places[-1]] if len(column) else np.zeros(0, np.uint8)
    begin, size = places[:-1] - places[0], np.diff(places)
    out = [np.flatnonzero(~sent)], [at[~sent]], [at[~sent] + windows[~sent] + length - 1]
    if len(mine):
        stay, number = _distinct(data, begin, size, doc[mine])
        flat = data[_spread(begin[stay], size[stay])]
        ends = np.cumsum(size[stay])
        least = least_documents(flat, ends - size[stay], ends, doc[mine[stay]], length)
        n = windows[mine]
        piece = np.repeat(np.arange(len(mine)), n)
        nth = _spread(np.zeros(len(mine), np.int64), n)
        hit = np.flatnonzero(least[(ends - size[stay])[number[piece]] + nth] < doc[mine[piece]])
        new = np.append(True, (np.diff(hit) > 1) | (piece[hit[1:]] != piece[hit[:-1]])) if len(hit) else np.zeros(0, bool)
        first = hit[new]
        last = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else hit
        owner = mine[piece[first]]
        for x, made in zip(out, (owner, at[owner] + nth[first], at[owner] + nth[last] + length)):
            x.append(made)
    who, start, stop = (np.concatenate(x) for x in out)
    return pa.RecordBatch.from_arrays([pa.array(block[who]), pa.array(row[who]), pa.array(start), pa.array(stop)], ["block", "row", "start", "end"])


def _decided(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def taken() -> pa.RecordBatch:
            return _spans(pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.nbytes for b in held) > COLLECTION_BYTES:
                key = held[-1].column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # sorted: the last key may go on in the next batch
                if cut == 0 and len(held) > 1 and held[-2].column(0)[-1].as_py() == key[-1]:
                    continue
                rest = held[-1].slice(cut)
                held[-1] = held[-1].slice(0, cut)
                held = [b for b in held if b.num_rows]
                if held:
                    yield taken()
                held = [rest]
        if held:
            yield taken()

    return run


def _cut_of(length: int):
    def run(block: pa.Table, spans: pa.Table) -> pa.Table:
        block = _in_order(block)
        data, offsets = raw(block.column("text"))
        over = np.diff(_gone(block, offsets, spans).astype(np.int32), prepend=0)
        change = np.zeros(len(data) + 1, np.int32)
        change[np.flatnonzero(over > 0)] = 1
        np.add.at(change, np.flatnonzero(over < 0) + length - 1, -1)
        spans = spans.filter(pc.is_valid(spans.column("row")))
        row = spans.column("row").to_numpy()
        np.add.at(change, offsets[row] + spans.column("start").to_numpy(), 1)
        np.add.at(change, offsets[row] + spans.column("end").to_numpy(), -1)
        gone = np.cumsum(change[:-1]) > 0
        opens, closes = gone.copy(), gone.copy()
        opens[1:] &= ~gone[:-1]
        closes[:-1] &= ~gone[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # spans end with their text
        opens[inner] |= gone[inner]
        closes[inner - 1] |= gone[inner - 1]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        text = np.searchsorted(offsets, first, "right") - 1
        per = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=block.num_rows))]).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(first - offsets[text]), pa.array(last - offsets[text])], ["start", "end"]))
        left = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer(left), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        return pa.table({"doc_id": block.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "spans": found, "kept": kept})

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, apart from each other), kept (the other bytes) of every row.

    ``length`` is even and at most 126, ``gram`` smaller.
    """
    if length % SYMBOL or not gram < length <= 126:
        raise ValueError("length must be even, above gram and at most 126")
    rows = only(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    mask = (1 << min(63, total.bit_length() + 8)) - 1  # keys by chance equal: fewer than one in 256
    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(blocks))
    rows = rows.select(block.alias("block"), "doc_id", F.xxhash64("doc_id", "text").alias("uid"), "text")
    chunks = rows.filter("doc_id IS NOT NULL").mapInArrow(_chunks_of(length, gram), "c bigint, check bigint, doc bigint, uid bigint, block bigint, at bigint, windows bigint")
    several = chunks.groupBy("c", "check").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").drop("most")
    met = staged(chunks.join(several, ["c", "check"]).filter("least < doc").select("block", "uid", "at", "windows").distinct())
    dealt = rows.repartition("block").groupBy("block")
    keys = dealt.cogroup(met.groupBy("block")).applyInArrow(_keys_of(length, gram, mask), "key bigint, info bigint")
    same = Window.partitionBy("key")
    runs, block_of = F.shiftright("info", 1).bitwiseAND(F.lit(MOST_INFO)), F.shiftright("info", INFO_BITS)
    seen = keys.withColumns({"n": F.count(F.lit(1)).over(same), "all": F.sum(runs).over(same), "any": F.max(F.col("info").bitwiseAND(F.lit(1))).over(same)}).filter("n > 1 or any = 1")
    shared = seen.select(block_of.alias("block"), "key", (F.col("all") > MOST_RUNS).alias("wide"))
    facts = shared.unionByName(met, allowMissingColumns=True)
    pieces = dealt.cogroup(facts.groupBy("block")).applyInArrow(_pieces_of(length, gram, mask), "key bigint, block bigint, row bigint, doc bigint, at bigint, windows bigint, bytes binary")
    spans = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_decided(length), "block bigint, row bigint, start bigint, end bigint")
    found = spans.unionByName(met, allowMissingColumns=True)
    return dealt.cogroup(found.groupBy("block")).applyInArrow(_cut_of(length), "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
