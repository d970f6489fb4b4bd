"""Postings of many documents at once, in numpy: words counted by document, and packed by term for the shuffle.

All is local to a batch, so that a text index moves each posting once, as a few
compressed bytes: documents' ids, lengths and norms cross once for each block,
terms once for all their postings in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BUCKETS = 64
#: Words that are counted, and postings that are packed, at once.
AT_ONCE = 2_000_000
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), values)


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of about AT_ONCE in all, one row at least."""
    group = (np.cumsum(sizes) - sizes) // AT_ONCE
    at = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(sizes)]
    return list(zip(at, at[1:]))


def count_words(id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, length, words, norm, bucket) of (id, terms, bucket); documents without terms are left out, null terms only take a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in _cuts(sizes):
                yield _counted(batch.slice(a, b - a), sizes[a:b], id_col)

    return run


def _counted(batch: pa.RecordBatch, sizes: np.ndarray, id_col: str) -> pa.RecordBatch:
    ids, terms, buckets = batch.columns
    n, words = len(ids), terms.flatten().dictionary_encode()
    code = pc.fill_null(words.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc, place = np.repeat(np.arange(n), sizes), np.arange(len(code)) - np.repeat(_offsets(sizes)[:-1], sizes)
    there = code >= 0
    code, doc, place = code[there], doc[there], place[there]
    key = doc * max(1, len(words.dictionary)) + code
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    tf, one = np.diff(starts, append=len(key)), order[starts]
    norm = np.sqrt(np.bincount(doc[one], (1.0 + np.log(tf)) ** 2, n))
    found = pa.StructArray.from_arrays([words.dictionary.take(pa.array(code[one])), pa.array(tf, pa.int64()), _lists(tf, pa.array(place[order], pa.int32()))], ["term", "tf", "places"])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.bincount(doc, minlength=n), pa.int64()), _lists(np.bincount(doc[one], minlength=n), found), pa.array(norm), buckets], [id_col, "length", "words", "norm", "bucket"])


def pack(slices: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (part, block) of (id, length, norm, words). A part holds some buckets, or a slice of a bucket: the bucket's postings of some blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 31
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False)
            for a, b in _cuts(sizes):
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
                if size >= AT_ONCE:
                    yield _packed(held, slices, parts, turn)
                    held, size, turn = [], 0, turn + 1
        if size:
            yield _packed(held, slices, parts, turn)

    return run


def _packed(held: list[pa.RecordBatch], slices: int, parts: int, turn: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, length, norm, words = (table.column(i).chunk(0) for i in range(4))
    doc = np.repeat(np.arange(len(ids)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    terms, tf, places = words.flatten().flatten()
    terms = terms.dictionary_encode()
    vocabulary = terms.dictionary
    bucket = np.fromiter((bucket_of(w) for w in vocabulary.cast(pa.binary()).to_pylist()), np.int64, len(vocabulary))
    part = bucket * slices + turn % slices if slices > 1 else bucket * parts // BUCKETS
    rank = np.empty(len(vocabulary), np.int64)
    rank[pc.sort_indices(vocabulary).to_numpy()] = np.arange(len(vocabulary))
    by_part = np.lexsort((rank, part))
    rank[by_part] = np.arange(len(vocabulary))
    at = rank[terms.indices.to_numpy()]
    order = np.argsort(at, kind="stable")
    counts, doc = np.bincount(at, minlength=len(vocabulary)), doc[order]
    tf, places, vocabulary = tf.to_numpy()[order], places.take(pa.array(order)), vocabulary.take(pa.array(by_part))
    ends, part = _offsets(counts), part[by_part]
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
    blocks = []
    for a, b in zip(edges, edges[1:]):
        x, y = int(ends[a]), int(ends[b])
        docs, own = np.unique(doc[x:y], return_inverse=True)
        some = pa.array(docs)
        blocks.append(_block({"terms": vocabulary.slice(a, b - a), "counts": counts[a:b].astype(np.int32), "ids": ids.take(some), "lengths": length.take(some), "norms": norm.take(some), "doc": own.astype(np.int32), "tf": tf[x:y].astype(np.int32), "places": places.slice(x, y - x).flatten()}))
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]], pa.int32()), pa.array(blocks, pa.binary())], ["part", "block"])


def _block(columns: dict) -> bytes:
    """One row of lists, compressed."""
    values = [v if isinstance(v, pa.Array) else pa.array(v) for v in columns.values()]
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], list(columns))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=_OPTIONS) as writer:
        writer.write_batch(row)
    return out.getvalue().to_pybytes()


def unpack(id_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, id, tf, length, norm, places, bucket) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(1):
                (row,) = pa.ipc.open_stream(block.as_buffer())
                terms, counts, ids, lengths, norms, doc, tf, places = (c.flatten() for c in row.columns)
                counts, tf = counts.to_numpy(), tf.to_numpy()
                each = pa.array(np.repeat(np.arange(len(terms)), counts))
                bucket = np.fromiter((bucket_of(w) for w in terms.cast(pa.binary()).to_pylist()), np.int32, len(terms))
                columns = [terms.take(each), ids.take(doc), pa.array(tf, pa.int64()), lengths.take(doc), norms.take(doc), _lists(tf, places), pa.array(np.repeat(bucket, counts))]
                yield pa.RecordBatch.from_arrays(columns, ["term", id_col, "tf", "length", "norm", "places", "bucket"])

    return run
