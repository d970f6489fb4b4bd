r"""Language-model scoring of whole texts.

Texts are lower-cased (A-Z) and read as words ``[^\x20\x09-\x0D]+`` and one end.
A causal self-attention model (``attention``) over byte-level BPE ids of the
words, each after one space, gives every word's probability in its context; the
corpus's own word counts are mixed in (weights ``LAMBDA`` and 1 - ``LAMBDA``), both
being distributions over words. A document's score is the log10 probability of
all its words and the end; beside it stands a base score from word counts alone.

1. One pass over the texts tokenises and writes ids in compressed batches, and
   sends packed counts: of words by hash range, and of ids by what precedes them.
2. Word ranges are counted; each batch gets back the counts of its own distinct
   words, in their order, so that nothing grows on the driver or in a broadcast.
3. Id counts (at most vocabulary x 256 numbers) give the classes and shares.
4. The attention model is trained on all windows of all training documents: each
   task trains on its own, in ``ROUNDS`` rounds, and parameters are averaged by
   targets seen; a first batch trains alone, as a common start.
5. Batches meet their word counts and are scored in overlapping windows.

Scale: the texts are never shuffled; ids travel compressed (about half the size
of the Parquet input), words once a batch. The model is 3.5 MB, and 68 bytes
for each id that training holds (at most 3.4 MB), whatever the corpus. Hot words and copies cost one entry a batch.

Defined cases: a null or empty text is the end alone; a null doc_id counts as
the empty string for the fold, so it is trained on; rows that repeat count and
score each; with no training documents N and V are 0, no word is known and the
model is the untrained one; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as A
from . import spans as S
from .common import batches_of, release_shuffles, roomy, save
from .ngram_join import squeeze, unsqueeze

BATCH_BYTES = 4 << 20
LAMBDA = 0.75
ROUNDS = 2
END = 50257  # beyond the vocabulary
IDS = 50258
_END_WORD = np.uint64(0)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's words, lower-cased, each after one space."""
    keep = S.word_bytes(data)
    starts = offsets[:-1][np.diff(offsets) > 0]
    bare = starts[keep[starts]]  # documents that begin with a word, before which a space is put
    before = keep[1:] & ~keep[:-1]  # the white space right before a word
    inner = starts[starts > 0] - 1
    before[inner] = False
    keep[:-1] |= before
    upto = np.concatenate([[0], np.cumsum(keep)])
    out = np.insert(_SPACED[data[keep]], upto[bare], 0x20)
    return out, upto[offsets] + np.searchsorted(bare, offsets)


_SPACED = S.lowered(np.arange(256, dtype=np.uint8))
_SPACED[0x09:0x0E] = 0x20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of normalised documents: each word's hash with the document's end (0) after its words, and the documents' borders."""
    starts, ends, counts = S.words(data, offsets)
    h = S.hash_spans(data, starts, ends)
    h |= h == 0
    return np.insert(h, np.cumsum(counts), _END_WORD), np.concatenate([[0], np.cumsum(counts + 1)])


_over: dict[str | None, tuple[np.ndarray, dict[int, list[int]]]] = {}


def word_ids(path: str | None, ids: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and borders of normalised documents, with ids that reach over words, as two no-break spaces do, cut where words begin."""
    from .bpe import encoder

    if path not in _over:
        own = encoder(path)
        cut = {i: token.split("Ġ") for token, i in own.tokenizer.get_vocab().items() if "Ġ" in token[1:]}
        over = np.zeros(IDS, bool)
        over[list(cut)] = True
        raw = _bytes_of()
        _over[path] = over, {i: [k for j, x in enumerate(parts) if j or x for k in own.single(b" " * (j > 0) + bytes(raw[c] for c in x))] for i, parts in cut.items()}
    over, parts = _over[path]
    hit = np.flatnonzero(over[ids])
    if not len(hit):
        return ids, border
    count = np.ones(len(ids), np.int64)
    count[hit] = [len(parts[i]) for i in ids[hit].tolist()]
    upto = np.concatenate([[0], np.cumsum(count)])
    out = np.repeat(ids, count)
    for i, at in zip(ids[hit].tolist(), upto[hit].tolist()):
        out[at : at + len(parts[i])] = parts[i]
    return out, upto[border]


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in visible}
    for k, b in enumerate(x for x in range(256) if x not in set(visible)):
        byte_of[chr(256 + k)] = b
    return byte_of


def held_out(doc_id: int | None, folds: int = 7, held: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == held


_BASE = "kind int, part int, batch long, doc_id array<long>, payload binary, sizes binary, words binary, held binary"
_BASE_TYPES = [("kind", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("payload", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("held", pa.binary())]


def _row(types: list[tuple], **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(c)], t) for c, t in types], [c for c, _ in types])


def _read(parts: int, path: str | None):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import encoder

        own, me = encoder(path), TaskContext.get().partitionId()
        table = id_values(path)
        for k, t in enumerate(batches_of(it, BATCH_BYTES)):
            docs = t.column(0).to_pylist()
            held = np.array([held_out(d) for d in docs])
            data, offsets = S.flat(t.column(1))
            ids, sizes, words, n_words = [], [], [], []
            for lo, hi in S.chunks(offsets):
                d, o = normalised(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                i, b = word_ids(path, *own.encode(d, o))
                i[b[1:] - 1] = END
                ids.append(i)
                sizes.append(np.diff(b))
                words.append(words_of_ids(table, i, sizes[-1]))
                n_words.append(np.add.reduceat(table[0][i], b[:-1], dtype=np.int64))
            i, n, h, m = (np.concatenate(x) for x in (ids, sizes, words, n_words))
            batch = (me << 32) + k
            yield _row(_BASE_TYPES, kind=0, part=0, batch=batch, doc_id=docs, payload=squeeze((i.astype(np.uint64), 2)), sizes=squeeze((n.astype(np.uint64), 5)), words=squeeze((m.astype(np.uint64), 5)), held=np.packbits(held).tobytes())
            # distinct words, and how often training documents hold them
            u, inverse = distinct(h)
            times = np.bincount(inverse[np.repeat(~held, m)], minlength=len(u)).astype(np.uint64)
            cut = np.searchsorted(range_of_word(u, parts), np.arange(parts + 1))
            for r in range(parts):
                a, b = cut[r], cut[r + 1]
                if b > a:
                    yield _row(_BASE_TYPES, kind=1, part=r, batch=batch, payload=squeeze((np.diff(u[a:b], prepend=np.uint64(0)), 8), (times[a:b], 5)))
            before = np.concatenate([[0], i[:-1].astype(np.int64) + 1])
            before[np.concatenate([[0], np.cumsum(n)[:-1]])] = A.BEGIN
            some, local = _dense(i)
            pair = np.bincount((local * A.CONTEXTS + (before & (A.CONTEXTS - 1)))[np.repeat(~held, n)], minlength=1)
            u = np.flatnonzero(pair)
            times = pair[u]
            u = some[u // A.CONTEXTS].astype(np.int64) * A.CONTEXTS + u % A.CONTEXTS
            yield _row(_BASE_TYPES, kind=2, part=0, batch=batch, payload=squeeze((u.astype(np.uint64), 3), (times.astype(np.uint64), 5)))

    return run


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and each one's number among them, without a sort."""
    some = np.flatnonzero(np.bincount(ids, minlength=IDS))
    number = np.zeros(IDS, np.int64)
    number[some] = np.arange(len(some))
    return some, number[ids]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique`` with the inverse, but sorting only what is distinct."""
    coded = pa.array(h).dictionary_encode()
    u = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(u)
    number = np.empty(len(u), np.int64)
    number[order] = np.arange(len(u))
    return u[order], number[coded.indices.to_numpy(zero_copy_only=False)]


def range_of_word(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)


_COUNTS = "kind int, part int, batch long, payload binary, tokens long, kinds long, ends long"


def _count_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: every batch's words' counts in its order (kind 1), and the range's totals (2)."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for b in it:
        for r, batch, payload in zip(b["part"].to_pylist(), b["batch"].to_pylist(), b["payload"].to_pylist()):
            held.setdefault(r, []).append((batch, payload))
    types = [("kind", pa.int32()), ("part", pa.int32()), ("batch", pa.int64()), ("payload", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64()), ("ends", pa.int64())]
    for r, blobs in held.items():
        columns = [unsqueeze(p, 2) for _, p in blobs]
        words = [np.cumsum(c[0]) for c in columns]
        u, inverse = np.unique(np.concatenate(words), return_inverse=True)
        c = np.bincount(inverse, np.concatenate([x[1] for x in columns]).astype(np.float64), minlength=len(u)).astype(np.int64)
        at = 0
        for (batch, _), w in zip(blobs, words):
            own = c[inverse[at : at + len(w)]]
            at += len(w)
            yield _row(types, kind=1, part=r, batch=batch, payload=squeeze((own.astype(np.uint64), 5)))
        ends = int(c[0]) if len(u) and u[0] == _END_WORD else 0
        yield _row(types, kind=2, part=r, tokens=int(c.sum()), kinds=int((c > 0).sum()), ends=ends)


def _sum_contexts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, times = np.zeros(0, np.uint64), np.zeros(0)
    for b in it:
        for payload in b["payload"].to_pylist():
            k, n = unsqueeze(payload, 2)
            u, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([times, n.astype(np.float64)]), minlength=len(u))
            keys = u
    yield pa.RecordBatch.from_arrays([pa.array([squeeze((keys, 3), (times.astype(np.uint64), 8))], pa.binary())], ["payload"])


def _training(it: Iterator[pa.RecordBatch], turn: int, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Training documents' ids and borders, a batch at a time; of each task's batches those whose turn it is."""
    for b in it:
        for batch, payload, sizes, held in zip(b["batch"].to_pylist(), b["payload"].to_pylist(), b["sizes"].to_pylist(), b["held"].to_pylist()):
            if (batch & 0xFFFFFFFF) % rounds != turn:
                continue
            n = unsqueeze(sizes, 1)[0].astype(np.int64)
            out = np.unpackbits(np.frombuffer(held, np.uint8))[: len(n)].astype(bool)
            ids = unsqueeze(payload, 1)[0].astype(np.int64)
            keep = np.repeat(~out, n)
            if keep.any():
                yield ids[keep], np.concatenate([[0], np.cumsum(n[~out])])


_PARAMS = "name string, block int, weight double, values binary"
_BLOCK = 1 << 16


def _train(model, turn: int, rounds: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, classes = model.value
        new, seen = A.train_stream(p, _training(it, turn, rounds), classes)
        if not seen:
            return
        names, blocks, values = [], [], []
        for name, x in new.items():
            flat = x.reshape(-1)
            for i in range(0, len(flat), _BLOCK):
                names.append(name)
                blocks.append(i // _BLOCK)
                values.append(flat[i : i + _BLOCK].astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(blocks, pa.int32()), pa.array([float(seen)] * len(names)), pa.array(values, pa.binary())], ["name", "block", "weight", "values"])

    return run


def _average(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], list] = {}
    for b in it:
        for name, block, weight, values in zip(*(b.column(i).to_pylist() for i in range(4))):
            own = total.setdefault((name, block), [0.0, 0.0])
            own[0] += weight
            own[1] = own[1] + weight * np.frombuffer(values, "<f4").astype(np.float64)
    for (name, block), (weight, values) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int32()), pa.array([weight]), pa.array([(values / weight).astype("<f4").tobytes()], pa.binary())], ["name", "block", "weight", "values"])


def _collect_params(averaged: DataFrame, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The averaged parameters, of a fixed size; as they were if no task trained."""
    got: dict[str, dict[int, np.ndarray]] = {}
    for r in averaged.collect():
        got.setdefault(r["name"], {})[r["block"]] = np.frombuffer(r["values"], "<f4")
    return {k: np.concatenate([got[k][i] for i in sorted(got[k])]).reshape(v.shape) if k in got else v for k, v in p.items()}


def _starts(path: str | None) -> np.ndarray:
    from .bpe import encoder

    starts = np.zeros(IDS, bool)
    for token, i in encoder(path).tokenizer.get_vocab().items():
        starts[i] = token.startswith("Ġ")  # the byte-level mark of a space
    starts[END] = True
    return starts


def score_batch(p: dict, classes: A.Classes, starts: np.ndarray, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, n_words: np.ndarray, total: float, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: the words known, base score, score, and the score by attention alone. ``counts``: of each word and end, in order."""
    border = np.concatenate([[0], np.cumsum(sizes)])
    lp, edge = A.log_probs(p, ids, border, classes)
    first = np.flatnonzero(starts[ids])  # one for each word and each end
    word = np.add.reduceat(lp.astype(np.float64), first) if len(first) else np.zeros(0)
    doc_end = ids[first] == END
    word -= edge[first]
    following = np.append(first[1:], 0)
    word += np.where(doc_end, 0.0, edge[following])
    uni = np.where(counts > 0, (counts + 1) / total, 0.0)
    mixed = np.log10(lam * np.exp(np.maximum(word, -290) * np.log(10)) + (1 - lam) * uni)
    mixed = np.where((word < -290) & (uni == 0), word + np.log10(lam), mixed)
    at = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    return np.add.reduceat((counts > 0).astype(np.int64), at), np.add.reduceat(np.log10((counts + 1) / total), at), np.add.reduceat(mixed, at), np.add.reduceat(word, at)


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double"


def _score(model, tokens: int, kinds: int, path: str | None, lam: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, classes, starts = model.value
        answers: dict[int, dict[int, bytes]] = {}
        for b in it:
            for row in b.to_pylist():
                if row["kind"] == 1:
                    answers.setdefault(row["batch"], {})[row["part"]] = row["payload"]
                    continue
                ids = unsqueeze(row["payload"], 1)[0].astype(np.int64)
                n, m = unsqueeze(row["sizes"], 1)[0].astype(np.int64), unsqueeze(row["words"], 1)[0].astype(np.int64)
                got = answers.pop(row["batch"])
                c = np.concatenate([unsqueeze(got[r], 1)[0] for r in sorted(got)]).astype(np.int64)
                h = words_of_ids(id_values(path), ids, n)
                counts = c[distinct(h)[1]]
                known, base, score, alone = score_batch(p, classes, starts, ids, n, counts, m, float(tokens + kinds + 1), lam)
                held = np.unpackbits(np.frombuffer(row["held"], np.uint8))[: len(n)].astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], pa.int64()), pa.array(held), pa.array(m), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(score), pa.array(alone)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "attention_score"],
                )

    return run


def encoder_bytes(path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, and each id's place and length there; the end has none."""
    from .bpe import encoder

    byte_of = _bytes_of()
    raw = [b""] * IDS
    for token, i in encoder(path).tokenizer.get_vocab().items():
        raw[i] = bytes(byte_of[c] for c in token)
    length = np.array([len(x) for x in raw])
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length


_values: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def id_values(path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each id: whether it begins a word, its bytes' share of a word's hash and their number, without a word's space; kept by a worker."""
    if path not in _values:
        starts = _starts(path)
        flat, place, length = encoder_bytes(path)
        skip = (starts & (length > 0)).astype(np.int64)
        _values[path] = starts, S.values(flat, place + skip, length - skip), length - skip
    return _values[path]


def words_of_ids(table: tuple, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The word hashes (ends too) of documents given as ids."""
    starts, value, length = table
    border = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(border, border[lo] + (S.CHUNK_BYTES >> 2), "right")) - 1)
        part = ids[border[lo] : border[hi]]
        first = np.flatnonzero(starts[part])
        h = S.hash_joined(value[part], length[part], first)
        h |= h == 0
        h[part[first] == END] = _END_WORD
        out.append(h)
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def score_documents(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, lam: float = LAMBDA, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score (what attention alone gives)."""
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string"))
    base = save(rows.mapInArrow(roomy(_read(parts, path)), _BASE), "kind")
    asked = base.where("kind = 1").select("part", "batch", "payload").repartitionById(parts, F.col("part"))
    counts = save(asked.mapInArrow(_count_words, _COUNTS), "kind")
    totals = counts.where("kind = 2").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    contexts = np.zeros((IDS, A.CONTEXTS), np.int64)
    some = base.where("kind = 2").select("payload")
    summed = some.repartition(64).mapInArrow(_sum_contexts, "payload binary").repartition(8).mapInArrow(_sum_contexts, "payload binary")
    for r in summed.collect():  # at most ids x contexts numbers
        k, n = unsqueeze(r["payload"], 2)
        contexts.reshape(-1)[k.astype(np.int64)] += n.astype(np.int64)
    starts = _starts(path)
    classes = A.cluster(contexts, starts)
    del contexts
    release_shuffles(spark)
    p = A.begin(IDS) | A.begin_inside(classes)
    batches = base.where("kind = 0").select("batch", "payload", "sizes", "held")
    first = batches.agg(F.min("batch").alias("b")).first()["b"]
    if first is not None:
        steps = [(batches.where(F.col("batch") == first), 0, 1), *[(batches, r, rounds) for r in range(rounds)]]
        for part, turn, of in steps:
            model = spark.sparkContext.broadcast((p, classes))
            trained = part.mapInArrow(roomy(_train(model, turn, of)), _PARAMS).repartition(8, "name", "block").mapInArrow(_average, _PARAMS)
            p = _collect_params(trained, p)
            model.unpersist()
    model = spark.sparkContext.broadcast((p, classes, starts))
    answers = counts.where("kind = 1").select("kind", "part", "batch", F.lit(None).cast("array<long>").alias("doc_id"), "payload", *[F.lit(None).cast("binary").alias(c) for c in ("sizes", "words", "held")])
    full = base.where("kind = 0").select("kind", "part", "batch", "doc_id", "payload", "sizes", "words", "held")
    both = full.union(answers).repartition(2 * parts, "batch").sortWithinPartitions("batch", F.col("kind").desc())
    return both.mapInArrow(roomy(_score(model, totals["n"], totals["v"], path, lam)), _OUT)
