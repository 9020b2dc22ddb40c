"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_BASE, MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The largest primes below 2**53 and 2**52: a byte's digit times a power fits in 64 bits, and so does a sum of LONG of them.
PRIMES = [np.uint64(2**53 - 111), np.uint64(2**52 - 47)]
LONG = 64
POWERS = [np.array([pow(base, k, int(p)) for k in range(LONG)], np.uint64) for base, p in zip((0x1B873593CC9E2D, 0x85EBCA6BC2B2A), PRIMES, strict=True)]
NO_ID = np.iinfo(np.int64).max
#: The bit of a tag that says that the row has no doc_id.
NULL = 1
SCHEMA = "key long, kind int, part binary"
ROWS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("part", pa.binary())])
TO_BUCKET, TO_DOCUMENT, TEXT = 0, 1, 2


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * WINDOW_BASE
    return h ^ (h >> np.uint64(32))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    edge = np.flatnonzero(np.diff(SPACE[data].astype(np.int8), prepend=1, append=1))
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: int = 100_000) -> np.ndarray:
    """(2, words): two independent numbers of each word, its bytes as digits modulo two primes, so many words at a time; a long word's are of its BLAKE2 digest."""
    out = [np.zeros((2, 0), np.uint64)]
    for k in range(0, len(starts), words):
        a, sizes = starts[k : k + words], ends[k : k + words] - starts[k : k + words]
        far = np.flatnonzero(sizes > LONG)
        sizes = np.where(sizes > LONG, 1, sizes)
        firsts = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
        digits = data[np.repeat(a, sizes) + inside].astype(np.uint64) + np.uint64(1)
        found = np.stack([np.add.reduceat(digits * power[inside] % prime, firsts) for power, prime in zip(POWERS, PRIMES, strict=True)])
        for j in far:
            found[:, j] = np.frombuffer(hashlib.blake2b(data[a[j] : ends[k + j]].tobytes(), digest_size=16).digest(), "<u8")
        out.append(found)
    return mixed(np.concatenate(out, axis=1))


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The Rabin-Karp hash of each run of ``window`` words, whose numbers are digits in a fixed base, in 64 bits, and 8 bits of another one over the words' second numbers."""
    n = max(0, words.shape[1] - window + 1)
    h, c = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(window):
        h = h * WINDOW_BASE + words[0, k : k + n]
        c = c * MIX + words[1, k : k + n]
    return mixed(h), (mixed(c) >> np.uint64(56)).astype(np.uint8)


def alike(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an order in which windows with equal hash and check stand together, in their own order; where each such group begins)."""
    order = np.argsort(h, kind="stable")
    if ((np.diff(h[order]) == 0) & (np.diff(c[order]) != 0)).any():
        order = np.lexsort((c, h))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(c[order]) != 0)
    return order, np.flatnonzero(new)


def planes(*columns: np.ndarray) -> bytes:
    """Columns as differences, byte by byte: lowest bytes first, then the next, which are mostly equal."""
    body = b"".join(np.diff(c, prepend=c.dtype.type(0)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(body)


def from_planes(data: bytes, *columns: tuple[str, int]) -> list[np.ndarray]:
    body, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind, n in columns:
        width = np.dtype(kind).itemsize
        flat = np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(kind).ravel()
        out.append(np.cumsum(flat, dtype=kind))
        at += n * width
    return out


def pack_windows(h: np.ndarray, c: np.ndarray, row: np.ndarray, pos: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> bytes:
    """Windows in the order of their documents: the hashes as they are, the rest as runs of a document."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    runs = np.diff(np.append(first, len(row))).astype("<u4")
    return struct.pack("<II", len(h), len(runs)) + h.tobytes() + c.tobytes() + planes(ids[row[first]], tags[row[first]], runs, pos.astype("<u4"))


def unpack_windows(part: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, r = struct.unpack_from("<II", part)
    h, c = np.frombuffer(part, "<u8", n, 8), np.frombuffer(part, np.uint8, n, 8 + 8 * n)
    ids, tags, runs, pos = from_planes(part[8 + 9 * n :], ("<i8", r), ("<i8", r), ("<u4", r), ("<u4", n))
    return h, c, np.repeat(ids, runs), np.repeat(tags, runs), pos


def pack_spans(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> bytes:
    """Positions to remove, sorted by document, as (id, tag, start, length) of runs of neighbours."""
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(ids) != 0) | (tags[1:] != tags[:-1]) | (np.diff(pos.astype(np.int64)) != 1)
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(pos))).astype("<u4")
    return struct.pack("<I", len(first)) + planes(ids[first], tags[first], pos[first].astype("<u4"), runs)


def unpack_spans(part: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", part)
    return from_planes(part[4:], ("<i8", n), ("<i8", n), ("<u4", n), ("<u4", n))


def by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, the places that have it, in order)."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return ((int(keys[p[0]]), p) for p in np.split(order, cuts) if len(p))


def home(ids: np.ndarray, tags: np.ndarray, groups: int) -> np.ndarray:
    """The document group of each (id, tag): rows that share a doc_id, or have none, are dealt out by their texts."""
    return (mixed(ids.view(np.uint64) ^ tags.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def beyond(ids: np.ndarray, tags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which windows are not the smallest doc_id's of their group; ``first`` has where each group begins. A row without an id is above all that have one."""
    sizes = np.diff(np.append(first, len(ids)))
    least = np.repeat(np.minimum.reduceat(ids, first), sizes)
    none = tags & NULL
    least_none = np.repeat(np.minimum.reduceat(np.where(ids == least, none, NULL), first), sizes)
    return (ids > least) | (none > least_none)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, tags, texts) sorted by id, those without one last, of about ``size`` bytes."""
    ids, tags, texts, held = [], [], [], 0

    def flush():
        order = np.lexsort((np.array(tags, np.int64) & NULL, np.array(ids, np.int64)))
        return np.array(ids, np.int64)[order], np.array(tags, np.int64)[order], [texts[k] for k in order]

    for batch in batches:
        for doc_id, tag, text in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
            data = (text.as_py() or "").encode("utf-8", "replace")
            ids.append(NO_ID if doc_id is None else doc_id)
            tags.append(tag)
            texts.append(data)
            held += len(data)
            if held >= size:
                yield flush()
                ids, tags, texts, held = [], [], [], 0
    if ids:
        yield flush()


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    keys, kinds, parts = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.int32()), pa.array(parts, pa.binary())], schema=ROWS)


def removals(docs: DataFrame, window: int, buckets: int, groups: int, chunk: int) -> DataFrame:
    """Spans of windows to remove, for the document groups, as SCHEMA rows of kind TO_DOCUMENT.

    A task hashes the windows of about ``chunk`` bytes of texts at a time. Of a window that several of these documents have,
    all but the smallest doc_id's are removed there and then, and only that one's go on, so a passage that very many share
    costs a hash bucket one window for each chunk. The hash bucket removes all but those of the smallest doc_id.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, texts in chunks(batches, chunk):
            parts, checks, owner, place = [], [], [], []
            for k, text in enumerate(texts):
                data = np.frombuffer(text, np.uint8)
                h, c = window_hashes(word_hashes(data, *word_spans(data)), window) if len(data) else ((), ())
                if len(h):
                    parts.append(h)
                    checks.append(c)
                    owner.append(np.full(len(h), k))
                    place.append(np.arange(len(h)))
            if not parts:
                continue
            h, c, row, pos = map(np.concatenate, (parts, checks, owner, place))
            del parts, checks, owner, place
            order, first = alike(h, c)
            later = beyond(ids[row[order]], tags[row[order]], first)
            found, gone, kept = [], np.sort(order[later]), np.sort(order[~later])
            bucket = (h[kept] % np.uint64(buckets)).astype(np.int64)
            for key, at in by_key(bucket):
                w = kept[at]
                found.append((key, TO_BUCKET, pack_windows(h[w], c[w], row[w], pos[w], ids, tags)))
            for key, at in by_key(home(ids[row[gone]], tags[row[gone]], groups)):
                w = gone[at]
                found.append((key, TO_DOCUMENT, pack_spans(ids[row[w]], tags[row[w]], pos[w])))
            for k in range(0, len(found), 64):
                yield rows(found[k : k + 64])

    def judge(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == TO_DOCUMENT:
            return table
        h, c, ids, tags, pos = map(np.concatenate, zip(*(unpack_windows(x.as_py()) for x in table.column("part")), strict=True))
        order, first = alike(h, c)
        gone = order[beyond(ids[order], tags[order], first)]
        gone = gone[np.lexsort((pos[gone], tags[gone], ids[gone]))]
        found = [(key, TO_DOCUMENT, pack_spans(ids[gone[at]], tags[gone[at]], pos[gone[at]])) for key, at in by_key(home(ids[gone], tags[gone], groups))]
        return pa.Table.from_batches([rows(found)] if found else [], ROWS)

    return docs.mapInArrow(scan, SCHEMA).repartition(2 * buckets, "key").groupBy("kind", "key").applyInArrow(judge, SCHEMA)


def grouped_texts(docs: DataFrame, groups: int, chunk: int) -> DataFrame:
    """The texts, compressed together by document group, as SCHEMA rows of kind TEXT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for ids, tags, texts in chunks(batches, chunk):
            found = []
            for key, at in by_key(home(ids, tags, groups)):
                sizes = np.array([len(texts[k]) for k in at], "<u8")
                body = b"".join(texts[k] for k in at)
                found.append((key, TEXT, struct.pack("<I", len(at)) + ids[at].tobytes() + tags[at].tobytes() + sizes.tobytes() + pack.compress(body)))
            yield rows(found)

    return docs.mapInArrow(run, SCHEMA)


def cleaned(text: bytes, spans: np.ndarray, window: int) -> tuple[int, list[dict], bytes]:
    """(words, maximal intervals [start, end) of words that ``spans`` (starts and lengths of runs of windows) cover, the other words)."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    n = len(starts)
    if not len(spans):
        return n, [], b" ".join(text.split())
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 0] + spans[:, 1] + window - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    cuts = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
    words = text.split()
    return n, [{"start": int(a), "end": int(b)} for a, b in zip(cuts[::2], cuts[1::2], strict=True)], b" ".join(words[k] for k in np.flatnonzero(~gone))


def substring_dedup(docs: DataFrame, window: int = 13, windows_per_bucket: int = 2_000_000, chunk: int = 6_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) of every row of ``docs``.

    Removes each word that a window of ``window`` consecutive words covers whose words also start in a document with a smaller
    doc_id; all windows are judged on the input. Words are runs of anything but ASCII white space, unchanged; ``spans``
    are the maximal intervals of removed words and ``kept_text`` the others, joined by one space. Windows count as equal when their 64-bit
    Rabin-Karp hashes and 8 bits of a second, independent one are: n different windows have some n * n / 2**73 pairs that only seem equal. Buckets and document groups grow in
    number with the text, and the shuffles' partitions with them, not in size: a bucket holds about ``windows_per_bucket`` windows and a group their words.
    A text of any length is read whole, by one task.

    Null and empty texts have no words. A null doc_id is above all others. Rows that share a doc_id are no copies of each
    other; they are told apart by 63 bits of a hash of their texts. Columns of other names play no part. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").bitwiseAND(F.lit(~NULL)).bitwiseOR(F.col("doc_id").isNull().cast("long")).alias("tag"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = 1 + size // (6 * windows_per_bucket)

    def finish(table: pa.Table) -> pa.Table:
        spans: dict[tuple, list] = {}
        out = []
        for kind, part in zip(table.column("kind").to_pylist(), table.column("part"), strict=True):
            if kind == TO_DOCUMENT:
                ids, tags, starts, sizes = unpack_spans(part.as_py())
                cuts = np.flatnonzero((np.diff(ids) != 0) | (tags[1:] != tags[:-1])) + 1
                both = np.stack([starts, sizes], axis=1).astype(np.int64)
                for at in np.split(np.arange(len(ids)), cuts):
                    spans.setdefault((int(ids[at[0]]), int(tags[at[0]])), []).append(both[at])
        for kind, part in zip(table.column("kind").to_pylist(), table.column("part"), strict=True):
            if kind == TEXT:
                data = part.as_py()
                (n,) = struct.unpack_from("<I", data)
                ids, tags, sizes = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<i8", n, 4 + 8 * n), np.frombuffer(data, "<u8", n, 4 + 16 * n)
                body, at = zstandard.ZstdDecompressor().decompress(data[4 + 24 * n :]), 0
                for doc_id, tag, length in zip(ids.tolist(), tags.tolist(), sizes.tolist(), strict=True):
                    own = spans.get((doc_id, tag))
                    n_words, where, kept = cleaned(body[at : at + length], np.concatenate(own) if own else (), window)
                    out.append((None if tag & NULL else doc_id, n_words, sum(s["end"] - s["start"] for s in where), where, kept.decode("utf-8", "replace")))
                    at += length
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "spans", "kept_text"]
        columns = zip(*out, strict=True) if out else [()] * 5
        return pa.table({name: pa.array(list(c), k) for name, c, k in zip(names, columns, kinds, strict=True)})

    found = removals(docs, window, groups, groups, chunk).unionByName(grouped_texts(docs, groups, chunk))
    return found.repartition(2 * groups, "key").groupBy("key").applyInArrow(finish, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")
