"""Token ids in binary shards with a minimal perfect hash index.

A shard is two files. ``*.ids`` holds raw little-endian ids, documents end to end in
ascending key order, two bytes each when the vocabulary allows it and four otherwise.
``*.idx`` holds the keys in that order and the index: a key's hash leads through bit
arrays of falling size (a key settles at the first level where it meets no other) to
one of ``n`` slots without gaps, and the slot holds a fingerprint, an offset and a
length. A lookup reads one slot; a fingerprint that differs means "not in this shard".

Spark range-partitions the documents by key, each task writes one shard under a name of
its own attempt and renames it when it is complete, so a lost or doubled task leaves
nothing half written; the manifest (one row per shard) is an ordinary table.

Words repeat, so a worker encodes a piece of text between two blanks once and keeps its
ids (at most ``REMEMBERED`` pieces). A blank splits only between two characters that are not white
space, where a byte-level tokenizer's own rule splits too.

Defined cases: a NULL text is empty and gets the end id alone; a NULL key sorts first;
rows that share a key follow each other in the order of their text's hash and are told
apart by a running number; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gitstrata.llm.store import written
from gitstrata.llm.words import Texts, mix, slices
from gitstrata.session import shared_folder

SHARD_BYTES = 8 << 20
REMEMBERED = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*range(9, 14), *range(28, 33)]] = True
    return out


_SPACE = _spaces()


def pieces(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of the pieces of each text.

    Cuts are before a blank, and before and behind a line feed, that stands between two
    characters that are not white space. A text with white space beyond ASCII stays one piece.
    """
    d, n = t.data, len(t.data)
    cut = (d == 32) | (d == 10)
    if n:
        wide = _SPACE[d]
        cut[1:] &= ~wide[:-1]
        cut[:-1] &= ~wide[1:]
        edges = np.concatenate([t.bounds[:-1], t.bounds[1:] - 1])
        cut[edges[(edges >= 0) & (edges < n)]] = False
        cut[1:] |= cut[:-1] & (d[:-1] == 10)
    for lead in np.flatnonzero((d == 0xC2) | (d == 0xE1) | (d == 0xE2) | (d == 0xE3)) if n else ():
        if d[lead : lead + 3].tobytes().decode("utf-8", "ignore")[:1].isspace():
            doc = np.searchsorted(t.bounds, lead, "right") - 1
            cut[t.bounds[doc] : t.bounds[doc + 1]] = False
    full = t.bounds[:-1][np.diff(t.bounds) > 0]
    start = np.sort(np.concatenate([np.flatnonzero(cut), full]))
    end = np.append(start[1:], n)
    return start, end, np.searchsorted(t.bounds, start, "right") - 1


class Encoder:
    """Encodes texts to ids, remembering the pieces between blanks."""

    _known: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.end = end
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 16, f"<u{self.width}"), 0
        self.offset, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    @classmethod
    def of(cls, path: str, end: int) -> Encoder:
        """One per worker process."""
        if (path, end) not in cls._known:
            cls._known[path, end] = cls(path, end)
        return cls._known[path, end]

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.ids.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, prints: np.ndarray, texts: list[str]) -> None:
        """Encodes new pieces: many in one call with a line feed between them where they hold no white space of their own."""
        odd = (self.line is None or len(x.split()) != 1 or x[-1].isspace() or len(x.strip()) < len(x) - 1 for x in texts)
        alone = [i for i, x in enumerate(odd) if x]
        plain = np.ones(len(texts), bool)
        plain[alone] = False
        joined = [texts[i] for i in np.flatnonzero(plain).tolist()]
        flat, lengths = [], []
        for ids in self._encoded(["\n".join(joined[i : i + 1024]) for i in range(0, len(joined), 1024)]):
            line = ids == self.line
            flat.append(ids[~line])
            lengths.append(np.bincount(np.cumsum(line)[~line], minlength=int(line.sum()) + 1))
        for ids in self._encoded([texts[i] for i in alone]):
            flat.append(ids)
            lengths.append(np.array([len(ids)]))
        prints = np.concatenate([prints[plain], prints[~plain]])
        new, lengths = np.concatenate(flat), np.concatenate(lengths)
        base = len(self.row)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while base + len(prints) > len(self.length):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.ids[self.used : self.used + len(new)] = new
        self.offset[base : base + len(prints)] = self.used + np.cumsum(lengths) - lengths
        self.length[base : base + len(prints)] = lengths
        self.used += len(new)
        self.row.update(zip(prints.tolist(), range(base, base + len(prints)), strict=True))

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, each closed by the end id, and ids per text."""
        start, end, doc = pieces(t)
        unique, at, back = np.unique(t.prints(start, end), return_index=True, return_inverse=True)
        if len(self.row) + len(unique) > REMEMBERED:
            self.forget()
        prints = unique.tolist()
        fresh = [i for i, p in enumerate(prints) if p not in self.row]
        if fresh:
            raw = t.data.tobytes()
            self._learn(unique[fresh], [raw[a:b].decode() for a, b in zip(start[at[fresh]].tolist(), end[at[fresh]].tolist(), strict=True)])
        row = np.fromiter(map(self.row.__getitem__, prints), np.int64, len(prints))[back]
        n = self.length[row]
        before = np.cumsum(n) - n
        every = np.arange(n.sum())
        out = np.full(len(every) + len(t), self.end, self.ids.dtype)
        out[every + np.repeat(doc, n)] = self.ids[every + np.repeat(self.offset[row] - before, n)]
        return out, np.bincount(doc, weights=n, minlength=len(t)).astype(np.int64) + 1


def key_hash(key: np.ndarray, missing: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Hash of a key and its running number among equal keys."""
    salt = mix(nth.astype(np.uint64) * np.uint64(2) + missing.astype(np.uint64) + np.uint64(1))
    return mix(np.where(missing, 0, key).astype(np.int64).view(np.uint64) * _ODD ^ salt)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit hashes: levels of bits, ranks for the slots."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)])
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, arrays, level = [], [], 0
        while len(keys):
            if level == 60:
                raise ValueError("two keys have one hash")
            size = 2 * len(keys) + 1
            at = cls._place(keys, level, size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            arrays.append(once)
            keys = keys[~once[at]]
            level += 1
        return cls(np.array(sizes, np.int64), np.concatenate(arrays) if arrays else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level holds it (keys never put in may get any slot)."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.start[level] + self._place(keys[left], level, size)
            here = self.bits[at]
            out[left[here]] = self.rank[at[here]]
            left = left[~here]
        return out


class Shard:
    """One shard, read whole: keys in order and keyed access to ids."""

    def __init__(self, ids: bytes, index: bytes) -> None:
        x = np.load(io.BytesIO(index), allow_pickle=False)
        self.ids = np.frombuffer(ids, f"<u{int(x['width'])}")
        self.key, self.missing, self.nth = x["key"], x["missing"], x["nth"]
        self.hash = PerfectHash(x["sizes"], np.unpackbits(x["bits"])[: int(x["sizes"].sum())].astype(bool))
        self.fingerprint, self.offset, self.length = x["fingerprint"], x["offset"], x["length"]

    def find(self, key: np.ndarray, missing: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length in ids of each key; length -1 where the fingerprint says it is not here."""
        h = key_hash(key, missing, nth)
        slot = self.hash.slots(h)
        there = slot >= 0
        there[there] = self.fingerprint[slot[there]] == h[there].astype(np.uint32)
        return np.where(there, self.offset[slot], 0), np.where(there, self.length[slot], -1)


def pack(key: np.ndarray, missing: np.ndarray, length: np.ndarray, width: int) -> bytes:
    """The index of a shard whose documents come in this order."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (missing[1:] != missing[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    nth = np.arange(len(key)) - first
    h = key_hash(key, missing, nth)
    table = PerfectHash.build(h)
    slot = table.slots(h)
    by_slot = np.argsort(slot)
    out = io.BytesIO()
    np.savez(
        out, width=width, key=key, missing=missing, nth=nth, sizes=table.sizes, bits=np.packbits(table.bits),
        fingerprint=h.astype(np.uint32)[by_slot], offset=(np.cumsum(length) - length)[by_slot], length=length[by_slot],
    )
    return out.getvalue()


def _open(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (arrow_fs.LocalFileSystem(), folder)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes ``docs(key, text)`` and returns the manifest ``(shard, n_docs, n_tokens, first_key, last_key)``."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    ordered = docs.select(F.col("key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(n, F.asc_nulls_first("key")).sortWithinPartitions(F.asc_nulls_first("key"), F.md5("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, end)
        store, root = _open(folder)
        store.create_dir(root)
        name = f"{root}/shard-{TaskContext.get().partitionId():06d}"
        own = f"{name}.{uuid.uuid4().hex}"
        keys, missing, lengths = [], [], []
        with store.open_output_stream(f"{own}.ids") as out:
            for batch in batches:
                for t in slices(batch.column(1)):
                    ids, n = encoder.encode(t)
                    out.write(ids.tobytes())
                    lengths.append(n)
                keys.append(np.asarray(pc.fill_null(batch.column(0), 0)))
                missing.append(np.asarray(pc.is_null(batch.column(0))))
        if not keys:
            store.delete_file(f"{own}.ids")
            return
        key, missing, length = (np.concatenate(x) for x in (keys, missing, lengths))
        with store.open_output_stream(f"{own}.idx") as out:
            out.write(pack(key, missing, length, encoder.width))
        for kind in ("ids", "idx"):
            store.move(f"{own}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict(
            {"shard": [TaskContext.get().partitionId()], "n_docs": [len(key)], "n_tokens": [int(length.sum())],
             "first_key": [None if missing[0] else int(key[0])], "last_key": [None if missing[-1] else int(key[-1])]},
            pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]),
        )

    return written(ordered.mapInArrow(run, "shard int, n_docs long, n_tokens long, first_key long, last_key long"), "manifest")


def _load(folder: str, shard: int) -> Shard:
    store, root = _open(folder)
    parts = []
    for kind in ("ids", "idx"):
        with store.open_input_stream(f"{root}/shard-{shard:06d}.{kind}") as f:
            parts.append(f.read())
    return Shard(*parts)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document, each found through its shard's index.

    The running start is a prefix sum over the manifest, one row per shard.
    """
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("shard", F.coalesce(before, F.lit(0)).alias("start"))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = _load(folder, shard)
                offset, length = s.find(s.key, s.missing, s.nth)
                crc = [zlib.crc32(s.ids[a : a + b].astype("<u4").tobytes()) for a, b in zip(offset.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.key, mask=s.missing), pa.array(start + offset), pa.array(length), pa.array(crc, pa.int64())],
                    ["key", "start", "n_tokens", "ids_crc32"],
                )

    return shards.repartition(n, "shard").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def lookup(keys: DataFrame, manifest: DataFrame, folder: str) -> DataFrame:
    """``(key, ids)`` for those of ``keys(key)`` that are stored, by one index slot each.

    A key's shard follows from the manifest's key ranges. Of rows stored under one key the
    first is returned.
    """
    spans = manifest.filter(F.col("last_key").isNotNull()).select("shard", F.coalesce("first_key", F.lit(-(2**63))).alias("lo"), F.col("last_key").alias("hi"))
    placed = keys.select("key").join(spans, F.col("key").between(F.col("lo"), F.col("hi"))).select("key", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s = None, None
        for batch in batches:
            key, shard = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for one in np.unique(shard).tolist():
                if one != at:
                    at, s = one, _load(folder, one)
                mine = key[shard == one]
                offset, length = s.find(mine, np.zeros(len(mine), bool), np.zeros(len(mine), np.int64))
                ok = length >= 0
                ids = [s.ids[a : a + b].astype(np.int32) for a, b in zip(offset[ok].tolist(), length[ok].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(mine[ok]), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "key long, ids array<int>")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for shards that all executors share."""
    return shared_folder(spark, "token-shards")
