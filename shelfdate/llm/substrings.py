"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt to parts by ranges of their id, so that a lower part holds lower ids only. Each part sends its
distinct window hashes, split by hash into as many buckets as there are parts; a bucket counts them over all parts and
answers, per part, with one bit per hash: does the window also start in a lower part? With these bits and the order
inside the part, every window that has an occurrence in a document with a smaller id is known; the words that such
windows cover merge into maximal removal intervals.

A window is known by 64 bits within its bucket plus the bucket itself, which an independent hash chooses. A window that
occurs in a third of all documents is sent once per part, so no bucket gets more than one entry per part and window.

Defined cases: null and empty texts have no words; texts shorter than a window keep all words; rows with equal ids do
not count against each other, rows without id are kept whole and count against none; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, partitions, settle, table
from .windows import BASES, rolling, word_hash


def by_id_ranges(docs: DataFrame, parts: int):
    """A column function: the part of an id, from approximate quantiles of all ids; null ids spread over the parts."""
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(cuts or [], np.int64))[:max(0, parts - 1)]

    @F.pandas_udf("int")
    def part(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.arange(len(ids)) % parts
        out[known] = np.searchsorted(cuts, ids[known].to_numpy(np.int64), side="right")
        return pd.Series(out.astype(np.int32))

    return part


class PartWindows:
    """All windows of a part: per window its row, place, bucket and hash, rows in order of id."""

    def __init__(self, rows: pa.Table, width: int, buckets: int):
        ids = rows.column("id").to_numpy()
        known = np.flatnonzero(~np.isnan(ids)) if ids.dtype.kind == "f" else np.arange(len(ids))
        exact = rows.column("id").to_pylist()
        self.order = sorted(known.tolist(), key=lambda i: exact[i])
        texts = rows.column("text")
        self.length = np.zeros(len(ids), np.int64)
        hashes, buckets_of, ranks, self.first = [], [], [], {}
        at, rank, last = 0, -1, None
        for i in self.order:
            words = word_hash.of(split(texts[i].as_py()))
            rank, last = (rank, last) if exact[i] == last else (rank + 1, exact[i])
            h = rolling(words, width, BASES[0])
            hashes.append(h)
            buckets_of.append((rolling(words, width, BASES[1]) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32))
            ranks.append(np.full(len(h), rank, np.int32))
            self.first[i] = (at, at + len(h))
            at += len(h)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        bucket = np.concatenate(buckets_of) if hashes else np.zeros(0, np.uint16)
        self.rank = np.concatenate(ranks) if hashes else np.zeros(0, np.int32)
        self.by_bucket = np.argsort(bucket, kind="stable")
        self.begin = np.searchsorted(bucket[self.by_bucket], np.arange(buckets + 1))

    def of_bucket(self, bucket: int) -> np.ndarray:
        return self.by_bucket[self.begin[bucket]:self.begin[bucket + 1]]


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def find_repeats(docs: DataFrame, *, width: int = 13, carry: tuple[str, ...] = ("doc_id",), parts: int | None = None,
                 verbatim: bool = False) -> DataFrame:
    """(row, n_words, n_removed, spans, kept_text): per document the words that go, as maximal intervals of word
    places (first and last included), and the words that stay, joined by one space. carry: the columns in `row`. verbatim: a text that loses nothing stays as it is."""
    parts = parts or partitions(docs.sparkSession)
    part = by_id_ranges(docs, parts)
    dealt = docs.select(part(F.col("doc_id").cast("long")).alias("part"), F.col("doc_id").cast("long").alias("id"), "text",
                        packed(docs.select(*carry)).alias("row"))

    def send(rows: pa.Table) -> pa.Table:
        settle("windows")
        own = PartWindows(rows, width, parts)
        number, keys = rows.column("part")[0].as_py(), []
        for b in range(parts):
            keys.append(np.unique(own.hash[own.of_bucket(b)]))
        full = [b for b in range(parts) if len(keys[b])]
        # byte by byte: the leading bytes of sorted hashes compress well that way
        return pa.table({"bucket": pa.array(full, pa.int32()), "part": pa.array([number] * len(full), pa.int32()),
                         "keys": pa.array([keys[b].astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes() for b in full], pa.binary())})

    # grouped as it will be again below, so that the texts are dealt out once
    sent = dealt.groupBy("part").applyInArrow(send, "bucket int, part int, keys binary")

    def count(rows: pa.Table) -> pa.Table:
        settle()
        order = np.argsort(rows.column("part").to_numpy())
        blobs = [np.frombuffer(rows.column("keys")[int(i)].as_buffer(), np.uint8) for i in order]
        keys = [np.ascontiguousarray(x.reshape(8, -1).T).view(">u8").ravel().astype(np.uint64) for x in blobs]
        every = np.concatenate(keys)
        ranked = np.argsort(every, kind="stable")
        repeat = np.zeros(len(every), bool)
        same = every[ranked[1:]] == every[ranked[:-1]]
        repeat[ranked[1:][same]] = True
        ends = np.cumsum([len(k) for k in keys])
        bits = [np.packbits(x).tobytes() for x in np.split(repeat, ends[:-1])]
        return pa.table({"part": rows.column("part").take(pa.array(order)), "bucket": rows.column("bucket").take(pa.array(order)),
                         "bits": pa.array(bits, pa.binary())})

    told = sent.groupBy("bucket").applyInArrow(count, "part int, bucket int, bits binary")
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    spec = (dealt.select("row").schema.add("n_words", T.LongType()).add("n_removed", T.LongType())
            .add("spans", T.ArrayType(span)).add("kept_text", T.StringType()))

    def remove(rows: pa.Table, bits: pa.Table) -> pa.Table:
        settle("windows")
        own = PartWindows(rows, width, parts)
        gone = np.zeros(len(own.hash), bool)
        for b, told_bits in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            at = own.of_bucket(b)
            keys, first, back = np.unique(own.hash[at], return_index=True, return_inverse=True)
            lower = np.unpackbits(np.frombuffer(told_bits, np.uint8), count=len(keys)).astype(bool)
            gone[at] = lower[back] | (own.rank[at] > own.rank[at[first]][back])
        n_words, n_removed, spans, kept = [], [], [], []
        for i, text in enumerate(rows.column("text")):
            words = split(text.as_py())
            lo, hi = own.first.get(i, (0, 0))
            starts = np.flatnonzero(gone[lo:hi])
            n_words.append(len(words))
            if not len(starts):
                n_removed.append(0)
                spans.append([])
                kept.append(text.as_py() if verbatim else b" ".join(words).decode())
                continue
            breaks = np.flatnonzero(np.diff(starts) > width)
            first, last = starts[np.concatenate(([0], breaks + 1))], starts[np.concatenate((breaks, [len(starts) - 1]))] + width - 1
            n_removed.append(int((last - first + 1).sum()))
            spans.append([{"first": int(a), "last": int(z)} for a, z in zip(first, last, strict=True)])
            edges = [0, *[x for a, z in zip(first.tolist(), last.tolist(), strict=True) for x in (a, z + 1)], len(words)]
            kept.append(b" ".join([w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z]]).decode())
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table({"row": rows.column("row"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "spans": pa.array(spans, kind), "kept_text": pa.array(kept, pa.string())})

    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(remove, spec)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents without their repeated windows, with the columns they came with; a text that loses nothing stays
    as it is, and n_chars, where there is such a column, follows the new text."""
    rest = tuple(c for c in docs.columns if c != "text")
    found = find_repeats(docs, carry=rest, verbatim=True, **options)
    length = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("row.n_chars")) if "n_chars" in rest else None
    columns = [F.col("kept_text") if c == "text" else length.cast(t) if c == "n_chars" else F.col(f"row.`{c}`") for c, t in docs.dtypes]
    return found.select(*[column.alias(c) for column, c in zip(columns, docs.columns, strict=True)])


def op2_window_repeats(spark, folder):
    found = find_repeats(table(spark, folder, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
