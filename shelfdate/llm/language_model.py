"""LM scoring: log-frequency Bloom filters of quantised n-gram counts, in shards by hash of the n-gram.

Words: every part of the corpus (some `CHUNK` tokens of whole documents) sends its distinct words, by hash, with their
training counts; buckets of hashes add the counts up over all parts and answer each part for its own words. So every
part knows the exact count of each of its words, whatever the size of the vocabulary, and no word is sent more than
once per part.

Pairs of words go the same way: a part sends its distinct pairs with their training counts, a bucket adds them up and
keeps every pair seen `LEAST` times or more, at any corpus size. Their counts go into the bucket's filter on a
logarithmic scale: a pair with level q is inserted as q items (pair, 1) ... (pair, q), and read back by probing levels
until one is absent. The bucket answers each part for all its pairs. The sum of the kept counts of each first word is
stored the same way, in the buckets of words. A filter has `ITEM_BITS` bits per item: all filters together grow with the
corpus, each by itself stays as large as its bucket, and none is broadcast.

Probability of word w after h, with c the exact counts, c' the count read from the filter (lower end of its level), and
s(h) the sum read for h (upper end): 0.9 c'(h,w) / c(h) + (1 - 0.9 s(h) / c(h)) P(w); P is the word probability with an
absolute discount, whose mass goes to the unknown word. The first word follows the end token. Probabilities add up to
at most 1, but for the filter's false positives.

Defined cases: a null text is empty (one end token); rows are scored one by one, also repeated ones and those without id
(whose id counts as the empty text when training rows are chosen); without training rows all probabilities are 1; an
empty table gives an empty result. A document is never split over parts, so a part grows with its longest document.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, partitions, remainder, table
from .windows import finish

CHUNK = 2_000_000
#: A pair seen so often in training is kept.
LEAST = 2
#: Filter: bits per item, items' probes, growth from one level to the next.
ITEM_BITS, PROBES, GROWTH = 16, 6, 1.5
#: Sums of kept counts are whole numbers of 1 / UNIT.
UNIT = 1024
KEPT_SHARE = 0.9
#: Odd multipliers (fixed values).
FIRST, SECOND, PROBE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
LEVEL = 0x165667B19E3779F9
#: A pair is known by five bytes within its bucket; the others choose the bucket.
PAIR_BYTES = 5
PAIR_BITS, PAIR_MASK = np.uint64(8 * PAIR_BYTES), np.uint64((1 << 8 * PAIR_BYTES) - 1)
END = b""

CODED = ("part long, kind string, bucket int, ids array<long>, held array<boolean>, lengths array<long>, codes binary, "
         "keys binary, counts binary")
ARROW = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())),
                   ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary()), ("keys", pa.binary()),
                   ("counts", pa.binary())])


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, compressed."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), "zstd", asbytes=True) if len(x) else b""


def _expand(data: bytes, kind: str, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)


def coded(docs: DataFrame, held, buckets: int) -> DataFrame:
    """Per part one row of kind "text": ids, training marks, lengths and word numbers of its documents; number, hashes and
    training counts of its distinct words, in the order of their numbers, which is by bucket."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), held.alias("held"), F.col("text").alias("text"))

    def encode(batches):
        from xxhash import xxh3_64_intdigest

        numbers, chunk = None, 0

        def close():
            words = list(numbers)
            hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
            bucket = _word_bucket(hashes, buckets)
            order = np.lexsort((hashes, bucket))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            codes = place[np.concatenate(parts)]
            trained = np.repeat(~np.array(marks, bool), lengths)
            counts = np.bincount(codes[trained], minlength=len(words)).astype(np.uint32)
            part = TaskContext.get().partitionId() << 20 | chunk
            yield _rows(part=[part], kind=["text"], bucket=[len(words)], ids=[ids], held=[marks], lengths=[lengths], codes=[_squeeze(codes)],
                        keys=[_squeeze(hashes[order])], counts=[_squeeze(counts)])

        for batch in batches:
            for i in range(batch.num_rows):
                if numbers is None:
                    numbers = defaultdict(count().__next__)
                    parts, ids, marks, lengths, size = [], [], [], [], 0
                text = batch.column(2)[i].as_py()
                words = text.encode("utf-8", "replace").lower().split() if text else []
                words.append(END)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                ids.append(batch.column(0)[i].as_py())
                marks.append(batch.column(1)[i].as_py())
                lengths.append(len(words))
                size += len(words)
                if size >= CHUNK:
                    yield from close()
                    numbers, chunk = None, chunk + 1
        if numbers is not None:
            yield from close()

    return rows.mapInArrow(encode, CODED)


def _cells(bucket: np.ndarray, buckets: int):
    """(bucket, first place, end) of each bucket that occurs; bucket is in order."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]


def _word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (finish(keys) % np.uint64(buckets)).astype(np.int32)


def words(texts: DataFrame, buckets: int) -> DataFrame:
    """Per part a row of kind "words" per bucket: hashes and training counts of its distinct words."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _expand(row["keys"], "<u8", row["bucket"]), _expand(row["counts"], "<u4", row["bucket"])
                cells = _cells(_word_bucket(keys, buckets), buckets)
                yield _rows(part=[row["part"]] * len(cells), kind=["words"] * len(cells), bucket=[b for b, _, _ in cells],
                            lengths=[[int(hi - lo)] for _, lo, hi in cells], keys=[_squeeze(keys[lo:hi]) for _, lo, hi in cells],
                            counts=[_squeeze(counts[lo:hi]) for _, lo, hi in cells])

    return texts.select("part", "bucket", "keys", "counts").mapInArrow(send, CODED)


def totals(rows: DataFrame, least: int) -> DataFrame:
    """Of rows of kind "words" and "heads": rows of kind "totals", per part and bucket the counts over all parts and the levels
    of the sums of kept pairs; and per bucket one row of kind "sums" with the tokens, the words, and the words seen once and
    twice."""
    def add(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        own, heads = ([r for r in rows if r["kind"] == kind] for kind in ("words", "heads"))
        if not own:  # a pair's first word is in some part
            raise ValueError("sums of words that no part has")
        sizes = [r["lengths"][0] for r in own]
        distinct, back = np.unique(np.concatenate([_expand(r["keys"], "<u8", n) for r, n in zip(own, sizes, strict=True)]), return_inverse=True)
        total, kept = np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
        np.add.at(total, back, np.concatenate([_expand(r["counts"], "<u4", n) for r, n in zip(own, sizes, strict=True)]).astype(np.uint64))
        for r in heads:
            at = np.searchsorted(distinct, _expand(r["keys"], "<u8", r["lengths"][0]))
            kept[at] += _expand(r["counts"], "<u8", r["lengths"][0])
        lookup = LogFrequencyFilter.of(distinct, kept / UNIT, least)
        level = np.where(total >= least, lookup.read(distinct), 0).astype(np.uint8)
        ends = np.cumsum(sizes)[:-1]
        sums = [int(total.sum()), int((total > 0).sum()), int((total == 1).sum()), int((total == 2).sum())]
        n, bucket = len(sizes), own[0]["bucket"]
        out = _rows(part=[*[r["part"] for r in own], -1], kind=["totals"] * n + ["sums"], bucket=[bucket] * (n + 1),
                    lengths=[*[[x] for x in sizes], sums], codes=[*map(_squeeze, np.split(level[back], ends)), None],
                    counts=[*map(_squeeze, np.split(total[back], ends)), None])
        return pa.Table.from_batches([out])

    return rows.groupBy("bucket").applyInArrow(add, CODED)


class Part:
    """A row of kind "text", unpacked: per token its word's number and the number of the word before it."""

    def __init__(self, row: dict):
        self.lengths = np.array(row["lengths"], np.int64)
        self.codes = _expand(row["codes"], "<u4", int(self.lengths.sum()))
        self.keys = _expand(row["keys"], "<u8", row["bucket"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.empty_like(self.codes)
        self.before[1:] = self.codes[:-1]
        self.before[self.starts] = self.codes[self.starts[0] + self.lengths[0] - 1]
        self.held = np.repeat(np.array(row["held"], bool), self.lengths)

    def pairs(self, buckets: int):
        """(first, second, key, bucket, which): the distinct pairs in order of their bucket, then of their first word; and
        the place among them of each token's."""
        both, which = np.unique(self.before.astype(np.uint64) << np.uint64(32) | self.codes, return_inverse=True)
        first, second = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key = finish(self.keys[first] * FIRST + self.keys[second] * SECOND)
        bucket = ((key >> PAIR_BITS) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return first[order], second[order], (key & PAIR_MASK)[order], bucket[order], place[which]


def pairs(texts: DataFrame, buckets: int) -> DataFrame:
    """Per part a row of kind "pairs" per bucket: keys, first words' hashes and training counts of its distinct pairs."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Part(row)
                first, _, key, bucket, which = own.pairs(buckets)
                n = np.bincount(which[~own.held], minlength=len(key)).astype(np.uint32)
                for b, lo, hi in _cells(bucket, buckets):
                    heads, run = np.unique(first[lo:hi], return_counts=True)
                    yield _rows(part=[row["part"]], kind=["pairs"], bucket=[b], lengths=[[int(hi - lo), len(heads)]], ids=[own.keys[heads].view(np.int64)],
                                codes=[_squeeze(run.astype(np.uint32))], keys=[key[lo:hi].view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES].T.tobytes()],
                                counts=[_squeeze(n[lo:hi])])

    return texts.select("part", "bucket", "held", "lengths", "codes", "keys").mapInArrow(send, CODED)


def judged_pairs(rows: DataFrame, least: int, buckets: int) -> DataFrame:
    """Rows of kind "levels": per part and bucket the levels of its pairs, as the bucket's filter of all training pairs with at
    least `least` occurrences tells them; and of kind "heads": per bucket of words the sums of the kept counts by first word."""
    def add(rows: pa.Table) -> pa.Table:
        keys, heads, n, rows = [], [], [], rows.to_pylist()
        for r in rows:
            size, firsts = r["lengths"]
            key = np.zeros((size, 8), np.uint8)
            key[:, :PAIR_BYTES] = np.frombuffer(r["keys"], np.uint8).reshape(PAIR_BYTES, size).T
            keys.append(key.view("<u8").ravel())
            heads.append(np.repeat(np.array(r["ids"], np.int64), _expand(r["codes"], "<u4", firsts)))
            n.append(_expand(r["counts"], "<u4", size))
        sizes = [len(k) for k in keys]
        distinct, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, np.concatenate(n).astype(np.int64))
        lookup = LogFrequencyFilter.of(distinct, total, least)
        answers = np.split(lookup.read(distinct).astype(np.uint8)[back], np.cumsum(sizes)[:-1])
        often = total >= least
        head, back = np.unique(np.concatenate(heads)[first[often]].view(np.uint64), return_inverse=True)
        kept = np.zeros(len(head), np.uint64)
        np.add.at(kept, back, np.ceil(lookup.value(lookup.levels(total[often])) * UNIT).astype(np.uint64))
        bucket = _word_bucket(head, buckets)
        order = np.argsort(bucket, kind="stable")
        head, kept, cells = head[order], kept[order], _cells(bucket[order], buckets)
        out = _rows(part=[*[r["part"] for r in rows], *[-1] * len(cells)], kind=["levels"] * len(rows) + ["heads"] * len(cells),
                    bucket=[*[r["bucket"] for r in rows], *[b for b, _, _ in cells]], lengths=[*[[x] for x in sizes], *[[int(hi - lo)] for _, lo, hi in cells]],
                    codes=[*map(_squeeze, answers), *[None] * len(cells)], keys=[*[None] * len(rows), *[_squeeze(head[lo:hi]) for _, lo, hi in cells]],
                    counts=[*[None] * len(rows), *[_squeeze(kept[lo:hi]) for _, lo, hi in cells]])
        return pa.Table.from_batches([out])

    return rows.groupBy("bucket").applyInArrow(add, CODED)


class LogFrequencyFilter:
    """Counts of at least `least`, by level: level q means least * GROWTH**(q-1) or more."""

    def __init__(self, least: int, bits: int):
        self.least, self.bits = least, np.zeros(bits >> 3, np.uint8)

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, least: int) -> LogFrequencyFilter:
        """Holds all keys with counts of at least `least`, in a size by the number of its items."""
        levels = cls(least, 8).levels(n)
        made = cls(least, max(1 << 10, -(-int(levels.sum()) * ITEM_BITS // 8) * 8))
        made.insert(keys[levels > 0], levels[levels > 0])
        return made

    def _places(self, keys: np.ndarray, level: int):
        x = finish(keys + np.uint64(level * LEVEL % (1 << 64)))
        y = finish(x * PROBE) | np.uint64(1)
        size = np.uint64(len(self.bits) * 8)
        for i in range(PROBES):
            yield (x + np.uint64(i) * y) % size

    def levels(self, n: np.ndarray) -> np.ndarray:
        return np.where(n >= self.least, 1 + np.floor(np.log(np.maximum(n, self.least) / self.least) / np.log(GROWTH) + 1e-9), 0).astype(np.int64)

    def value(self, level: np.ndarray) -> np.ndarray:
        """Lower end of a level; of the level above it is the upper end."""
        return np.where(level > 0, self.least * GROWTH ** (level - 1.0), 0.0)

    def insert(self, keys: np.ndarray, levels: np.ndarray) -> None:
        for level in range(1, int(levels.max(initial=0)) + 1):
            for p in self._places(keys[levels >= level], level):
                np.bitwise_or.at(self.bits, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: the last one before the first that is absent."""
        found, left, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        while len(left):
            level += 1
            there = np.ones(len(left), bool)
            for p in self._places(keys[left], level):
                there &= (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left = left[there]
            found[left] = level
        return found


def score(docs: DataFrame, held, *, keep_pairs: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; documents for which
    `held` is true are not learned from. keep_pairs: keep only pairs with at least N / keep_pairs of the N tokens' places
    (default: all that were seen `LEAST` times)."""
    buckets = partitions(docs.sparkSession)
    texts = keep(coded(docs, held, buckets))
    least = LEAST
    if keep_pairs is not None:
        trained = F.expr("aggregate(zip_with(lengths, held, (n, h) -> IF(h, 0L, n)), 0L, (a, n) -> a + n)")
        least = max(LEAST, -(-(texts.agg(F.sum(trained)).first()[0] or 0) // keep_pairs))
    levels = keep(judged_pairs(pairs(texts, buckets), least, buckets))
    told = keep(totals(words(texts, buckets).unionByName(levels.where("kind = 'heads'")), least))
    sums = told.where("kind = 'sums'").agg(*[F.coalesce(F.sum(F.get("lengths", F.lit(i))), F.lit(0)).alias(n) for i, n in enumerate("nvab")]).first()
    tokens, distinct, once, twice = (int(x) for x in sums)
    discount = (once + 1) / (once + 2 * twice + 2)  # below 1, so that a word seen once keeps a part
    value = LogFrequencyFilter(least, 8).value

    def judge(rows: pa.Table) -> pa.Table:
        by = {(r["kind"], r["bucket"] if r["kind"] != "text" else None): r for r in rows.to_pylist()}

        def gathered(kind: str, column: str, number: str) -> np.ndarray:
            own = [by[k, b] for k, b in sorted(x for x in by if x[0] == kind)]
            return np.concatenate([_expand(r[column], number, r["lengths"][0]) for r in own])

        row = by["text", None]
        own = Part(row)
        c = gathered("totals", "counts", "<u8").astype(float)
        base = np.log10((c + 1) / (tokens + distinct + 1))
        word = np.where(c > 0, c - discount, discount * distinct) / tokens if tokens else np.ones(len(c))
        level = gathered("totals", "codes", "u1").astype(np.int64)
        share = np.where(level > 0, np.minimum(1, value(level + 1) / np.maximum(c, 1)), 0)
        h, w, _, _, which = own.pairs(buckets)
        pair = np.where((c[h] >= least) & (c[w] >= least), value(gathered("levels", "codes", "u1").astype(np.int64)), 0)
        p = word[own.codes] * (1 - KEPT_SHARE * share)[own.before] + (KEPT_SHARE * np.minimum(pair, c[h]) / np.maximum(c[h], 1))[which]
        sums = [np.add.reduceat(x, own.starts) for x in (base[own.codes], np.log10(p), (c > 0).astype(np.int64)[own.codes])]
        return pa.table(
            [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(own.lengths), pa.array(sums[2]),
             pa.array([tokens] * len(own.lengths), pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = texts.unionByName(told.where("kind = 'totals'")).unionByName(levels.where("kind = 'levels'"))
    return rows.groupBy("part").applyInArrow(
        judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_log_frequency_bloom(spark, folder):
    """Learns from documents whose crc32 modulo 7 is not 2, scores all of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, remainder("doc_id", 7) == 2)
