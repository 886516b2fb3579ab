"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target proportions.

Each source is a queue of its documents' tokens. Every round deals one window's worth of credit to the queues in
target proportion; a queue sends whole grains of tokens as far as its credit reaches and carries the rest of the
credit, its deficit, into the next round. The tokens sent, round after round and queue after queue, form one stream
that is cut into sequences. Credit after k rounds is a plain function of k, so every partition knows the deficits it
starts with and places its documents alone: no window is simulated and nothing passes through one task.

Targets are the sources' shares of all tokens, or `weights` per source; when a queue runs empty, the others share its
credit. All documents are placed, each token once. Only the tail needs padding, and it gets none: it is cut into
sequences of powers of two.

Tokens are computed once and kept, two bytes each, with the running offset inside (partition, source); per-partition
sums give each queue offset. Per source one summary row comes to the driver (`max_sources`, more raise ValueError).

Defined cases: a null text is empty (its document is the end token alone), a null source is a queue of its own,
repeated rows are packed one by one, an empty table gives an empty result; a document of any length is cut freely.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain, filterfalse, islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, packed, remembers, settle, table

END = 1
#: Distinct words, and pieces of words, that a worker remembers at most (about 200 bytes each).
REMEMBERED = 800_000
#: Bytes of tokens per batch that leaves a worker.
BATCH_BYTES = 8 << 20
#: How the vocabulary's own rule cuts lower-case ASCII (fixed value).
ASCII_CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\r\x0b\x0ca-z0-9]+")
_TRAILING = b".,;:!?"


class WordCoder(dict):
    """Remembers the ids of white-space separated words. The vocabulary drops white space and cuts before it merges,
    so a text's ids are those of its words, and an ASCII word's ids those of its letter and sign runs in lower case;
    words with other characters or a special token's mark are encoded as they are, less closing marks after a letter or
    digit: after another sign they belong to its run."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.kind, self.code = ("<u2", "H") if self.coder.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.whole: dict[bytes, bytes] = {}

    def cuts(self, word: bytes) -> list[bytes]:
        if word.isalpha():  # ASCII letters only
            return [word.lower()]
        if word[:-1].isalpha() and word[-1:] in _TRAILING:
            return [word[:-1].lower(), word[-1:]]
        if b"<|" in word:
            return [word]
        if word.isascii():
            return [x.encode() for x in ASCII_CUTS.findall(word.decode("ascii").lower())]
        head = word.rstrip(_TRAILING)
        if len(head) < len(word) and (head[-1:].isalnum() or normalize("NFC", head.decode()[-1:]).lower()[-1:].isalnum()):
            return [head, word[len(head):]]  # a letter or digit as the vocabulary sees it
        return [word]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts in UTF-8, as bytes."""
        words = [t.split() for t in texts]
        fresh = set(filterfalse(self.__contains__, chain.from_iterable(words)))
        if len(self) + len(fresh) > REMEMBERED:
            _forget_late(self)
            fresh = set(filterfalse(self.__contains__, chain.from_iterable(words)))
        if fresh:
            parts = {w: self.cuts(w) for w in fresh}
            if len(self.whole) > REMEMBERED:
                _forget_late(self.whole)
            new = list(set(filterfalse(self.whole.__contains__, chain.from_iterable(parts.values()))))
            for x, told in zip(new, self.coder.encode_batch_fast([x.decode() for x in new], add_special_tokens=False), strict=True):
                self.whole[x] = array(self.code, told.ids).tobytes()
            whole = self.whole
            self.update({w: whole[p[0]] if len(p) == 1 else b"".join([whole[x] for x in p]) for w, p in parts.items()})
        return [b"".join(map(self.__getitem__, w)) for w in words]


def _forget_late(known: dict) -> None:
    """Drops all but the first third: what came early comes often."""
    early = list(islice(known.items(), REMEMBERED // 3))
    known.clear()
    known.update(early)


_coders: dict[str, WordCoder] = remembers("packing", {})


def coder_of(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenised(docs: DataFrame, carry: tuple[str, ...], vocabulary: str | None) -> DataFrame:
    """(row, name, part, start, n, ids): ids with the end token; start counts the tokens of that source before the
    row in its partition."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(packed(docs.select(*carry)).alias("row"), name.alias("name"), F.col("text").alias("text"))
    schema = rows.select("row", "name").schema.add("part", "long").add("start", "long").add("n", "long").add("ids", "binary")

    def encode(batches):
        settle("packing")
        coder = coder_of(vocabulary or vocabulary_file())
        end, wide, part, seen = np.array([END], coder.kind).tobytes(), np.dtype(coder.kind).itemsize, TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids = [x + end for x in coder.encode([t or b"" for t in some.column(2).cast(pa.binary()).to_pylist()])]
                starts, names = [], some.column(1).to_pylist()
                for name, x in zip(names, ids, strict=True):
                    starts.append(seen.get(name, 0))
                    seen[name] = starts[-1] + len(x) // wide
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()),
                     pa.array([len(x) // wide for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return rows.mapInArrow(encode, schema)


class Rounds:
    """Credit of every queue after k rounds, in closed form."""

    def __init__(self, totals: list[int], weights: list[float] | None, window: int, grain: int):
        self.window, self.grain = window, grain
        self.totals = np.array(totals, np.int64)
        self.count = -(-int(self.totals.sum()) // window)
        # stretches between the moments at which a queue runs empty: stream position, credit of each queue there
        weight = np.array(totals if weights is None else weights, float)
        at, given = [0.0], [np.zeros(len(totals))]
        while (left := self.totals - given[-1] > 0.5).any() and len(at) <= len(totals):
            rate = np.where(left, np.maximum(weight, 1e-12), 0)
            rate /= rate.sum()
            need = np.where(left, (self.totals - given[-1]) / np.where(left, rate, 1), np.inf)
            step = need.min()
            at.append(at[-1] + step)
            given.append(np.where(need <= step * (1 + 1e-12), self.totals, given[-1] + rate * step))
        self.at, self.given = np.array(at), np.array(given)

    def sent(self, k: np.ndarray, queue) -> np.ndarray:
        """Tokens that the queue has sent before round k: whole grains of its credit, everything after the last."""
        x = k * float(self.window)
        i = np.minimum(np.searchsorted(self.at, x, side="right"), len(self.at) - 1)
        low, high = self.given[i - 1, queue], self.given[i, queue]
        run = np.maximum(self.at[i] - self.at[i - 1], 1e-9)
        credit = np.minimum(high, low + (x - self.at[i - 1]) * ((high - low) / run))
        sent = np.floor(credit / self.grain).astype(np.int64) * self.grain
        return np.where(k >= self.count, self.totals[queue], np.minimum(sent, self.totals[queue]))

    def round_of(self, queue: int, grains: np.ndarray) -> np.ndarray:
        """The round in which each grain of the queue is sent."""
        until = np.minimum((grains + 1) * self.grain, self.totals[queue])
        k = np.floor(np.interp(until, self.given[:, queue], self.at) / self.window).astype(np.int64)
        k = np.clip(k, 0, self.count - 1)
        while (late := (self.sent(k + 1, queue) < until) & (k < self.count - 1)).any():
            k += late
        while (early := (k > 0) & (self.sent(k, queue) >= until)).any():
            k -= early
        return k

    def place(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """Stream positions of the queue's tokens."""
        grains, back = np.unique(tokens // self.grain, return_inverse=True)
        k = self.round_of(queue, grains)
        before = np.zeros(len(k), np.int64)
        for other in range(len(self.totals)):
            before += self.sent(k + 1 if other < queue else k, other)
        return (before - self.sent(k, queue))[back] + tokens


def tail_sequences(total: int, window: int) -> np.ndarray:
    """First stream positions of the sequences that begin after the last full one: powers of two, largest first."""
    at, rest, starts = total - total % window, total % window, []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return np.array(starts, np.int64)


def pack(docs: DataFrame, *, carry: tuple[str, ...] = ("doc_id",), window: int = 2048, grain: int = 64, weights: dict[str | None, float] | None = None,
         vocabulary: str | None = None, max_sources: int = 4096) -> DataFrame:
    """(row, start, length, doc_tokens, sequence_id, offset, ids): every piece of every document; ids are
    little-endian unsigned 32-bit numbers. carry: the columns in `row`. weights: target proportions by source (default: their token shares)."""
    spark = docs.sparkSession
    tokens = keep(tokenised(docs, carry, vocabulary))
    sums = keep(tokens.groupBy("part", "name").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("name").agg(F.sum("n").alias("n")).orderBy("name").limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    names = [r["name"] for r in totals]
    wanted = None if weights is None else [float(weights.get(x[1:] if x else None, 0)) for x in names]
    rounds = Rounds([r["n"] for r in totals], wanted, window, grain)
    earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", "name", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = tokens.join(offsets, ["part", "name"]).select("row", "name", (F.col("base") + F.col("start")).alias("first"), "n", "ids")
    schema = rows.select("row").schema
    for column in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(column, "long")
    schema = schema.add("ids", "binary")
    total, index = int(rounds.totals.sum()), {x: i for i, x in enumerate(names)}
    tail = tail_sequences(total, window)
    full = total // window

    def place(batches):
        settle("packing")
        kind = coder_of(vocabulary or vocabulary_file()).kind
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                first, n = (some.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                queues = np.array([index[x] for x in some.column(1).to_pylist()], np.int64)
                pieces = [_pieces(rounds, int(q), np.flatnonzero(queues == q), first, n, window, tail, full) for q in np.unique(queues)]
                which, start, length, sequence, offset = (np.concatenate(x) for x in zip(*pieces, strict=True))
                order = np.lexsort((start, which))
                which, start, length, sequence, offset = (x[order] for x in (which, start, length, sequence, offset))
                ends = np.cumsum(length)
                for lo, hi in _stretches(ends * 4):
                    ids, seen = [], {}
                    for w, s, m in zip(which[lo:hi].tolist(), start[lo:hi].tolist(), length[lo:hi].tolist(), strict=True):
                        if w not in seen:
                            seen = {w: np.frombuffer(some.column(4)[w].as_buffer(), kind).astype("<u4")}
                        ids.append(seen[w][s:s + m].tobytes())
                    take = pa.array(which[lo:hi])
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(take), pa.array(start[lo:hi]), pa.array(length[lo:hi]), some.column(3).take(take),
                         pa.array(sequence[lo:hi]), pa.array(offset[lo:hi]), pa.array(ids, pa.binary())], schema.names)

    return rows.mapInArrow(place, schema)


def _stretches(ends: np.ndarray):
    """Index ranges whose bytes stay near BATCH_BYTES."""
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + BATCH_BYTES, side="right")))
        yield lo, hi
        lo = hi


def _pieces(rounds: Rounds, queue: int, rows: np.ndarray, first: np.ndarray, n: np.ndarray, window: int, tail: np.ndarray, full: int):
    """(row, start, length, sequence, offset) of the rows' pieces; all rows belong to one queue."""
    grain = rounds.grain
    grains = -(-(first[rows] + n[rows]) // grain) - first[rows] // grain
    which = np.repeat(rows, grains)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(grains) - grains, grains)
    lo = np.maximum(first[which], (first[which] // grain + nth) * grain)
    hi = np.minimum(first[which] + n[which], (first[which] // grain + nth + 1) * grain)
    at = rounds.place(queue, lo)
    # joined where the stream runs on within a document, then cut where sequences begin
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1])
    heads = np.flatnonzero(new)
    which, lo, at, hi = which[heads], lo[heads], at[heads], hi[np.concatenate((heads[1:], [len(hi)])) - 1]

    def sequence_of(p):
        return np.where(p < full * window, p // window, full - 1 + np.searchsorted(tail, p, side="right"))

    def begin_of(s):
        return np.where(s < full, s * window, tail[np.clip(s - full, 0, max(0, len(tail) - 1))] if len(tail) else 0)

    spans = sequence_of(at + hi - lo - 1) - sequence_of(at) + 1
    piece = np.repeat(np.arange(len(which)), spans)
    sequence = sequence_of(at)[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(spans) - spans, spans)
    begin = np.maximum(at[piece], begin_of(sequence))
    last = np.cumsum(spans) - 1
    end = np.concatenate((begin[1:], [0]))
    end[last] = at + hi - lo
    which, lo = which[piece], lo[piece] + begin - at[piece]
    return which, lo - first[which], end - begin, sequence, begin - begin_of(sequence)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; one row gathers at most one window."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("parts"))
            .select("sequence_id", "length", F.expr("aggregate(parts, X'', (all, p) -> concat(all, p.ids))").alias("ids")))


def op4_deficit_packing(spark, folder):
    return pack(table(spark, folder, "documents")).select("row.doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
