"""Language ID: language-bitmask n-gram filters.

Per language a Bloom filter of its n-grams, stored bit-sliced: slot i holds one bit per language, so the AND of the
slots of an n-gram gives all languages that contain it at once. A text's n-grams are probed, the hits are counted per
language, each count is corrected for that language's false-positive rate, and the highest corrected count decides.

The filter is learned from a bounded sample: about `sample_per_language` texts of each language, chosen by hash
(parameter; expected size, the draw is independent per row). Its size is fixed by `slots`. Every text is scored whole.

Defined cases: a null text or one without a letter is `und` with score 0; a text whose n-grams are all unknown gets
the most frequent learned language with score 0; without training rows everything is `und`; rows are judged one by
one, so repeated rows and null ids change nothing; at most 63 languages can be learned (more raises ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, remainder, settle, table

UNDETERMINED = "und"
N = 4
#: Characters looked at in one step; a longer text is worked off in steps.
STEP = 1 << 20
#: Odd multipliers of the n-gram polynomial and of the probes (fixed values).
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
PROBES = 3
#: One text in so many of a language's sample is enough for an n-gram; from so many texts a language is well taught.
RARE, WELL_TAUGHT = 50, 30


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> Iterator[np.ndarray]:
    """Codes of the n-grams of letters and single gaps, step by step; nothing for a text without letters."""
    letters, space = _letters(), np.uint32(32)
    for start in range(0, len(text), STEP):
        points = np.frombuffer(text[start:start + STEP].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters[points]
        if not is_letter.any():
            continue
        points = np.where(is_letter, points, space)
        gap = ~is_letter
        points = np.concatenate(([space], points[~(gap & np.concatenate(([True], gap[:-1])))], [space])).astype(np.uint64)
        if points[-2] == 32:
            points = points[:-1]
        if len(points) < N:
            points = np.concatenate((points, np.full(N - len(points), 32, np.uint64)))
        code = np.zeros(len(points) - N + 1, np.uint64)
        for i in range(N):
            code = code * np.uint64(MIX[1]) + points[i:len(points) - N + 1 + i]
        yield code


def probes(code: np.ndarray, slots: int) -> list[np.ndarray]:
    bits = np.uint64(64 - (slots.bit_length() - 1))
    return [(code ^ (code >> np.uint64(31))) * np.uint64(m) >> bits for m in MIX[:PROBES]]


class Filters:
    """The bit-sliced filters: languages, slots, each language's false-positive rate, and the languages that fewer than
    `WELL_TAUGHT` texts of the sample teach."""

    def __init__(self, languages: list[str], slots: np.ndarray, thin: frozenset[str] = frozenset()):
        self.languages, self.slots, self.thin = languages, slots, thin
        fill = np.array([np.count_nonzero(slots >> i & 1) / len(slots) for i in range(len(languages))])
        self.false_positive = fill ** PROBES

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, known): score is the winner's part of all corrected counts, known its part of n-grams."""
        hits, n = np.zeros(len(self.languages)), 0
        for code in grams(text or ""):
            found = None
            for p in probes(code, len(self.slots)):
                found = self.slots[p] if found is None else found & self.slots[p]
            n += len(code)
            hits += [np.count_nonzero(found >> i & 1) for i in range(len(self.languages))]
        if not n or not self.languages:
            return UNDETERMINED, 0.0, 0.0
        true = np.maximum(0, (hits - n * self.false_positive) / np.maximum(1e-9, 1 - self.false_positive))
        best = int(true.argmax())
        return self.languages[best], float(true[best] / true.sum()) if true.sum() else 0.0, float(min(1.0, true[best] / n))


def learn(labelled: DataFrame, *, sample_per_language: int = 500, slots: int = 1 << 20, min_texts: int = 3,
          against: float = 0.25) -> Filters:
    """labelled: text, lang, and doc_id if there is one. An n-gram belongs to a language if at least `min_texts` of its
    sample (or one in `RARE` of it, where that is less) have it and its share there is at least `against` times its share in
    the language that has it most."""
    spark = labelled.sparkSession
    drawn_by = [c for c in ("text", "doc_id") if c in labelled.columns]
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", *drawn_by)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(64).collect()}
    if len(counts) > 63:
        raise ValueError("more than 63 languages")
    languages = sorted(counts, key=lambda x: (-counts[x], x))
    if not languages:
        return Filters([], np.zeros(slots, np.uint8))
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_per_language / n))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64(*drawn_by, F.lit(3)), F.lit(1 << 30)) < rate * (1 << 30)).select("lang", "text")

    def texts_grams(batches):
        settle()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [np.unique(c) for c in grams(text)]
                codes = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64))], ["lang", "code"])

    found = chosen.mapInArrow(texts_grams, "lang string, code long")
    per = [F.sum((F.col("lang") == x).cast("long")).alias(f"n{i}") for i, x in enumerate(languages)]
    sampled = chosen.groupBy("lang").count().collect()
    size = {r["lang"]: r["count"] for r in sampled}
    share = [F.col(f"n{i}") / max(1, size.get(x, 0)) for i, x in enumerate(languages)]
    most = F.greatest(*share) if len(share) > 1 else share[0]
    least = [min(min_texts, -(-size.get(x, 0) // RARE)) for x in languages]
    mask = sum((F.when((F.col(f"n{i}") >= max(1, least[i])) & (s >= against * most), 1 << i).otherwise(0).cast("long")
                for i, s in enumerate(share)), F.lit(0).cast("long"))
    learned = found.groupBy("code").agg(*per).select("code", mask.alias("mask")).where("mask > 0").toArrow()
    code = learned.column("code").to_numpy().view(np.uint64)
    kind = np.min_scalar_type((1 << len(languages)) - 1)
    slice_ = np.zeros(slots, kind)
    for p in probes(code, slots):
        np.bitwise_or.at(slice_, p, learned.column("mask").to_numpy().astype(kind))
    return Filters(languages, slice_, frozenset(x for x in languages if size.get(x, 0) < WELL_TAUGHT))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(row, lang_pred, score, known): every row with its language."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(packed(docs).alias("row"))
    text = docs.columns.index("text")
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double").add("known", "double")

    def judge(batches):
        settle()
        for batch in batches:
            told = [sent.value.judge(t.as_py()) for t in batch.column(0).field(text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in told], pa.string()), pa.array([x[1] for x in told], pa.float64()),
                 pa.array([x[2] for x in told], pa.float64())], ["row", "lang_pred", "score", "known"])

    return rows.mapInArrow(judge, schema)


def in_known_language(docs: DataFrame, *, least_known: float = 0.4, **options) -> DataFrame:
    """The documents in one of the languages that the labelled ones (lang not null) teach, with their columns; rejected
    are texts without a letter and those of whose n-grams less than `least_known` belong to any one language. A document
    whose language, predicted or its own, is thinly taught is not rejected for that."""
    filters = learn(docs, **options)
    told = predict(docs, filters).where(F.col("lang_pred") != UNDETERMINED)
    thin = [F.coalesce(c.isin(*filters.thin), F.lit(False)) for c in (F.col("lang_pred"), F.col("row.lang"))] if filters.thin else []
    kept = F.col("known") >= least_known
    for c in thin:
        kept = kept | c
    return told.where(kept).select("row.*")


def op1_language_bitmask(spark, folder):
    """Learns from documents whose crc32 modulo 4 is not 2, predicts all of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 4) == 2
    filters = learn(docs.where(~held))
    told = predict(docs.select("doc_id", "text", held.alias("held_out")), filters)
    return told.select("row.doc_id", "row.held_out", "lang_pred", "score", "known")
