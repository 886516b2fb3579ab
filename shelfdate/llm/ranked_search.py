"""Ranked lexical search: term-at-a-time with limited accumulators, over document shards.

The distinct terms of the queries are numbered and sent to the workers. One pass over the texts counts, per shard of
documents, lengths and occurrences of these terms and keeps them as posting lists, term by term; sums over the shards
give the corpus statistics and every term's document frequency. A second pass over the kept lists scores: per shard and
query the lists are taken rarest term first (by document frequency in the corpus), each adding to the accumulators of
its documents. As soon as the bounds of the lists that are left (the largest contribution of a list in this shard, times
the query's repeats) add up to less than the k-th largest partial score, no new accumulator is made: such a document
could not get among the first k of the shard. Accumulators that exist are updated to the end, so their scores are exact.
The best k of each shard are ranked over all shards.

Queries are a stated set: they are taken in blocks of about `BLOCK_CHARS` characters, chosen by hash; only one block's
terms are on the driver and broadcast at a time, and every block reads all documents.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.

Defined cases: null and termless texts are no documents of the corpus (they count nowhere and match nothing); a query
without terms, or whose terms no document has, gets no rows; repeated query rows are answered each; repeated documents
rank each; equal scores go by ascending id, null ids last; an empty table gives an empty result. Columns besides the
named ones are not read. A text is counted whole, in one task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, settle, table

BLOCK_CHARS = 8_000_000
#: A shard is closed at so many documents or found term occurrences.
SHARD_DOCS, SHARD_HITS = 32_768, 2_000_000
#: Lower-cases A-Z and blanks all other ASCII characters but digits and letters.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

LISTS = "docs array<long>, lengths array<long>, terms array<int>, sizes array<int>, places binary, times binary, full long, total long"
ARROW = pa.schema([("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
                   ("places", pa.binary()), ("times", pa.binary()), ("full", pa.int64()), ("total", pa.int64())])


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(PLAIN).split() if text else []


def posting_lists(docs: DataFrame, numbers) -> DataFrame:
    """Per shard of documents one row: ids and numbers of terms of its documents with terms, the query terms that occur,
    the size of each one's list, and the lists: places in `docs` and occurrences. numbers: broadcast {term: number > 0}."""
    def count(batches):
        settle("ranked_search")
        get = numbers.value.get
        ids, lengths, hits, size = [], [], [], 0

        def close():
            codes = np.concatenate(hits)
            place = np.repeat(np.arange(len(ids)), [len(h) for h in hits])
            both, times = np.unique(codes * len(ids) + place, return_counts=True)
            terms, sizes = np.unique(both // len(ids), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(
                    (ids, lengths, terms.astype(np.int32), sizes.astype(np.int32), (both % len(ids)).astype("<u4").tobytes(),
                     np.minimum(times, 2**32 - 1).astype("<u4").tobytes(), len(ids), sum(lengths)), ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                if not found:
                    continue
                ids.append(doc)
                lengths.append(len(found))
                hits.append(np.fromiter(filter(None, map(get, found)), np.int64))
                size += len(hits[-1])
                if len(ids) >= SHARD_DOCS or size >= SHARD_HITS:
                    yield from close()
                    ids, lengths, hits, size = [], [], [], 0
        if ids:
            yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, LISTS)


def term_at_a_time(lists: list[tuple[np.ndarray, np.ndarray]], width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of all documents that may be among the k best, with exact scores. lists: rarest first, each as
    places in order and what it adds to them; a place is below `width`."""
    bounds = np.array([adds.max() for _, adds in lists], np.int64)
    left = np.concatenate((np.cumsum(bounds[::-1])[::-1], [0]))
    partial = np.zeros(width, np.int64)
    survivors = None
    for j, (places, adds) in enumerate(lists):
        if survivors is None and left[j] < left[0] - left[j]:  # else no partial score is above what is left
            made = partial[partial > 0]
            if len(made) >= k and left[j] < np.partition(made, len(made) - k)[len(made) - k]:
                survivors = np.flatnonzero(partial)
        if survivors is None:
            partial[places] += adds
        elif 16 * len(survivors) < len(places):
            at = np.minimum(np.searchsorted(places, survivors), len(places) - 1)
            there = places[at] == survivors
            partial[survivors[there]] += adds[at[there]]
        else:
            there = partial[places] > 0
            partial[places[there]] += adds[there]
    survivors = np.flatnonzero(partial)
    return survivors, partial[survivors]


def best_of_shards(lists: DataFrame, queries, weights, frequency, documents: int, total: int, k: int) -> DataFrame:
    """(query, doc_id, score): the best k documents of each shard. queries: broadcast [(query, {term number: repeats})];
    weights, frequency: by term number."""
    def rank(batches):
        settle("ranked_search")
        weight, often, wanted = weights.value, frequency.value, queries.value
        for batch in batches:
            out = ([], [], [])
            for row in batch.to_pylist():
                ids = np.array([2**63 - 1 if i is None else i for i in row["docs"]], np.int64)
                m = 100 - 75 + 75 * np.array(row["lengths"], np.int64) * documents // total
                places, tf = np.frombuffer(row["places"], "<u4").astype(np.int64), np.frombuffer(row["times"], "<u4").astype(np.int64)
                adds = 1_000_000_000 * tf // (1000 * tf + 8 * m[places])
                adds *= np.repeat(weight[row["terms"]], row["sizes"]) if len(places) else 1
                ends = np.cumsum(row["sizes"])
                span = {t: (e - s, e) for t, s, e in zip(row["terms"], row["sizes"], ends, strict=True)}
                for query, terms in wanted:
                    own = sorted((often[t], t) for t in terms if t in span)
                    own = [(places[slice(*span[t])], adds[slice(*span[t])] * terms[t]) for _, t in own]
                    if not own:
                        continue
                    found, score = term_at_a_time(own, len(ids), k)
                    first = np.lexsort((ids[found], -score))[:k]
                    out[0].extend([query] * len(first))
                    out[1].extend(row["docs"][p] for p in found[first])
                    out[2].extend(score[first].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query", "doc_id", "score"])

    return lists.mapInArrow(rank, "query long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of queries (item_id, text) the k best of docs (doc_id, text)."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    shape = "item_id " + queries.schema["item_id"].dataType.simpleString() + ", rank int, doc_id long, score long"
    result = spark.createDataFrame([], shape)
    chars = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks or 1))
    for b in range(blocks):
        asked = queries.where((block == b) & F.col("text").isNotNull()).select("item_id", "text").collect()
        wanted = [(r["item_id"], Counter(terms_of(r["text"]))) for r in asked]
        number = {t: i for i, t in enumerate(sorted({t for _, terms in wanted for t in terms}), 1)}
        if not number:
            continue
        lists = keep(posting_lists(docs, sc.broadcast(number)))
        size = lists.agg(F.sum("full").alias("documents"), F.sum("total").alias("total")).first()
        if not size["total"]:
            continue
        often = np.zeros(len(number) + 1, np.int64)
        counts = lists.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes").alias("df"))
        for r in counts.collect():  # one row per query term of this block
            often[r["terms"]] = r["df"]
        documents = size["documents"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in often.tolist()], np.int64)
        coded = [(i, {number[t]: n for t, n in terms.items()}) for i, (_, terms) in enumerate(wanted)]
        best = best_of_shards(lists, sc.broadcast(coded), sc.broadcast(weight), sc.broadcast(often), documents, size["total"], k)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(wanted)], "query long, " + shape.split(", ")[0])
        result = result.unionByName(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return result


def op12_accumulator_search(spark, folder):
    return search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH q AS MATERIALIZED (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
d AS MATERIALIZED (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE len({_TERMS}) > 0),
s AS (SELECT count(*) AS n, sum(len(terms)) AS l FROM d),
p AS MATERIALIZED (SELECT doc_id, len(terms) AS size, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + CAST((75 * size * n) // l AS BIGINT))))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
