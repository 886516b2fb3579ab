"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation, components.

1. A document's set: hashes of its distinct five-word shingles. Documents with equal sets form a class; its smallest
   id stands for it from here on.
2. `bands * rows` multiply-shift hash minima per set; each band of minima is a bucket. With the defaults a pair at
   Jaccard 0.85 misses all buckets with probability 8e-7.
3. In each bucket every member is compared with one centre (the smallest id). Where that leaves a bucket with members
   of several components, members that have too many shingles of their own to be similar to any other are settled.
   Of the rest, those outside the bucket's largest component are centres in turn, a few rounds with one per bucket, then
   all that still remain; a pair is formed in its first common bucket only, unless counts of shared shingles or the
   signatures rule it out. So every pair of a bucket is compared, ruled out or already in one component, and a group of
   copies never costs all its pairs.
4. A comparison first estimates from the signatures (five standard errors of slack), then counts the intersection of
   the full sets; a link needs 100 * intersection >= percent * union.
5. Links make components by alternating large-star and small-star.

Only sets of documents that share a bucket are made: a fixed-size bitmap of their ids (2**26 bits; more ids only mean
more sets than needed) tells which when the texts are read the second time.

Defined cases: null and empty texts have an empty set and are linked with nothing; fewer than five words count as one
shingle; rows without id are linked with nothing and kept; rows with equal ids are one node; repeated rows are equal
sets; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, packed, settle, table
from .components import components
from .windows import BASES, finish, rolling, word_hash

WIDTH = 5
#: Shingles whose minima are taken at a time.
STEP = 4096
#: Bits of the id bitmap, and bits per row of Spark's bitmap aggregate (fixed value).
BITMAP, BITMAP_ROW = 1 << 26, 32768


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; ASCII letters count in lower case."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = word_hash.of(words)
    if len(words) < width:
        return finish(rolling(hashes, len(words), BASES[0]) + np.uint64(len(words)))
    return np.unique(rolling(hashes, width, BASES[0]))


def multipliers(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n, np.uint64)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over the items, as signed 32-bit numbers."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), STEP):
        least = np.minimum(least, (items[at:at + STEP, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, key, sig) of every document with an id: set size, digest of the set, minima (null if empty)."""
    a, b = multipliers(n)

    def sign(batches):
        settle("windows")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                sets = [shingles(t.as_py()) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array([minima(s, a, b) if len(s) else None for s in sets], pa.list_(pa.int32()))], ["doc_id", "n", "key", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return rows.mapInArrow(sign, "doc_id long, n long, key binary, sig array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, n, sig, items) of the documents whose ids are listed, and of some others whose ids share their bits."""
    place = F.pmod(F.xxhash64("id"), F.lit(BITMAP))
    bits = (ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits")).collect())
    bitmap = np.zeros(BITMAP // 8 + BITMAP_ROW, np.uint8)
    for r in bits:
        at = (r["bucket"] - 1) * BITMAP_ROW // 8
        bitmap[at:at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    a, b = multipliers(n)

    def gather(batches):
        settle("windows")
        for batch in batches:
            p = batch.column(2).to_numpy()
            hit = np.flatnonzero(sent.value[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            for at in range(0, len(hit), 500):
                some = batch.take(pa.array(hit[at:at + 500]))
                sets = [shingles(t.as_py()) for t in some.column(1)]
                full = [i for i, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(full, pa.int64())), pa.array([len(sets[i]) for i in full], pa.int64()),
                     pa.array([minima(sets[i], a, b) for i in full], pa.list_(pa.int32())),
                     pa.array([sets[i].view(np.int64) for i in full], pa.list_(pa.int64()))], ["id", "n", "sig", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL").select("id", "text", place.alias("p"))
    return rows.mapInArrow(gather, "id long, n long, sig array<int>, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("items").alias("ib"))
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    common = F.size(F.array_intersect("ia", "ib"))
    exact = 100 * common >= percent * (F.col("na") + F.col("nb") - common)
    alike = _agreement("sa", "sb") >= _least_agreement(percent, n)
    return pairs.join(left, "a").join(right, "b").where(F.when(sized & alike, exact).otherwise(False)).select("a", "b")


def _agreement(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _least_agreement(percent: int, n: int) -> int:
    s = percent / 100
    return int(n * s - 5 * (n * s * (1 - s)) ** 0.5)


def near_duplicates(docs: DataFrame, *, percent: int = 85, bands: int = 24, rows: int = 5, centre_rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n, key), (key, rep, component_id, copies)): every document with its set's digest, and per class of
    equal sets its smallest id, the smallest id reachable by links, and the number of rows."""
    n = bands * rows
    seen = keep(signed(docs, n))
    classes = keep(seen.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    stands = seen.where("n > 0").join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"])
    bucket = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * rows + 1, rows))))
    spots = stands.select(F.col("doc_id").alias("id"), bucket.alias("bucket")).distinct()
    shared = spots.groupBy("bucket").agg(F.count("*").alias("m"), F.min("id").alias("centre")).where("m > 1").drop("m")
    spots = keep(spots.join(shared, "bucket"))
    sets = keep(full_sets(docs, spots.select("id").distinct(), n))

    found = confirmed(spots.where("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), sets, percent, n)
    stars = components(found)
    members = spots.select("bucket", "id")
    done = [spots, sets]
    marks = ("id", "label", "n", "m", "seats", "sig")
    for turn in range(centre_rounds + 1):
        open_ = keep(_unsettled(members, stars))
        done.append(open_)
        if open_.isEmpty():
            break
        sized = keep(_matchable(open_.select("id").distinct(), sets, percent))
        apart = keep(_unsettled(open_.select("bucket", "id").join(sized.select("id"), "id"), stars))
        done += [sized, apart]
        seats = apart.groupBy("id").agg(F.collect_list("bucket").alias("seats"))  # one per band at most
        members, apart = apart.select("bucket", "id"), apart.join(sized, "id").join(seats, "id")
        stray = apart.where("NOT main")
        if turn < centre_rounds:
            stray = stray.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), *marks)).alias("s")).select("bucket", "s.*")
        stray = stray.select("bucket", *[F.col(c).alias(f"{c}_b") for c in marks])
        most = F.least("m", "m_b")
        pairs = apart.join(stray, "bucket").where(
            (F.col("label") != F.col("label_b")) & (100 * most >= percent * (F.col("n") + F.col("n_b") - most))
            & (F.array_min(F.array_intersect("seats", "seats_b")) == F.col("bucket")) & (_agreement("sig", "sig_b") >= _least_agreement(percent, n)))
        more = confirmed(pairs.select(F.greatest("id", "id_b").alias("a"), F.least("id", "id_b").alias("b")).distinct(), sets, percent, n)
        stars = components(stars.unionByName(more))
    forget(*done)
    roots = stars.select(F.col("a").alias("rep"), F.col("b").alias("root"))
    return seen.select("doc_id", "n", "key"), classes.join(roots, "rep", "left").select(
        "key", "rep", F.coalesce("root", "rep").alias("component_id"), "copies")


def _matchable(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, m, sig) of the ids whose sets can be similar enough to another one's: n items, m of which occur in another of
    these sets too. What occurs in one set only cannot be common, so m bounds every intersection."""
    own = sets.join(ids, "id", "left_semi")
    once = (own.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("k"), F.min("id").alias("id"))
            .where("k = 1").groupBy("id").agg(F.count("*").alias("u")))
    return (own.dropDuplicates(["id"]).join(once, "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m"), "sig")
            .where(100 * F.col("m") >= percent * F.col("n")))


def _unsettled(members: DataFrame, stars: DataFrame) -> DataFrame:
    """(bucket, id, label, main) of the buckets whose members lie in several components; main: in the largest of them."""
    named = members.join(stars.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select(
        "bucket", "id", F.coalesce("root", "id").alias("label"))
    counts = named.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    main = (counts.groupBy("bucket").agg(F.count("*").alias("labels"), F.max(F.struct("m", F.negative("label").alias("label"))).alias("top"))
            .where("labels > 1").select("bucket", F.negative("top.label").alias("top")))
    return named.join(main, "bucket").select("bucket", "id", "label", (F.col("label") == F.col("top")).alias("main"))


def judged(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    seen, classes = near_duplicates(docs, **options)
    told = seen.join(classes.select("key", "component_id"), "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return told.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without the near-duplicates of a document with a smaller id; of rows with equal ids the one
    whose text has the smallest hash stays."""
    gone = judged(docs, **options).where("NOT kept").select("doc_id").distinct()
    rows = docs.select(packed(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.join(gone, "doc_id", "left_anti")
    once = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return once.select("row.*").unionByName(rows.where("doc_id IS NULL").select("row.*"))


def op8_minhash_components(spark, folder):
    return judged(table(spark, folder, "documents"))
