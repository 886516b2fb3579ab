"""Document fingerprints: I-Match with randomised lexicon subsets, on DataFrame functions only.

Terms are lower-case runs of letters and digits. The lexicon holds the terms whose share of documents lies in a band:
rarer ones are noise, commoner ones tell nothing. Each lexicon term belongs to one of `SUBSETS` random subsets, by the
first bits of its hash. A document's distinct lexicon terms are sorted and, subset by subset, hashed; the hashes are its
fingerprint. Two fingerprints are as alike as the share of subsets, among those that either document has terms in, on
which they agree.

The band bounds the lexicon: at most (mean distinct terms per document) / `rarest` terms can be that frequent. It is
broadcast while it has at most `MAX_BROADCAST` terms, beyond that it is joined by shuffle.

Neighbours in order of doc_id are found without a global sort in one task: documents are dealt by ranges of their id,
and the first document of each range is also sent to the range before it (the very first to the last).

Defined cases: a null text is empty; a document without a lexicon term is fingerprinted by its whole text; documents
without id have no neighbour, nothing in them is replaced and near_next is 0; rows with equal ids follow each other in
order of their text's hash; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, partitions, table

#: Subset numbers are the first 6 bits of a term's hash; a component keeps 42 bits of its own hash behind them.
SUBSETS, BITS = 64, 42
MAX_BROADCAST = 1_000_000
NOT_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct hashes of the text's terms."""
    words = F.filter(F.split(F.lower(text), NOT_TERM), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, rarest: float, commonest: float) -> DataFrame:
    """(term) of the hashes whose share of documents lies within the band; counted over all documents."""
    n = docs.count()
    return (docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
            .where((F.col("df") >= rarest * n) & (F.col("df") <= commonest * n)).select("term"))


def _range_of(value: Column, cuts: list[int], step: int = 64) -> Column:
    """How many cuts are at or below the value, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    coarse = F.array(*[F.lit(c) for c in cuts[::step]])
    fine = F.array(*[F.lit(c) for c in cuts])
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= value)) - 1, F.lit(0)) * step
    return block + F.size(F.filter(F.slice(fine, block + 1, F.lit(step)), lambda c: c <= value))


def beside_next(docs: DataFrame) -> DataFrame:
    """(b, place, ghost, doc_id, text, next_text): each document with the text of the next one in order of id; b is
    the range, place the position in it. Ghost rows are copies of the next range's first document."""
    parts = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    at = _range_of(F.col("doc_id"), cuts)
    firsts = {r["r"]: r["first"] for r in rows.where("doc_id IS NOT NULL").groupBy(at.alias("r")).agg(F.min("doc_id").alias("first")).collect()}
    used = sorted(firsts)
    before = {r: used[i - 1] for i, r in enumerate(used)}
    first_of = F.array(*[F.lit(firsts.get(r)).cast("long") for r in range(len(cuts) + 1)])
    target_of = F.array(*[F.lit(before.get(r, 0)) for r in range(len(cuts) + 1)])
    lone = F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")
    spot = F.when(F.col("doc_id").isNull(), lone).otherwise(at)
    own = F.struct(F.col("r").alias("b"), F.lit(False).alias("ghost"), F.lit(False).alias("wrap"))
    ghost = F.struct(F.element_at(target_of, F.col("r") + 1).alias("b"), F.lit(True).alias("ghost"), (F.col("r") == (used[0] if used else 0)).alias("wrap"))
    heads = F.when((F.col("r") >= 0) & (F.col("doc_id") == F.element_at(first_of, F.greatest(F.col("r"), F.lit(0)) + 1)), F.array(own, ghost)).otherwise(F.array(own))
    dealt = rows.withColumn("r", spot).select("doc_id", "text", F.explode(heads).alias("to")).select("to.*", "doc_id", "text")
    order = Window.partitionBy("b").orderBy("wrap", "doc_id", F.xxhash64("text"), "ghost")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    return dealt.select("b", F.row_number().over(order).alias("place"), "ghost", "doc_id", "text", following.alias("next_text"))


def _components(listed: Column, text: Column) -> Column:
    """Sorted terms, hashed subset by subset; each component is its subset's number and 42 bits of the hash."""
    def code(number: Column, h: Column) -> Column:
        return F.shiftleft(number, BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << BITS) - 1)))

    def number(term: Column) -> Column:
        return F.shiftrightunsigned(term, 58)

    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("h"))

    def step(now, term):
        closed = F.when(now["s"] < 0, now["done"]).otherwise(F.array_append(now["done"], code(now["s"], now["h"])))
        same = now["s"] == number(term)
        return F.struct(F.when(same, now["done"]).otherwise(closed).alias("done"), number(term).alias("s"),
                        F.when(same, F.xxhash64(now["h"], term)).otherwise(F.xxhash64(term)).alias("h"))

    folded = F.aggregate(F.array_sort(listed), start, step, lambda now: F.array_append(now["done"], code(now["s"], now["h"])))
    return F.when(F.size(listed) > 0, folded).otherwise(F.array(code(F.lit(0).cast("long"), F.xxhash64(text))))


def _printed(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda c: F.lpad(F.hex(c), 12, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets with terms of either document on which both have the same hash."""
    subsets = F.array_distinct(F.transform(F.concat(a, b), lambda c: F.shiftrightunsigned(c, BITS)))
    return F.size(F.array_intersect(a, b)) / F.size(subsets)


def fingerprints(docs: DataFrame, *, rarest: float = 0.005, commonest: float = 0.1) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every document, its
    text with the second half replaced by the beginning of the next document, and the next document."""
    known = keep(lexicon(docs, rarest, commonest))
    if known.count() <= MAX_BROADCAST:
        known = F.broadcast(known)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.when(F.col("next_text").isNull(), F.col("text")).otherwise(
        F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    rows = (beside_next(docs).withColumn("n_chars", F.char_length("text")).withColumn("edited", edited)
            .select("b", "place", "ghost", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
                    F.xxhash64("text").alias("whole"), F.xxhash64("edited").alias("whole_edited"),
                    F.explode(F.array(F.struct(F.lit(False).alias("of_edited"), terms(F.col("text")).alias("t")),
                                      F.struct(F.lit(True).alias("of_edited"), terms(F.col("edited")).alias("t")))).alias("x"))
            .select("b", "place", "ghost", "doc_id", "n_chars", "sha", "whole", "whole_edited", "x.of_edited", F.explode_outer("x.t").alias("term")))
    hits = rows.join(known.withColumn("listed", F.lit(True)), "term", "left")
    # a row per document and text is enough to carry those without a lexicon term
    facts = [F.first(c).alias(c) for c in ("ghost", "doc_id", "n_chars", "sha", "whole", "whole_edited")]
    inside = [F.collect_list(F.when(F.col("listed") & (F.col("of_edited") == e), F.col("term"))).alias(n) for n, e in (("own", False), ("other", True))]
    met = hits.groupBy("b", "place").agg(*facts, *inside)
    coded = met.select("b", "place", "ghost", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
                       _components(F.col("own"), F.col("whole")).alias("a"), _components(F.col("other"), F.col("whole_edited")).alias("e"))
    following = F.when(F.col("doc_id").isNotNull(), F.lead("a").over(Window.partitionBy("b").orderBy("place")))
    return (coded.withColumn("z", following).where("NOT ghost")
            .select("doc_id", "n_chars", "edited_sha256", _printed(F.col("a")).alias("fingerprint"), _printed(F.col("e")).alias("edited_fingerprint"),
                    likeness(F.col("a"), F.col("e")).alias("near_edited"), F.coalesce(likeness(F.col("a"), F.col("z")), F.lit(0.0)).alias("near_next")))


def op7_imatch_fingerprints(spark, folder):
    return fingerprints(table(spark, folder, "documents"))
