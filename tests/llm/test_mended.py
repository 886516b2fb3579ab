"""Cases that earlier versions got wrong: finite scores, doubles of any size, rare languages, an audit without evidence."""

import math
import random

import pytest
from brute import near_components

import corpus_pipeline
from shelfdate.llm import embeddings, language, language_model, mixing
from shelfdate.llm.common import keep


@pytest.mark.parametrize("texts", [["a b c"], ["a b", "c d", "e f", "g h", "i j", "k l", "m n", "o p"], ["a a a a"], ["", None]])
def test_scores_are_finite_however_few_words_repeat(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts), (900, "unheard words"), (901, None)], "doc_id long, text string")
    assert all(math.isfinite(r.score) and r.score <= 0 for r in language_model.score(docs, docs.doc_id >= 900).collect())


def test_vectors_of_any_size_link_by_direction(spark):
    rows = [(1, [3e300, 4e300]), (2, [3e300, 4e300]), (3, [3.0, 4.0]), (4, [3e-60, 4e-60]), (5, [4e-310, -3e-310]), (6, [4.0, -3.0]), (7, [0.0, 0.0]), (8, [float("inf"), 1.0]), (9, None)]
    found, share = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9)}
    assert share == 1.0


def test_audit_without_links_says_nothing(spark):
    rows = [(i, [1.0 if k == i else 0.0 for k in range(6)]) for i in range(6)]
    _, share = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert share is None


def speech(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_languages_with_two_teachers_are_known_and_kept(spark):
    rng = random.Random(2)
    german, spanish = ["ver", "sch", "ung", "keit", "en", "ich"], ["ción", "que", "los", "ado", "mente", "ella"]
    rows = [(i, speech(rng, german, 60), "de") for i in range(40)] + [(100 + i, speech(rng, spanish, 60), "es") for i in range(2)]
    docs = spark.createDataFrame(rows + [(200, speech(rng, spanish, 60), None), (201, speech(rng, german, 60), None), (202, "12 34", None)], "doc_id long, text string, lang string")
    told = {r.row.doc_id: r.lang_pred for r in language.predict(docs, language.learn(docs)).collect()}
    assert all(told[i] == "es" for i in (100, 101, 200)) and all(told[i] == "de" for i in (0, 39, 201)) and told[202] == "und"
    kept = {r.doc_id for r in language.in_known_language(docs).collect()}
    assert kept == {i for i, _, _ in rows} | {200, 201}


def test_copies_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(i, "immer der gleiche text", "de") for i in range(4000)], "doc_id long, text string, lang string")
    filters = language.learn(docs, sample_per_language=50)
    assert filters.languages == ["de"] and filters.slots.any()


CLASHING = ["row", "part", "id", "bin", "mark", "times", "key", "bucket", "score", "known", "start", "n"]


def test_pipeline_takes_null_ids_clashing_columns_and_empty_tables(spark):
    rng = random.Random(8)
    rows = [(i, speech(rng, ["ver", "sch", "ung", "en"], 50), "de", "ab"[i % 2], 0) for i in range(30)]
    rows += [(None, rows[3][1], "de", "a", 0), (None, None, None, None, 0), (50, rows[4][1], "de", None, 0), (51, "", None, "a", 0), rows[5]]
    docs = spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASHING))
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = keep(stage(spark, now, ""))
            assert now.columns == docs.columns, name
            if name == "near_dedup" and table is docs:
                texts = [r.text for r in now.where("doc_id IS NOT NULL").collect()]
                assert len(texts) == len(set(texts)) == 30
        pieces = corpus_pipeline.packing(spark, now, "").collect()
        assert bool(pieces) == (table is docs)


def test_near_dedup_stage_takes_pairs_from_eighty_percent(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other = list(base)
    other[20] = other[60] = other[100] = other[140] = "changed"  # 176 of 216 shingles in common
    rows = [(1, " ".join(base), "en", "a", 0), (2, " ".join(other), "en", "a", 0)]
    assert near_components([(i, t) for i, t, *_ in rows], percent=80) == {1: 1, 2: 1} and near_components([(i, t) for i, t, *_ in rows]) == {1: 1, 2: 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_mix_spreads_rows_without_id_and_repeats_itself(spark):
    rows = [(None, f"a{i} b{i}", "hot") for i in range(600)] + [(7, f"c{i} d{i} e{i}", "hot") for i in range(300)] + [(i, "x y", "cold") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for width in (3, 7):
        mixed = mixing.mix(docs.repartition(width), share=0.6)
        seen.append(sorted((r.row.doc_id or -1, r.row.text, r.row.source, r.times) for r in mixed.collect()))
    assert seen[0] == seen[1] and len(seen[0]) == len(rows)
    taken = {s: sum(len(text.split()) * n for _, text, source, n in seen[0] if source == s) for s in ("hot", "cold")}
    # sources in order weigh 3 (cold, stopped at twice its size) and 1 (hot, the rest)
    assert taken == {"cold": 200, "hot": round(0.6 * (600 * 2 + 300 * 3 + 100)) - 200}
    chosen = {text for doc_id, text, _, n in seen[0] if doc_id == 7 and n}
    assert 0 < len(chosen) < 300
