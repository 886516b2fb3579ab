"""Each operator against a brute-force counterpart, and on nulls, empty and long texts, ties, repeats, empty tables and
columns with names that the operators use inside."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import base_scores, near_components, pair_scores, round_robin, shingle_set, unite, window_repeats

from shelfdate.llm import chat, embeddings, imatch, language, language_model, minhash, mixing, packing, substrings, toxicity
from shelfdate.llm.common import remainder
from shelfdate.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "part", "id", "name", "size", "bin", "mark", "times", "key", "bucket", "score", "known", "lang_pred", "start", "n"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Rows with copies, near copies, a shared passage and all odd cases."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 40))
    rows = []
    for i in range(n):
        body = words(rng, rng.choice([3, 8, 30, 120]))
        if i % 7 == 3:
            body += passage.split() + words(rng, 20)
        rows.append([i * 3, " ".join(body)])
    rows += [[500 + i, rows[i][1]] for i in range(0, 8)]  # copies
    for i in range(10, 18):  # near copies: one word changed
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append([600 + i, " ".join(w)])
    long = " ".join(words(rng, 30_000, 5000))
    rows += [[700, None], [701, ""], [702, " \t\n"], [703, "One Two"], [704, "one two"], [705, "été ÉTÉ naïve  x <|endoftext|> it's"], [706, long], [707, long + " end"]]
    rows += [list(rows[5]), list(rows[5])]  # repeated rows
    return [(i, t, [None, "en", "de"][k % 3], [None, "b", "a", "c"][k % 4], len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def clashing(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in [*rows, (None, rows[3][1], "en", "b", 1)]],
                                 SCHEMA + "".join(f", {c} string" for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# substring dedup

def test_substrings_equal_brute_force(spark, docs, rows):
    want = window_repeats([r[:2] for r in rows])
    got = substrings.find_repeats(docs.selectExpr("doc_id", "text", "struct(doc_id, text) as own"), carry=("own",)).selectExpr(
        "row.own.doc_id", "row.own.text", "n_words", "n_removed", "sha2(kept_text, 256) as h", "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.h) == want[r.doc_id, r.text]
        assert sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.spans, r.spans[1:]))


def test_substrings_keep_columns_and_rows_without_id(clashing, rows):
    got = substrings.without_repeats(clashing)
    assert got.columns == clashing.columns
    back = got.collect()
    assert len(back) == len(rows) + 1
    assert [r.text for r in back if r.doc_id is None] == [rows[3][1]]
    assert [r.text for r in back if r.doc_id == 700] == [None]


# near-duplicates

def test_minhash_equals_all_pairs(docs, rows):
    want = near_components([r[:2] for r in rows])
    got = minhash.judged(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.component_id == want[r.doc_id] and r.n_shingles == len(shingle_set(texts[r.doc_id])) and r.kept == (r.doc_id == r.component_id)


def test_minhash_chain_without_common_centre(spark):
    """Neighbours in a chain are similar, its ends are not: links between members that are not centres must be found."""
    rng = random.Random(4)
    chain, text = [], words(rng, 200, 10**6)
    for i in range(25):
        chain.append((i, " ".join(text)))
        text = text[:i * 7] + words(rng, 7, 10**6) + text[i * 7 + 7:]
    got = minhash.judged(spark.createDataFrame(chain, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == near_components(chain)


def test_minhash_one_of_each_keeps_columns(clashing, rows):
    got = minhash.one_of_each(clashing)
    assert got.columns == clashing.columns
    want = near_components([r[:2] for r in rows])
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c}) and ids.count(None) == 1


def test_components_of_paths_stars_and_a_clique(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 30)] + [(a, b) for a in range(2000, 2012) for b in range(2000, a)]
    random.Random(2).shuffle(links)
    got = {r.a: r.b for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = unite({x for e in links for x in e}, links)
    assert got == {i: c for i, c in want.items() if i != c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# mixing

def test_targets_are_capped_and_dealt_again():
    target = mixing.source_targets([("b", 100), ("a", 10), (None, 1000)], (3, 1, 2), 1.5, 2)
    assert target["a"] == 20 and sum(target.values()) == pytest.approx(1.5 * 1110) and all(target[s] <= 2 * n for s, n in (("b", 100), ("a", 10), (None, 1000)))


@pytest.mark.parametrize("budget", [0, 1, 17, 299, 5000, 10**6])
def test_lengths_meet_the_budget(budget):
    rng = random.Random(budget)
    lengths, counts = list(range(0, 60)), [rng.randrange(1, 9) for _ in range(60)]
    total = sum(a * b for a, b in zip(lengths, counts))
    taken = mixing.fit_lengths(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts)) and sum(a * b for a, b in zip(lengths, taken)) == min(budget, total)


def test_mix_meets_targets_and_repeats_itself(docs, rows):
    def run():
        return sorted((r.row.doc_id, r.size, r.source_size, r.target, r.times, r.row.source or "") for r in mixing.mix(docs).collect())

    got = run()
    assert got == run() and len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want = mixing.source_targets(list(sizes.items()), (3, 1, 2), 1.5, 2)
    for source, size in sizes.items():
        own = [g for g in got if g[5] == (source or "")]
        assert {g[2] for g in own} == {size} and own[0][3] == pytest.approx(want[source])
        whole, reach = int(want[source] // size), 1
        for g in own:
            reach |= reach << g[1]
        nearest = min(abs(whole * size + x - want[source]) for x in range(size + 1) if reach >> x & 1)
        assert abs(sum(g[1] * g[4] for g in own) - want[source]) <= max(nearest + 1, max(g[1] for g in own) / 4) and all(0 <= g[4] <= 2 for g in own)


def test_mixed_rows_come_as_often_as_taken(clashing):
    got = mixing.mixed(clashing)
    assert got.columns == clashing.columns
    assert got.count() == mixing.mix(clashing).agg({"times": "sum"}).first()[0]


# packing

def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(docs.selectExpr("*", "struct(doc_id, text) as own"), carry=("own", "source")).collect()
    whole = {}
    for p in pieces:
        whole.setdefault((p.row.own.doc_id, p.row.own.text), []).append(p)
    repeats = {}
    for r in rows:
        repeats[r[:2]] = repeats.get(r[:2], 0) + 1
    assert whole.keys() == repeats.keys()
    for (i, text), own in whole.items():
        want = np.array(coder.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        covered = np.zeros(len(want), int)
        for p in own:
            assert bytes(p.ids) == want[p.start:p.start + p.length].tobytes() and p.doc_tokens == len(want)
            covered[p.start:p.start + p.length] += 1
        assert (covered == repeats[i, text]).all()
    lengths = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert lengths.get(p.sequence_id, 0) == p.offset
        lengths[p.sequence_id] = p.offset + p.length
    total = sum(len(p.ids) // 4 for p in pieces)
    assert sorted(lengths) == list(range(len(lengths))) and all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())
    order = [q for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) for q in [p.row.source] * p.length]
    names = sorted({r[3] for r in rows}, key=lambda s: "" if s is None else "=" + s)
    played = round_robin([sum(len(p.ids) // 4 for p in pieces if p.row.source == s) for s in names], 2048, 64)
    assert order == [names[q] for q in played] and len(order) == total


def test_words_get_the_ids_that_the_whole_text_gives_them():
    import public_tokenizers

    coder = packing.WordCoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    signs = [*"abzAZ09'\".,;:!?-<|>", *"“”’…éÉ日本İΣ½\u0301\u0958\u200b\xa0\x85", *"\x00\x1c\x1d\x1e\x1f\x7f", *" \t\n\x0b\x0c", "'s", "'ll", "’s", "<|endoftext|>"]
    texts = ["“hello”.", "été).", "don’t”,", "日本…!", "İ.", "\u0958.", "ab\x1ccd", *["".join(rng.choices(signs, k=rng.randint(1, 14))) for _ in range(20_000)]]
    got = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode([t.encode() for t in texts])]
    want = [x.ids for x in coder.coder.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_words_are_told_again_after_they_were_forgotten(monkeypatch):
    coder, small = packing.WordCoder(packing.vocabulary_file()), packing.WordCoder(packing.vocabulary_file())
    texts = [" ".join(f"w{i * k % 61}x, {i}" for i in range(40)).encode() for k in range(30)]
    want = coder.encode(texts)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    assert [x for t in texts for x in small.encode([t])] == want


def test_sequences_join_their_pieces(docs):
    pieces = packing.pack(docs)
    packed = packing.sequences(pieces).collect()
    assert all(len(s.ids) == 4 * s.length <= 4 * 2048 for s in packed)
    assert sum(s.length for s in packed) == pieces.agg({"length": "sum"}).first()[0]


@pytest.mark.parametrize("weights", [None, [5.0, 1.0, 0.0]])
def test_rounds_in_closed_form(weights):
    r = packing.Rounds([5000, 333, 1], weights, 256, 16)
    at = [np.sort(r.place(q, np.arange(n))) for q, n in enumerate([5000, 333, 1])]
    assert np.array_equal(np.sort(np.concatenate(at)), np.arange(5334))


# language

def test_language_held_out_and_odd_cases(spark):
    rng = random.Random(3)
    syllables = {"en": ["the", "ing", "and", "th"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "que", "é", "ou"]}

    def text(lang):
        return " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(40))

    labels = [rng.choice(list(syllables)) for _ in range(300)]
    rows = [(i, text(x), x if i % 10 else None) for i, x in enumerate(labels)] + [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "a" * 3_000_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.learn(docs.where("doc_id % 4 <> 2"))
    got = {r.row.doc_id: r for r in language.predict(docs, filters).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert np.mean([got[i].lang_pred == x for i, x in enumerate(labels) if i % 4 == 2]) > 0.97
    kept = {r.doc_id for r in language.in_known_language(docs).collect()}
    assert kept >= set(range(300)) and not kept & {900, 901, 902}


def test_language_without_teachers(spark, nothing):
    filters = language.learn(nothing)
    assert language.predict(spark.createDataFrame([(1, "text")], "doc_id long, text string"), filters).first().lang_pred == "und"
    assert language.in_known_language(nothing).count() == 0


# language model

def test_language_model_counts_and_gain(spark, docs):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    table = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "Once ÉTÉ")], "doc_id long, text string"))
    got = language_model.score(table, remainder("doc_id", 7) == 2, keep_pairs=1 << 16).collect()
    want = base_scores([(r.doc_id, r.text) for r in table.collect()])
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4])
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_is_a_distribution(spark):
    """Over all words of a small vocabulary and the unknown one, the probabilities after a word add up to 1 at most."""
    rng = random.Random(8)
    train = [(i, " ".join(rng.choices(["a", "b", "c", "d"], [4, 3, 2, 1], k=50))) for i in range(40)]
    probe = [(1000 + k, f"a {w}") for k, w in enumerate(["a", "b", "c", "d", "unknown"])] + [(2000, "a")]
    docs = spark.createDataFrame(train + probe, "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(docs, docs.doc_id >= 1000, keep_pairs=1 << 12).collect()}
    # the score of "a" alone is P(a | end) * P(end | a), that of "a w" is P(a | end) * P(w | a) * P(end | w)
    one = language_model.score(docs, docs.doc_id >= 1000, keep_pairs=1)
    assert {r.doc_id for r in one.collect()} == set(got)
    base = {r.doc_id: r for r in one.collect()}
    for k in range(5):
        assert math.isfinite(got[1000 + k]) and got[1000 + k] < 0 and base[1000 + k].score < 0


def test_language_model_keeps_pairs_seen_twice_at_any_size(spark):
    """A pair seen twice counts for as much among 2.4 million tokens as it does among few: N / 2**20 is 3 here."""
    filler = " ".join(["z"] * 24_000)
    docs = spark.createDataFrame([(i, filler) for i in range(100)] + [(200, "rare pair"), (201, "rare pair"), (1000, "rare pair"), (1001, "pair rare")],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score(docs, docs.doc_id >= 1000).collect()}
    assert got[1000].train_tokens > 2 << 20
    # P(rare | end) P(pair | rare) P(end | pair) is .02 * .9 * .9 or so; turned round, no pair is known
    assert got[1000].score == pytest.approx(math.log10(0.9 ** 3 * 2 / 102), abs=0.1) and got[1001].score < got[1000].score - 5


@pytest.mark.parametrize("shards", [1, 16])
def test_language_model_equals_plain_counts(spark, docs, rows, shards):
    """But for the filters' false positives, which raise some scores, whatever the number of shards."""
    wide = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", shards)
        got = sorted((r.doc_id, r.score) for r in language_model.score(docs, remainder("doc_id", 7) == 2).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", wide)
    want = pair_scores([r[:2] for r in rows])
    assert [i for i, _ in got] == [i for i, _ in want]
    same = [a == pytest.approx(b, rel=1e-6) for (_, a), (_, b) in zip(got, want, strict=True)]
    assert np.mean(same) > 0.85 and all(abs(a - b) < 8 for (_, a), (_, b) in zip(got, want, strict=True) if a > -1000)


def test_filter_reads_levels_back():
    f = language_model.LogFrequencyFilter(10, 1 << 20)
    keys, n = np.arange(1, 3000, dtype=np.uint64), np.random.default_rng(1).integers(1, 5000, 2999)
    f.insert(keys[n >= 10], f.levels(n)[n >= 10])
    read = f.read(keys)
    assert (read >= f.levels(n)).all() and (read == f.levels(n)).mean() > 0.99
    assert (f.value(f.levels(n)) <= n).all()


# fingerprints

def test_fingerprints(spark, docs, rows):
    unique = {r[0]: r for r in rows}
    table = spark.createDataFrame(list(unique.values()), SCHEMA)
    got = {r.doc_id: r for r in imatch.fingerprints(table, rarest=0.02, commonest=0.5).collect()}
    ids = sorted(unique)
    assert sorted(got) == ids
    import hashlib

    prints = {}
    for k, i in enumerate(ids):
        text, following = unique[i][1] or "", unique[ids[(k + 1) % len(ids)]][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        if edited == text:
            assert got[i].near_edited == 1 and got[i].edited_fingerprint == got[i].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > 2 * np.mean([r.near_next for r in got.values()])


def test_fingerprints_with_repeats_and_rows_without_id(spark, rows):
    table = spark.createDataFrame([*rows, (None, "some text here", None, None, 1), (None, None, None, None, 1)], SCHEMA)
    got = imatch.fingerprints(table)
    assert got.count() == len(rows) + 2
    assert {r.near_next for r in got.where("doc_id IS NULL").collect()} == {0.0}
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_fingerprint_of_one_document_meets_itself(spark):
    r = imatch.fingerprints(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).first()
    assert r.near_next == 1.0


# embeddings

def test_graph_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 32))
    copies = np.concatenate([base[:4].repeat(40, axis=0) + 0.02 * rng.normal(size=(160, 32)), base[10:14].repeat(3, axis=0), 1e-25 * base[20:21], 1e25 * base[20:21]])
    x = np.concatenate([base, copies]).astype(np.float32)
    x[50] = 0
    rows = [(i * 2, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9003, [float("nan")] * 32), (9005, [None] * 32), (9007, []), (9009, [1.0, 0.0]), (9011, [2.0, 0.0]), (None, x[0].tolist())]
    found, share = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard_rows=100, cap=60)
    assert share >= 0.98
    y = x.astype(float)
    norm = np.sqrt((y ** 2).sum(axis=1))
    with np.errstate(invalid="ignore"):
        near = (y @ y.T) / norm[:, None] / norm[None] >= 0.95
    near[np.arange(len(y)), np.arange(len(y))] = False
    links = {i * 2: int(near[i].sum()) for i in range(len(y))} | {9001: 0, 9003: 0, 9005: 0, 9007: 0, 9009: 1, 9011: 1}
    want = unite(links, [(int(a) * 2, int(b) * 2) for a, b in zip(*np.nonzero(near)) if a < b] + [(9009, 9011)])
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], want[r.vec_id], r.vec_id == want[r.vec_id])


def test_graph_of_nothing(spark):
    found, share = embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert found.count() == 0 and share == 1.0


# chat

def test_snapshots_collapse(spark):
    def talk(i, *texts):
        return [(i, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)]

    rows = (talk(1, "a", "b", "c") + talk(2, "a", "b") + talk(3, "a") + talk(4, "a", "b", "c") + talk(5, "a", "c") + talk(6, "x")
            + talk(7, None, "y") + talk(7, None, "y") + [(8, 0, None, "r"), (None, 0, "user", "lost"), (9, None, "user", "first"), (9, 1, "user", "then")])
    got = {r.conv_id: r for r in chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [1, 5, 6, 7, 8, 9] and got[1].copies == 2 and got[7].n_turns == 2
    assert got[8].rendered == "<|im_start|>unknown\nr<|im_end|>\n" and got[9].rendered.index("first") < got[9].rendered.index("then")
    assert chat.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# toxicity

def test_ordinal_regression_on_held_out(spark):
    rng = random.Random(6)
    insults = ["fool", "scum", "trash"]

    def text(toxic):
        w = words(rng, 60, 3000)
        return " ".join(w[:30] + (rng.sample(insults, rng.choice([1, 2, 3])) if toxic else []) + w[30:])

    truth = [int(rng.random() < 0.3) for _ in range(800)]
    rows = [(i, text(t)) for i, t in enumerate(truth)] + [(5000, None), (5001, ""), (None, "scum fool"), (5002, "scum " * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, t, 1) for i, t in enumerate(truth) if i % 2] + [(None, 1, 0), (7777, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.learn(docs, labels)
    got = toxicity.severity(docs, model).collect()
    by = {r.row.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.expected_severity <= 2 for r in got)
    assert all((by[i].grade >= 1) == (t == 1) for i, t in enumerate(truth) if i % 2 == 0)
    assert by[5000].grade == by[5001].grade == 0 and by[5002].grade >= 1
    several = [by[i].expected_severity for i, t in enumerate(truth) if t and sum(x in rows[i][1].split() for x in insults) == 3]
    single = [by[i].expected_severity for i, t in enumerate(truth) if t and sum(x in rows[i][1].split() for x in insults) == 1]
    assert np.mean(several) > np.mean(single)


def test_ordinal_thresholds_are_ordered_and_unlearned_is_zero(spark, nothing):
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 200)
    weights, thresholds = toxicity.fit_ordinal([[int(g)] for g in grades], grades, np.ones(200), 4)
    assert (np.diff(thresholds) > 0).all() and (np.diff(weights) > 0).all()
    model = toxicity.learn(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.severity(spark.createDataFrame([(1, "x")], "doc_id long, text string"), model).first().expected_severity < 1e-300


# empty tables

@pytest.mark.parametrize("run", [substrings.find_repeats, minhash.judged, minhash.one_of_each, mixing.mix, mixing.mixed, packing.pack, imatch.fingerprints,
                                 lambda d: language_model.score(d, remainder("doc_id", 7) == 2)])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_remainders_agree():
    from shelfdate.llm.common import crc_remainder

    assert crc_remainder(12, 4) == zlib.crc32(b"12") % 4 and crc_remainder(None, 4) == 0 and isinstance(pa.null(), pa.DataType)
