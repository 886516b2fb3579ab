"""Prefix trie, ranked search and main text against brute force, and on nulls, empty and long values, ties, repeats, empty
tables and clashing columns."""

import itertools
import random
import zlib

import numpy as np
import pytest
from brute import best_documents, trie_nodes

from shelfdate.llm import main_text, prefix_trie, ranked_search

TURNS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"


# prefix trie

def logged(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(-5, 0), 250, 251]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, None if t == 0 and c % 3 == 0 else t, rng.choice(["user", None]), rng.choice(["a", "b", "", None, "ü👍"])))
    rows += [(7, 50 + t, "user", f"turn {t}") for t in range(300)]
    rows += [(60 + c, t, "user", "the same") for c in range(30) for t in range(3)]  # copies
    rows += [(None, 0, "user", "nobody's"), rows[4], rows[4]]
    return rows


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            import hashlib
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("shard_turns,fan_bits", [(10**6, 8), (1, 1), (40, 1), (7, 8)])
def test_trie_is_that_of_all_prefixes(spark, shard_turns, fan_bits):
    rows = logged()
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS + ", digest string, n long, path string").repartition(3)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.digested(turns)), shard_turns=shard_turns, fan_bits=fan_bits)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    expected = trie_nodes(plain_rebuilt(rows))
    assert any(d == 0 for _, d, *_ in expected) and max(r[1] for r in expected) > 200
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == expected


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    def nodes(rows):
        return [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.digested(spark.createDataFrame(rows, TURNS)))).collect()]

    assert nodes([]) == [] and nodes([(None, 1, "user", "x")]) == []
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # no base: its one turn is replaced by none
    (root,) = nodes([(short, 0, "user", "x")])
    assert root[:7] == (short, 0, None, 1, 0, 1, 0)


def test_ternary_tree_holds_its_sequences_and_is_balanced():
    tree = prefix_trie.TernaryTree()
    places = tree.insert_median_first([[i] for i in range(1000)])
    assert len(set(places)) == 1000 and len(tree.turn) == 1001

    def height(at):
        return 0 if not at else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.equal[0]) == 10
    assert tree.path([5]) == [0, places[5]]


# ranked search

def library(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "日本", "x1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 20, 80])))) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, ""), (2002, " .,-\x00 "), (None, rows[4][1]), rows[7], rows[7], (2003, " ".join(rng.choices(vocabulary, k=20_000)))]
    return rows


QUERIES = [(1, "w1 w1 W50, w3-w2"), (2, "été Été w59"), (3, None), (4, "..."), (5, "unheard of"), (6, " ".join(f"w{i}" for i in range(60))), (None, "w8 日本"), (1, "x1")]


@pytest.mark.parametrize("block_chars,shard", [(8_000_000, 32_768), (20, 50)])
def test_search_ranks_like_scoring_everything(spark, monkeypatch, block_chars, shard):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", shard)
    rows = library()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, terms long").repartition(4)
    asked = spark.createDataFrame([(*q, 1) for q in QUERIES], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked_search.search(docs, asked, block_chars=block_chars).select("item_id", "rank", "doc_id", "score").collect()]
    expected = [(item, r, i, s) for item, text in QUERIES for r, (i, s) in enumerate(best_documents(rows, text), 1)]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_limited_accumulators_are_exact_and_fewer():
    rng = np.random.default_rng(1)
    lists = []
    for df, most in [(30, 900), (400, 60), (3000, 5), (9000, 2)]:
        lists.append((np.sort(rng.choice(10_000, df, replace=False)), rng.integers(1, most + 1, df)))
    plain = np.zeros(10_000, np.int64)
    for places, adds in lists:
        plain[places] += adds
    places, scores = ranked_search.term_at_a_time(lists, 10_000, 10)
    assert (plain[places] == scores).all() and len(places) < np.count_nonzero(plain) / 4
    assert sorted(scores)[-10:] == sorted(plain)[-10:]


def test_search_of_empty_tables(spark):
    docs, asked = spark.createDataFrame(library(), "doc_id long, text string"), spark.createDataFrame(QUERIES, "item_id long, text string")
    assert ranked_search.search(docs.limit(0), asked).count() == 0
    assert ranked_search.search(docs, asked.limit(0)).count() == 0
    assert ranked_search.search(docs.where("doc_id = 2002"), asked).count() == 0


# main text

SAID = "This is a sentence of the article, and it goes on for a while. Then there is another one, as ever."


def article(i, extra=""):
    return (f"<html><head><title>T{i}</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav>"
            f"<article><h1>Title number {i}</h1><p>{SAID} Page {i}.</p><p>{SAID}{extra}</p></article><div class='ad'>Buy now.</div><footer>&copy; site &middot; all rights</footer></body></html>")


@pytest.fixture(scope="module")
def field():
    return main_text.fit(main_text.labelled_pages([article(i) for i in range(80)]))


def test_articles_come_out_whole(spark, field):
    long = " word" * 200_000
    rows = [(i, f"u{i}", article(i)) for i in range(5)] + [
        (5, None, None), (6, "u", ""), (7, "u", "   "), (8, "u", "<!-- never closed <p>x</p>"), (9, "u", article(9, long)), (None, "u", article(1)), (1, "u1", article(1)),
        (10, "u", "<div>" * 20_000 + "x"), (11, "u", "<p class='" * 3), (12, "u", "</p></div>" * 10)]
    got = main_text.extract(spark.createDataFrame([(*r, "x", 3) for r in rows], PAGES + ", text string, n_chars long").repartition(3), field)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    told = {(r.page_id, r.url): r for r in got.collect()}
    assert got.count() == len(rows)
    for i in range(5):
        assert told[i, f"u{i}"].text == f"Title number {i} {SAID} Page {i}. {SAID}"
    assert all(told[i, u].text == "" for i, u in [(5, None), (6, "u"), (7, "u"), (8, "u"), (12, "u")])
    assert told[9, "u"].text == f"Title number 9 {SAID} Page 9. {SAID}{long}" and told[9, "u"].n_chars == len(told[9, "u"].text)
    assert told[None, "u"].text == told[1, "u1"].text


def test_extract_and_fit_on_an_empty_table(spark):
    nothing = spark.createDataFrame([], PAGES)
    assert main_text.extract(nothing, main_text.fit_on(nothing)).count() == 0


def test_leaf_blocks_follow_the_markup():
    def told(page):
        states = main_text.States()
        return [(states.tag[s], t, a) for s, t, a in main_text.leaf_blocks(page, states)]

    assert told("a &lt;b&gt; &amp;amp; <b>c</b>d\n\t e<br>f") == [("#page", "a <b> &amp; cd e f", 0)]
    assert told("<p>one<p>two <a href=x>three</a></div>") == [("p", "one", 0), ("p", "two three", 5)]
    assert told("<ul><li>a<ul><li>b</ul>c<li>d</ul>e") == [("li", "a", 0), ("li", "b", 0), ("li", "c", 0), ("li", "d", 0), ("#page", "e", 0)]
    assert told("1 < 2 <p title='a>b'>x</p><style>p{}</style><textarea>no</textarea>y<!DOCTYPE z>") == [("#page", "1 < 2", 0), ("p", "x", 0), ("#page", "y", 0)]
    assert told("<SCRIPT>if (a</b) '</scripting>'</SCRIPT >z") == [("#page", "z", 0)]
    assert told("<h2>t</h3><td>u  v") == [("h2", "t", 0), ("td", "u v", 0)]


def test_viterbi_and_marginals_by_enumeration():
    rng = np.random.default_rng(4)
    emission, links, start, stop = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=2)
    lengths = [5, 3, 1]
    there = np.arange(5) < np.array(lengths)[:, None]
    z, main, both, first, last = main_text.forward_backward(emission * there, there, links, start, stop)
    pairs, firsts, lasts = np.zeros((2, 2)), np.zeros(2), np.zeros(2)
    for p, n in enumerate(lengths):
        scores = {y: start[y[0]] + stop[y[-1]] + sum(emission[p, t] * y[t] for t in range(n)) + sum(links[a, b] for a, b in zip(y, y[1:]))
                  for y in itertools.product((0, 1), repeat=n)}
        whole = np.log(sum(np.exp(s) for s in scores.values()))
        assert whole == pytest.approx(z[p])
        for y, s in scores.items():
            w = np.exp(s - whole)
            firsts[y[0]] += w
            lasts[y[-1]] += w
            for a, b in zip(y, y[1:]):
                pairs[a, b] += w
        for t in range(n):
            assert main[p, t] == pytest.approx(sum(np.exp(s - whole) for y, s in scores.items() if y[t]))
        field = main_text.Field({}, links.tolist(), start.tolist(), stop.tolist())
        assert tuple(field.labels(emission[p, :n].tolist())) == max(scores, key=scores.get)
    assert np.allclose(both, pairs) and np.allclose(first, firsts) and np.allclose(last, lasts)


def prose(rng, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))).capitalize() + "." for _ in range(300)]


def test_held_out_layouts():
    """Pages of layouts drawn with another seed and with words that no page of the sample has."""
    rng = random.Random(11)
    taught = prose(rng, "this that article, goes. on and then. there was another one of those, as ever".split())
    pages = [article(i).replace(SAID, "</p><p>".join(rng.sample(taught, 3))) for i in range(200)]
    field = main_text.fit(main_text.labelled_pages(pages))
    pool = prose(rng, "lorem ipsum dolor sit amet, consectetur adipiscing. elit sed do".split())
    states, right, found, main = main_text.States(), 0, 0, 0
    reader = main_text.Reader(field)
    for _ in range(200):
        page = main_text.laid_out(rng, rng.sample(pool, rng.randint(3, 8)), pool)
        gold = [t for s, t, _ in main_text.leaf_blocks(page, states) if main_text.given_label(states, s)]
        told = reader.main_text(page)
        right += sum(len(t) for t in gold if t in told)
        found, main = found + len(told), main + sum(map(len, gold))
    assert right / main > 0.97 and right / found > 0.95
