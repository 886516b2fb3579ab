"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between the starts and ends of block-level elements. A block is known by
the tags and the class, id and role words of its ancestors, and by its text (length, sentence marks, share of links and
digits, place in the page). The field has two labels, main text or not; its weights are learned by maximum likelihood
(forward-backward, Adam, L2) and Viterbi's best labels decide.

Labelled pages: of a sample of at most `SAMPLE` pages (smallest hashes of id, url and html, at most `SAMPLE_CHARS` long), those
that mark their main part themselves (article, main, role main) are labelled by it, less the menus, notes, forms and
comments inside. The paragraphs of the sample also fill pages of the layouts below, with and without such tags, whose
parts are labelled by the layout. So pages whose markup says nothing plain are judged by what they share with these.

Text of a block: character references decoded once, every run of white space one space, trimmed. Script, style, title,
comments and other unseen content are no text. Blocks are joined by one space in page order.

Defined cases: null or empty html, and pages without text, give an empty text; pages are read one by one, so repeated
rows give repeated results and any order of rows the same; unclosed elements end with their parents, stray end tags are
ignored, an unclosed comment, script or tag goes to the end of the page. An empty table gives an empty result. Columns
besides page_id, url and html are not read. A page is parsed in one task, in time that grows with its length.
"""

from __future__ import annotations

import html as markup
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table

SAMPLE, SAMPLE_CHARS = 400, 100_000
EPOCHS, RATE, RIDGE = 80, 0.15, 1e-3
STATES = 50_000

# What HTML says about its elements.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("iframe noembed noframes noscript script style template textarea title".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end an open element of the same kind, up to the container named.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KEEPS_PARAGRAPH = frozenset("button caption html object table td th".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
NAMED = frozenset(("class", "id", "role"))
#: Elements whose content is not an article's own text, and words that say so.
ASIDE_TAGS = frozenset("nav aside footer form button select fieldset dialog".split())
ASIDE_WORDS = frozenset("comment comments respond advert advertisement sponsored cookie newsletter breadcrumb breadcrumbs".split())


class States:
    """Open elements by number: an element with the same words in the same place is the same state. 0 is the page.
    told: what its tag, its words and its ancestors' tell; only features in `known`, if given."""

    def __init__(self, known=None):
        self.known, self.number, self.parent, self.tag, self.words, self.label = known, {}, [-1], ["#page"], [()], [None]
        self.told = [frozenset()]

    def of(self, parent: int, tag: str, words: tuple, label: str | None) -> int:
        key = parent, tag, words, label
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.words.append(words)
            self.label.append(label if label is not None else self.label[parent])
            own, above = {f"in {tag}", *(f"word {w.removesuffix('s')}" for w in words)}, self.told[parent]
            if self.known is not None:
                own &= self.known
            self.told.append(above if own <= above else above | own)
        return at


def _attributes(page: str, at: int) -> tuple[tuple, str | None, int]:
    """(words of class, id and role, value of data-label, end) of the tag whose name ends at `at`."""
    words, label = (), None
    while True:
        found = ATTRIBUTE.match(page, at)
        if not found:
            end = page.find(">", at)
            return words, label, (len(page) if end < 0 else end + 1)
        name = found[1].lower()
        if name in NAMED:
            words += tuple(w.lower() for w in WORDS.findall(markup.unescape(found[2] or found[3] or found[4] or "")))
        elif name in ("hidden", "aria-hidden"):
            words += ("hidden",)
        elif name == "data-label":
            label = found[2]
        at = found.end()


def leaf_blocks(page: str, states: States) -> list[tuple[int, str, int]]:
    """(state, text, characters of links) of the page's leaf blocks, in page order."""
    blocks, parts, stack, at, in_link, linked, opened = [], [], [0], 0, 0, 0, Counter()

    def close():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((stack[-1], text, min(linked, len(text))))
        parts, linked = [], 0

    def leave(depth: int):
        nonlocal in_link
        for state in stack[depth:]:
            opened[states.tag[state]] -= 1
            in_link -= states.tag[state] == "a"
        del stack[depth:]

    def say(piece: str):
        nonlocal linked
        parts.append(piece)
        if in_link:
            linked += len(piece)

    size = len(page)
    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            sign = size
        if sign > at:
            said = page[at:sign]
            say(markup.unescape(said) if "&" in said else said)
        if sign == size:
            break
        found = TAG.match(page, sign)
        if not found:
            if page.startswith("<!--", sign):
                end = page.find("-->", sign + 4)
                at = size if end < 0 else end + 3
            elif page.startswith(("<!", "<?", "</"), sign):
                end = page.find(">", sign)
                at = size if end < 0 else end + 1
            else:
                say("<")
                at = sign + 1
            continue
        tag = found[2].lower()
        words, label, at = _attributes(page, found.end())
        if found[1]:
            if tag in BLOCKS:
                close()
            elif tag == "br":
                say(" ")
            ends = HEADINGS if tag in HEADINGS else (tag,)
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                if states.tag[stack[depth]] in ends:
                    leave(depth)
                    break
                if tag not in BLOCKS and states.tag[stack[depth]] in BLOCKS:
                    break  # an inline end tag does not leave the block
            continue
        if tag in UNSEEN:
            at = _raw_end(page, at, tag)
            continue
        if tag in BLOCKS:
            close()
            ends, until = SIBLINGS.get(tag, ({"p"}, KEEPS_PARAGRAPH))
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                if states.tag[stack[depth]] in ends:
                    leave(depth)
                    break
                if states.tag[stack[depth]] in until:
                    break
        if tag in VOID:
            say(" ")
            continue
        if tag in BLOCKS or tag == "a" or label is not None:
            stack.append(states.of(stack[-1], tag, words, label))
            opened[tag] += 1
            in_link += tag == "a"
    close()
    return blocks


def _raw_end(page: str, at: int, tag: str) -> int:
    """Behind the end tag of an element whose content is not markup."""
    found = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(page, at)
    return found.end() if found else len(page)


def state_features(states: States, at: int) -> frozenset[str]:
    """Own tag, parent's tag, and all tags and words of the ancestors."""
    while states.tag[at] == "a" and states.parent[at] >= 0:  # a link does not make a block
        at = states.parent[at]
    return states.told[at] | {f"leaf {states.tag[at]}", f"under {states.tag[states.parent[at]]}" if at else "under nothing"}


def text_features(text: str, linked: int, i: int, n: int) -> tuple[str, ...]:
    size = len(text)
    spaces = text.count(" ")
    stops, commas = text.count(". ") + text.count("? ") + text.count("! "), text.count(",")
    return (f"length {(spaces + 1).bit_length()}", f"links {4 * linked // size}", f"stops {min(stops, 5)}", f"commas {min(commas, 5)}",
            "closed" if text[-1] in ".!?…:;\"'”’)»。" else "open", f"long words {min(12, size // (spaces + 1))}",
            "small start" if text[0].islower() else "no small start", "marked" if "©" in text or "|" in text or "·" in text or "»" in text else "unmarked",
            f"place {10 * i // n}", "first" if i == 0 else "last" if i == n - 1 else "inner", "always")


def forward_backward(emission: np.ndarray, there: np.ndarray, links: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Log-likelihood terms of a batch of pages: (log Z, marginals of label 1, expected counts of label pairs, of first and of
    last labels). emission: pages x blocks, for label 1 (label 0 has 0); there: which blocks exist, first ones first."""
    pages, width = emission.shape
    scores = np.zeros((pages, width, 2))
    scores[:, :, 1] = emission
    last = there.sum(axis=1) - 1
    forward, backward = np.zeros((pages, width, 2)), np.zeros((pages, width, 2))
    forward[:, 0] = scores[:, 0] + start
    for t in range(1, width):
        forward[:, t] = np.logaddexp(forward[:, t - 1, 0, None] + links[0], forward[:, t - 1, 1, None] + links[1]) + scores[:, t]
    for t in range(width - 1, -1, -1):
        if t + 1 < width:
            ahead = scores[:, t + 1] + backward[:, t + 1]
            onward = np.logaddexp(links[:, 0] + ahead[:, 0, None], links[:, 1] + ahead[:, 1, None])
        else:
            onward = np.zeros((pages, 2))
        backward[:, t] = np.where((last == t)[:, None], stop, onward)
    end = forward[np.arange(pages), last] + stop
    z = np.logaddexp(end[:, 0], end[:, 1])
    own = np.exp(forward + backward - z[:, None, None]) * there[:, :, None]
    both = np.exp(forward[:, :-1, :, None] + links + (scores[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
    return z, own[:, :, 1], both.sum(axis=(0, 1)), own[:, 0].sum(axis=0), own[np.arange(pages), last].sum(axis=0)


class Field:
    """Weights by feature; links[a][b] from label a to b; start and stop by label."""

    def __init__(self, weight: dict[str, float], links, start, stop):
        self.weight, self.links, self.start, self.stop = weight, links, start, stop

    def labels(self, emission: list[float]) -> list[int]:
        """Viterbi: the best labels; of equal ones, 0 at the last block in question."""
        (aa, ab), (ba, bb) = self.links
        none, main = self.start[0], self.start[1] + emission[0]
        back = []
        for e in emission[1:]:
            to_none, to_main = none + aa >= main + ba, none + ab >= main + bb
            back.append((0 if to_none else 1, 0 if to_main else 1))
            none, main = (none + aa if to_none else main + ba), (none + ab if to_main else main + bb) + e
        label = 0 if none + self.stop[0] >= main + self.stop[1] else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list, list[int]]], *, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE) -> Field:
    """pages: per page the features of its blocks and their labels."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for blocks, _ in pages for told in blocks for f in told})
    number = {f: i for i, f in enumerate(names)}
    width = max((len(b) for b, _ in pages), default=1)
    there = np.zeros((len(pages), width), bool)
    gold = np.zeros((len(pages), width), np.int64)
    cell, feature = [], []
    for p, (blocks, labels) in enumerate(pages):
        there[p, :len(blocks)] = True
        gold[p, :len(blocks)] = labels
        for t, told in enumerate(blocks):
            cell += [p * width + t] * len(told)
            feature += [number[f] for f in told]
    cell, feature = np.array(cell, np.int64), np.array(feature, np.int64)
    k = len(names)
    w = np.zeros(k + 8)
    if not pages:
        return Field({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0], [0.0, 0.0])
    last = there.sum(axis=1) - 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[:, :-1][there[:, 1:]], gold[:, 1:][there[:, 1:]]), 1)
    ends = gold[np.arange(len(pages)), last]
    first, final = np.bincount(gold[:, 0], minlength=2), np.bincount(ends, minlength=2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for epoch in range(1, epochs + 1):
        emission = np.bincount(cell, w[feature], there.size).reshape(there.shape)
        _, main, both, starts, stops = forward_backward(emission, there, w[k:k + 4].reshape(2, 2), w[k + 4:k + 6], w[k + 6:])
        gap = (main - gold * there).ravel()
        slope = np.concatenate((np.bincount(feature, gap[cell], k), (both - seen).ravel(), starts - first, stops - final)) / len(pages) + ridge * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        w -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    return Field(dict(zip(names, w[:k].tolist(), strict=True)), w[k:k + 4].reshape(2, 2).tolist(), w[k + 4:k + 6].tolist(), w[k + 6:].tolist())


def features_and_labels(page: str, states: States, label) -> tuple[list, list[int]]:
    blocks = leaf_blocks(page, states)
    return ([[*state_features(states, s), *text_features(t, a, i, len(blocks))] for i, (s, t, a) in enumerate(blocks)],
            [label(states, s) for s, _, _ in blocks])


def marked_main(states: States, at: int) -> int:
    """1 if the block lies in its page's article or main element, and not in a part of it that is no text of its own."""
    inside = False
    while at > 0:
        tag, words = states.tag[at], states.words[at]
        if tag in ASIDE_TAGS or ASIDE_WORDS.intersection(words):
            return 0
        inside |= tag in ("article", "main") or "main" in words and tag == "div"
        at = states.parent[at]
    return int(inside)


def given_label(states: States, at: int) -> int:
    return int(states.label[at] == "main")


#: Parts of pages as they are commonly named: (element, class or id) by what they hold.
PARTS = {
    "main": [("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("div", "entry-content"), ("div", "article-text"), ("section", "story"),
             ("div", "main-content"), ("div", "text"), ("div", ""), ("td", "body")],
    "menu": [("nav", ""), ("nav", "navbar"), ("div", "menu"), ("ul", "nav-links"), ("div", "navigation"), ("div", "breadcrumbs"), ("div", "topbar"), ("header", "")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-title"), ("header", "site-header"), ("div", "logo")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright"), ("div", "bottom"), ("footer", "legal")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related-posts"), ("aside", "rail"), ("section", "recommended"), ("div", "author-bio")],
    "notice": [("div", "cookie-notice"), ("div", "banner"), ("div", "alert"), ("section", "consent"), ("div", "newsletter-signup"), ("div", "popup"), ("dialog", "modal"),
               ("div", "notice"), ("aside", "disclaimer")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advertisement"), ("section", "sponsored"), ("div", "promo"), ("ins", "adsbygoogle"), ("aside", "advert")],
    "comments": [("div", "comments"), ("section", "comment-list"), ("ol", "commentlist"), ("div", "reader-comments"), ("section", "responses"), ("div", "discussion"),
                 ("div", "replies")],
    "form": [("form", ""), ("form", "search"), ("div", "login-form"), ("form", "subscribe")],
}
BEFORE, BESIDE, AFTER = ("menu", "header", "notice", "advert", "form"), ("sidebar", "advert", "notice", "comments", "form"), ("comments", "sidebar", "notice", "form", "footer", "menu")


def laid_out(rng: random.Random, paragraphs: list[str], others: list[str]) -> str:
    """A page of a random layout with `paragraphs` as its main text and `others` elsewhere; data-label tells what is main."""
    def words(most: int) -> str:
        told = rng.choice(others).split()
        k = rng.randrange(max(1, len(told) - most)) if len(told) > most else 0
        return markup.escape(" ".join(told[k:k + rng.randint(1, most)]))

    def heading(text: str, most: int) -> str:
        level = rng.randint(1, most)
        return f"<h{level}>{text}</h{level}>"

    def part(kind: str) -> str:
        element, name = rng.choice(PARTS[kind])
        attribute = f' {rng.choice(("class", "id", "class"))}="{name}"' if name else ""
        if kind == "menu":
            inside = "<ul>" + "".join(f'<li><a href="#">{words(3)}</a></li>' for _ in range(rng.randint(3, 9))) + "</ul>"
        elif kind == "header":
            inside = heading(words(6), 3) + rng.choice(("", f"<p>{words(9)}</p>"))
        elif kind == "footer":
            inside = rng.choice((f"&copy; {words(8)}", f"<p>{words(20)}</p><p>&copy; {words(4)}</p>", f"<a href='#'>{words(2)}</a> | <a href='#'>{words(2)}</a> &middot; {words(12)}"))
        elif kind == "comments":
            block = rng.choice(("div", "li", "article", "p"))
            inside = heading(words(3), 5) + "".join(f'<{block} class="{rng.choice(("comment", "reply", "comment-body"))}"><p>{words(60)}</p></{block}>' for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inside = f"<label>{words(3)}</label><input name=q><button>{words(2)}</button>" + rng.choice(("", f"<p>{words(25)}</p>"))
        elif kind == "sidebar":
            inside = heading(words(4), 5) + rng.choice((f"<p>{words(50)}</p>", "<ul>" + "".join(f"<li><a href='#'>{words(8)}</a></li>" for _ in range(4)) + "</ul>"))
        else:
            inside = rng.choice((words(30), f"<p>{words(60)}</p>", f"<p>{words(20)}</p><a href='#'>{words(3)}</a>"))
        return f"<{element}{attribute}>{inside}</{element}>"

    element, name = rng.choice(PARTS["main"])
    body = [rng.choice((heading(words(9), 3), ""))]
    for text in paragraphs:
        block = rng.choice(("p", "p", "p", "div", "blockquote", "li", "h2", "pre"))
        body.append(f"<{block}>{markup.escape(text)}</{block}>")
        if rng.random() < 0.06:
            body.append(f'<div data-label="none">{part(rng.choice(BESIDE))}</div>')
    label = f'<{element}{f" class={name}" if name else ""} data-label="main">'
    around = rng.choice(("div", "section", "body"))
    return ("<html><body>" + "".join(part(rng.choice(BEFORE)) for _ in range(rng.randint(1, 4))) + f"<{around}>" + label + "".join(body) + f"</{element}>"
            + "".join(part(rng.choice(BESIDE)) for _ in range(rng.randint(0, 2))) + f"</{around}>" + "".join(part(rng.choice(AFTER)) for _ in range(rng.randint(1, 3))))


def labelled_pages(pages: list[str], seed: int = 7) -> list[tuple[list, list[int]]]:
    """Features and labels of the pages that mark their main part, and of one laid-out page for each page of the sample."""
    rng, states = random.Random(seed), States()
    out, texts = [], []
    for page in pages:
        blocks = leaf_blocks(page, states)
        own = [t for s, t, a in blocks if marked_main(states, s) and 4 * a < len(t)]
        if own:
            out.append(features_and_labels(page, states, marked_main))
        texts.append(own or [t for _, t, a in blocks if 4 * a < len(t)])
    pool = [t[:2000] for own in texts for t in own] or ["One line of text, as it comes. And then one more."]
    for own in texts:
        paragraphs = rng.sample(own, len(own)) if len(own) > 1 else rng.sample(pool, min(len(pool), 6))
        cut = [t if rng.random() < 0.7 else " ".join(t.split()[:rng.randint(3, 30)]) for t in paragraphs]
        out.append(features_and_labels(laid_out(rng, cut, pool), states, given_label))
    return out


def sample_of(pages: DataFrame, size: int, chars: int) -> list[str]:
    """At most `size` pages of at most `chars` characters: those with the smallest hashes. Only hashes in the share of all
    that holds about twice the sample leave their tasks."""
    share = min(1.0, 2 * size / max(1, pages.count()))
    marked = pages.where(F.length("html").between(1, chars)).select(F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(1 << 40)).alias("h"), "html")
    return [r["html"] for r in marked.where(F.col("h") < int(share * (1 << 40))).orderBy("h", "html").limit(size).collect()]


def fit_on(pages: DataFrame, *, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Field:
    return fit(labelled_pages(sample_of(pages, sample, sample_chars)))


class Reader:
    """Main text by a field; remembers the weight of each state."""

    def __init__(self, field: Field):
        self.field, self.states, self.weights = field, States(field.weight.keys()), {}

    def main_text(self, page: str | None) -> str:
        if not page:
            return ""
        if len(self.states.parent) > STATES:
            self.states, self.weights = States(self.field.weight.keys()), {}
        blocks = leaf_blocks(page, self.states)
        if not blocks:
            return ""
        get, known, emission = self.field.weight.get, self.weights, []
        for i, (state, text, linked) in enumerate(blocks):
            told = known.get(state)
            if told is None:
                told = known[state] = sum(get(f, 0.0) for f in sorted(state_features(self.states, state)))
            for f in text_features(text, linked, i, len(blocks)):
                told += get(f, 0.0)
            emission.append(told)
        return " ".join(text for (_, text, _), label in zip(blocks, self.field.labels(emission), strict=True) if label)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select("page_id", "url", "html")
    held = pages.sparkSession.sparkContext.broadcast(field)  # as many weights as the bounded sample has features
    shape = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"

    def read(batches):
        settle("main_text")
        reader = Reader(held.value)
        for batch in batches:
            texts = [reader.main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, shape)


def op11_main_text(spark, folder):
    pages = table(spark, folder, "pages")
    return extract(pages, fit_on(pages))
