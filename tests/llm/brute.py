"""Plain counterparts of the operators, for small inputs."""

import collections
import hashlib
import math
import zlib


def window_repeats(rows, width=13):
    """{(doc_id, text): (n_words, n_removed, digest)}"""
    def words(t):
        return (t or "").encode().split()

    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k:k + width]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        out[i, t] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def near_components(rows, percent=85):
    """{doc_id: component} over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    return unite(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
                        and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])])


def unite(nodes, links):
    top = {i: i for i in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {i: find(i) for i in nodes}


def base_scores(rows, divisor=7):
    """{doc_id: (held, tokens, known, N, base)}"""
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % divisor == 2 for i in tokens}
    c = collections.Counter()
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}


def pair_scores(rows, divisor=7, least=2, growth=1.5, kept=0.9):
    """[(doc_id, score)] with every training pair seen `least` times or more, counted without a filter."""
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    words, pairs, sums = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in texts:
        if zlib.crc32(str(i).encode()) % divisor != 2:
            words.update(w)
            pairs.update(zip([b""] + w[:-1], w))
    n, once, twice = sum(words.values()), sum(k == 1 for k in words.values()), sum(k == 2 for k in words.values())
    discount = (once + 1) / (once + 2 * twice + 2)

    def level(k):
        return 1 + math.floor(math.log(k / least) / math.log(growth) + 1e-9) if k >= least else 0

    def value(q):
        return least * growth ** (q - 1) if q > 0 else 0

    for (h, _), k in pairs.items():
        sums[h] += value(level(k))

    def probability(h, w):
        share = min(1, value(level(sums[h]) + 1) / words[h]) if level(sums[h]) else 0
        alone = (words[w] - discount if words[w] else discount * len(words)) / n
        return alone * (1 - kept * share) + kept * min(value(level(pairs[h, w])), words[h]) / max(words[h], 1)

    return sorted((i, sum(math.log10(probability(h, x)) for h, x in zip([b""] + w[:-1], w))) for i, w in texts)


def round_robin(totals, window, grain):
    """Queue of every token of the stream, by playing the rounds."""
    all_tokens = sum(totals)
    credit, sent, order = [0.0] * len(totals), [0] * len(totals), []
    rounds = -(-all_tokens // window)
    for k in range(1, rounds + 1):
        for q, total in enumerate(totals):
            credit[q] = k * window * (total / all_tokens)
            upto = total if k == rounds else min(total, math.floor(min(credit[q], total) / grain) * grain)
            order += [q] * (upto - sent[q])
            sent[q] = upto
    return order


def trie_nodes(conversations):
    """Rows of all nodes of the trie of {conv_id: [(role, text), ...]}, from sets of prefixes."""
    members = collections.defaultdict(list)
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = [c for c in own if len(conversations[c]) == len(p)]
        out.append((own[0], len(p), members[p[:-1]][0] if p else None, len(own), children[p], sum(children[q] == 0 for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def best_documents(docs, query, k=10):
    """[(doc_id, score)] of the k best rows (doc_id, text), scoring every one."""
    import re

    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    corpus = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    df = collections.Counter(t for _, c, _ in corpus for t in c)
    n_docs, total = len(corpus), sum(n for _, _, n in corpus)
    out = []
    for i, c, n in corpus:
        m = 100 - 75 + 75 * n * n_docs // total
        score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(query) if c[t])
        if score > 0:
            out.append((i, score))
    return sorted(out, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[:k]
