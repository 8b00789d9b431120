"""Plain versions of the operators for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def repeated_words(rows, window=20):
    """(id, words, removed, digest) by keeping the first start of each window."""
    seen, out = set(), []
    for doc, text in order(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(rows, length=200):
    count = Counter()
    for _, text in rows:
        b = (text or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for doc, text in order(rows):
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def near(rows, threshold=0.8):
    """(id, group, links): linked if the Jaccard similarity of the shingle sets reaches the threshold or both are empty."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) and (both or sets[i] == sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        low[find(i)].append(doc)
    name = {k: min((d for d in v if d is not None), default=None) for k, v in low.items()}
    return [(doc, name[find(i)], links[i]) for i, (doc, _) in enumerate(rows)]


def bag_similarity(a, b):
    x, y = Counter(a), Counter(b)
    return sum((x & y).values()) / sum((x | y).values())


def leaks(rows, items, threshold=0.8):
    """(doc, item) pairs with an aligned window that is similar enough."""
    found = set()
    for doc, text in rows:
        w = WORD.findall(text or "")
        s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for item, body in items:
            v = WORD.findall(body or "")
            t = [tuple(v[i : i + 5]) for i in range(len(v) - 4)]
            for i, x in enumerate(s):
                for j, y in enumerate(t):
                    if x == y:
                        a, b = max(i - j, 0), min(i - j + len(v), len(w))
                        if bag_similarity(s[a : b - 4], t) >= threshold:
                            found.add((doc, item))
    return found


def aligned(rows, first, second):
    """(id, tokens of A, of B, groups, links, best links, sum of counts, groups as text); ``first`` and ``second`` give (id, bytes) of space and text."""
    found = []
    for doc, text in rows:
        a, b = (first(text), second(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out

        sa, sb = spans(a), spans(b)
        links = [(x, y) for x, s, e in sa for y, u, v in sb if s < v and u < e]
        ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, before = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in z if before <= s and e <= end) for z in (sa, sb)))
            before = end
        found.append((doc, len(a), len(b), links, ";".join(groups), len(groups)))
    count = Counter(pair for f in found for pair in f[3])
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(d, na, nb, g, len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), text) for d, na, nb, links, text, g in found]


def nearest(rows, is_query, k=5):
    """(query id, rank, id, score) over rows of (id, vector); ids may repeat."""
    out = []
    for i, (q, v) in enumerate(rows):
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), c) for j, (c, w) in enumerate(rows) if j != i)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return out


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, other):
    """{row place: (leaf, subroot, root, siblings, folded root)} of rows (doc_id, source, lang, n_chars, text); ``other`` gives a row's altered copy."""

    def leaf(row):
        return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])

    def tree(nodes):
        """(root, for each node its way: (side, sibling))"""
        ways, where = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(where):
                pair = at ^ 1
                ways[i].append(("-", "") if pair >= len(nodes) else ("L" if pair < at else "R", nodes[pair]))
                where[i] = at // 2
            nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        return nodes[0], ways

    by = defaultdict(list)
    for i, row in enumerate(rows):
        by[row[2]].append((row[0] is not None, row[0] or 0, leaf(row), i))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subs = {name: tree([x[2] for x in sorted(by[name])]) for name in names}
    root, tops = tree([subs[name][0] for name in names])
    out = {}
    for name, top in zip(names, tops, strict=True):
        for (*_, own, i), way in zip(sorted(by[name]), subs[name][1], strict=True):
            node = leaf(other(rows[i]))
            for side, sibling in [*way, *top]:
                node = sha(sibling, node) if side == "L" else sha(node, sibling)
            out[i] = (own, subs[name][0], root, "".join(s for _, s in [*way, *top]), node)
    return out
