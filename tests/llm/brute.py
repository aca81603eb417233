"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def near_groups(docs, width, percent):
    """docs: (doc_id, text) -> {doc_id: smallest linked doc_id}."""
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(k)
    pairs = {p for ks in inverted.values() for p in combinations(ks, 2)}
    for j, k in pairs:
        (a, s), (b, t) = sets[j], sets[k]
        same = len(s & t)
        if 100 * same >= percent * (len(s) + len(t) - same):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in docs}, {i: len(s) for i, s in sets}


_NOT_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def overlaps(docs, items, window=13):
    """docs, items: (id, text) -> sorted (doc_id, n_words, n_hit, sorted item ids as text, contaminated)."""
    def words(t):
        return _NOT_WORD.findall((t or "").translate(LOWER))

    wanted = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w and i is not None else 0):
            wanted.setdefault(tuple(w[s:s + window]), set()).add(str(i))
    sizes = sorted({len(k) for k in wanted})
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                ids = wanted.get(tuple(w[s:s + n]))
                if ids:
                    found |= ids
                    hit.update(range(s, s + n))
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def merkle(rows, fan=8, tampered=lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof, folded, verified)."""
    def h(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
        return out

    def way(tree, at):
        for nodes in tree[:-1]:
            run = nodes[at // fan * fan:at // fan * fan + fan]
            yield run[:at % fan], run[at % fan + 1:]
            at //= fan

    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda v: (v is not None, (v or "").encode()))
    for v in order:
        langs[v].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {v: levels([leaf(r) for r in langs[v]]) for v in order}
    top = levels([trees[v][-1][0] for v in order])
    out = []
    for k, v in enumerate(order):
        for at, r in enumerate(langs[v]):
            steps = [*way(trees[v], at), *way(top, k)]
            shown = leaf(r[:4] + (r[4].translate(LOWER),)) if tampered(r[0]) and r[4] is not None else leaf(r)
            for before, after in steps:
                shown = h("".join(before) + shown + "".join(after))
            proof = h("".join("".join(before + after) for before, after in steps))
            out.append((r[0], leaf(r), trees[v][-1][0], top[-1][0], proof, shown, shown == top[-1][0]))
    return sorted(out, key=repr)


def hard_negatives(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    """rows: (id, vector, label) -> sorted (anchor, positive, rank, negative, positive score, negative score)."""
    used = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, u, label) in enumerate(used):
        if not is_anchor(anchor):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(u, v)), i, y != label) for b, (i, v, y) in enumerate(used) if b != a))
        for p, positive, _ in [s for s in scored if not s[2]][:positives]:
            near = [(n, i) for n, i, other in scored if other and low * -p <= 100 * -n <= high * -p]
            out += [(anchor, positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(near[:negatives])]
    return sorted(out)


def text_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i:i + 3]), []).append(i)
    hit = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(lines))


def outliers(rows, least, support=0.6, level_limit=23.512742444989872, steps=6, unit=1000, floors=(0.05, 0.1, 0.15, 0.2)):
    """rows: (doc_id, text, lang, source) -> sorted (doc_id, five counts, base_failed, kept), by numpy on whole cells."""
    counts = [text_counts(t) for _, t, _, _ in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    vectors = [np.round(np.array([math.log(max(c[1] / max(c[0], 1), 1)), math.sqrt(c[2] / max(c[0], 1)), math.sqrt(c[4] / max(c[0], 1)),
                                  math.sqrt(c[3] / max(c[5], 1))]) * unit) / unit for c in counts]
    passed = [k for k in range(len(rows)) if not failed[k]]
    cells = {}
    for k in passed:
        cells.setdefault(rows[k][2:], []).append(k)
    pools = {}
    for (lang, source), ks in list(cells.items()):
        if len(ks) < least:
            pools.setdefault(lang, []).extend(cells.pop((lang, source)))
    rest = [k for lang in list(pools) if len(pools[lang]) < least for k in pools.pop(lang)]
    kept = {k: True for k in passed}
    for ks in [*cells.values(), *pools.values(), *([rest] if len(rest) >= least else [])]:
        x = np.array([vectors[k] for k in ks])
        n = len(x)

        def at(q):
            return np.sort(x, axis=0)[math.ceil(q * n) - 1]

        mean, spread = at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2 + np.square(floors))
        for step in range(steps + 1):
            d2 = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(spread), x - mean)
            if step == steps:
                break
            place = np.maximum(np.floor((np.log2(np.maximum(d2, 2.0 ** -8)) + 8) * 8), 0)
            near = place <= np.sort(place)[math.ceil(support * n) - 1]
            mean, spread = x[near].mean(axis=0), np.cov(x[near].T, bias=True)
            # Chi-square with 4 and 6 degrees of freedom at the support's quantile, worked out for 0.6.
            spread = spread * support / 0.3293628733856655 + np.diag(np.square(floors))
        for k, d in zip(ks, d2):
            kept[k] = d <= level_limit
    return sorted([(r[0], *c[:5], f, kept.get(k, False)) for k, (r, c, f) in enumerate(zip(rows, counts, failed))], key=repr)
