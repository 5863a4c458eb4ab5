"""Plain single-process versions of the corpus operators' contracts, from their definitions."""
import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def near(docs, size, percent):
    """{row: (n, component)} by comparing all pairs that share a shingle."""
    sets = [shingles(t, size) for _, t in docs]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    shared = Counter()
    for rows in held.values():
        for a in range(len(rows)):
            for b in range(a):
                shared[rows[b], rows[a]] += 1
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)]


def line_dedup(docs):
    def key(x):
        return x.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def personal(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[ -]", "", v)) <= 19 and luhn(re.sub("[ -]", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15)]
    found = {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(m.group())] for k, p, ok in kinds}
    spans = [f"{k}:{a}:{b}" for k, s in found.items() for a, b in s]
    return tuple(len(s) for s in found.values()), spans


def secret(text):
    assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    found = [[(m.start(), 0, "assign", m.end()) for m in assign.finditer(text or "") if len(m.group(1)) >= 6],
             [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20],
             [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 24]]
    return tuple(map(len, found)), [f"{k}:{a}:{b}" for a, _, k, b in sorted(sum(found, []))]


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), failed


def edited(docs):
    """{doc_id: (n_chars, sha of the edited text)} for distinct ids."""
    order = sorted(docs, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        out[d] = (len(t), sha(t[:len(t) - n] + nxt[:n]))
    return out


def targets(sizes, weights=(1, 2, 3), epochs=3):
    """{source: target} by passing on the excess until none is left."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > epochs * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / share for s in free}
        fixed |= {s: float(epochs * sizes[s]) for s in over}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=20):
    """[(item, rank, doc, score)] for ``docs`` (id, text) and ``items`` (id, text), every row for itself; null ids last among ties."""
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(d, Counter(split(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        want, found = Counter(split(text)), []
        for d, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(k * int(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)) // 1) * (1000000000 * c[w] // (1000 * c[w] + 12 * m))
                    for w, k in want.items() if w in c)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, r, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(found)[:top], 1)]
    return out


def aligned(docs, a, b):
    """Rows of the alignment contract for ``docs`` (id, text); ``a``, ``b``: text to [(id, bytes)]."""
    held, counts = [], Counter()
    for d, t in docs:
        whole = f" {t}".encode()
        x, y = (a(t), b(t)) if t else ([], [])
        if b"".join(v for _, v in x) != whole or b"".join(v for _, v in y) != whole:
            held.append((d, None, [], 0, 0))
            continue
        spans = []
        for ids in (x, y):
            at, own = 0, []
            for i, v in ids:
                own.append((i, at, at + len(v)))
                at += len(v)
            spans.append(own)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in own if lo <= s and e <= hi) for own in spans))
            lo = hi
        links, j = [], 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        counts.update(links)
        held.append((d, groups, links, len(x), len(y)))
    top = {}
    for (_, i), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    return [(d, n, m, len(g or []), len(ls), sum(counts[p] == top[p[1]] for p in ls), sum(counts[p] for p in ls), sha(";".join(g)) if g is not None else "")
            for d, g, ls, n, m in held]
