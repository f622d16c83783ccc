"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if c < "\x80" else c for c in t)


def shingles(t):
    w = WORD.findall(low(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d in sorted(sets):
        for e, k in Counter(e for g in sets[d] for e in where[g]).items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[e]) - k):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
        for g in sets[d]:
            where[g].append(d)
    return sorted([(d, len(sets[d]), find(d)) if d is not None else (None, len(shingles(t)), None) for d, t in rows], key=str)


def repeats(rows, w):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(t[i : i + w]) for t in words for i in range(len(t) - w + 1))
    for (d, _), t in zip(rows, words, strict=True):
        gone = {j for i in range(len(t) - w + 1) if seen[tuple(t[i : i + w])] > 1 for j in range(i, i + w)}
        yield d, len(t), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(t) if i not in gone).encode()).hexdigest()


def counts(t):
    t = t or ""
    words, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


BASE = (
    ("assign", re.compile(r"""(?a:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_spans(t):
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m)]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)), Counter(kind for *_, kind in out)
