"""Plain versions of the contracts, over small fixtures."""

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


SECRETS = [
    ("assign", re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
     lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def secrets(text):
    """Counts by kind and the digest of the base spans."""
    spans = [(m.start(), k, m.end(), kind) for k, (kind, rx, ok) in enumerate(SECRETS) for m in rx.finditer(text or "") if ok(m)]
    spans.sort()
    return ([sum(s[1] == k for s in spans) for k in range(3)],
            sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)))


def contamination(texts, items):
    """Per text: words, hit words, sorted items."""
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(str(item), w[i:i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i:i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        out.append((len(w), len(hit), sorted(found)))
    return out


PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]


def licences(text):
    w = words(text)
    at = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted({x for _, x in at})))


def shingles(text, n=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER)) if x]
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def components(rows, percent=85):
    """doc_id to (set size, smallest linked doc_id)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                x, y = len(sets[a]), len(sets[b])
                if 100 * min(x, y) < percent * max(x, y):
                    continue
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (x + y - both):
                    ra, rb = find(a), find(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}
