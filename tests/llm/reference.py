"""Plain versions of the contracts, for small tables."""

import hashlib
import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii(text):
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def measures(text):
    words = spaced(text)
    n = len(words)
    seen = defaultdict(list)
    for i in range(n - 7):
        seen[tuple(words[i : i + 8])].append(i)
    repeated = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def phrases(text):
    words = alnum(text)
    return sorted((i, label) for label, p in PHRASES.items() for i in range(len(words)) if words[i : i + len(p)] == p)


def windows(items):
    found = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        size = min(13, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found[tuple(words[i : i + size])].add(item)
    return found


def contamination(text, found):
    words, hit, items = alnum(text), set(), set()
    for size in {len(w) for w in found}:
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in found:
                items |= found[tuple(words[i : i + size])]
                hit |= set(range(i, i + size))
    names = sorted(str(i) for i in items if i is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def shingle_set(text):
    words = spaced((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near(rows):
    """(set size, smallest id of the component) of each row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)].append(key)
    return [(len(s), min(ids[find(i)], default=None)) for i, s in enumerate(sets)]


def site_lines(rows, ratio, least, long_ratio=0.004, long=200):
    """(text, lines, dropped) of each (id, text, host) row."""
    bare = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    pages, count = defaultdict(int), defaultdict(int)
    for _, text, host in rows:
        pages[host] += 1
        for line in {bare(x) for x in (text or "").split("\n")} - {""}:
            count[host, line] += 1
    out = []
    for _, text, host in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (count[host, bare(x)] >= least and count[host, bare(x)] > (long_ratio if len(bare(x)) >= long else ratio) * pages[host])]
        out.append((None, 0, 0) if text is None else ("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out
