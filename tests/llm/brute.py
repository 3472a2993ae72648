"""The operators' results by plain loops over a few documents."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return BLANK_WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def runs(flags):
    return sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))


def repeated(units, length):
    """For each sequence, the items that a window occurring twice anywhere covers."""
    seen = Counter(
        tuple(u[k : k + length]) for u in units.values() for k in range(len(u) - length + 1)
    )
    out = {}
    for key, u in units.items():
        gone = [False] * len(u)
        for k in range(len(u) - length + 1):
            if seen[tuple(u[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out[key] = gone
    return out


def fingerprint(text):
    w = words((text or "").translate(SMALL))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    """The least id each one reaches, over all pairs."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ordered = sorted(ids)
    for n, a in enumerate(ordered):
        for b in ordered[n + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_copies(docs):
    fps = {i: fingerprint(t) for i, t in docs.items()}
    return fps, components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def contamination(docs, items, size=13):
    """doc: (n_words, n_hit, item ids as sorted strings, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(SMALL))
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for key, text in docs.items():
        w = BENCH_WORD.findall((text or "").translate(SMALL))
        hit, found = [False] * len(w), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if held := windows.get(tuple(w[k : k + m])):
                    hit[k : k + m] = [True] * m
                    found |= held
        n = sum(hit)
        out[key] = (len(w), n, sorted(map(str, found)), n > 0 and 20 * n >= len(w))
    return out


def without_lines(docs, size=3, passage=None):
    """Texts without the lines that a later place of a window of lines covers.

    ``passage`` lets shorter runs of that many words count too, and texts of fewer lines as a whole.
    """
    held = {
        i: [n for n, x in enumerate(t.split("\n")) if BLANK_WORD.search(x)]
        for i, t in docs.items()
        if t is not None
    }
    seen, gone = set(), defaultdict(set)
    for i in sorted(held):
        lines = docs[i].split("\n")
        for k in range(len(held[i]) - size + 1):
            window = tuple(lines[n] for n in held[i][k : k + size])
            if window in seen:
                gone[i] |= set(held[i][k : k + size])
            seen.add(window)
        for few in range(1, size) if passage is not None else ():
            for k in range(len(held[i]) - few + 1):
                run = held[i][k : k + few]
                window = tuple(lines[n] for n in run)
                if len(held[i]) == few or sum(len(words(x)) for x in window) >= passage:
                    if window in seen:
                        gone[i] |= set(run)
                    seen.add(window)
    return {
        i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        for i, t in docs.items()
    }


def statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    covered = repeated({0: w}, 5)[0]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        sum(covered),
    )


def secrets(text):
    """Base spans as (start, kind, end)."""
    text = text or ""
    assign = re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        re.IGNORECASE | re.ASCII,
    )
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def similar(docs, size=5):
    """Components of texts whose sets of shingles are alike to 0.8; wordless texts are one group."""
    held = {}
    for i, t in docs.items():
        w = words((t or "").translate(SMALL))
        held[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return components(held, lambda a, b: 5 * len(held[a] & held[b]) >= 4 * len(held[a] | held[b]))
