"""Plain-Python forms of what the operators compute."""

import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, size):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}


def groups(texts, size, percent):
    """Smallest id reachable by links, by brute force over pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for k, a in enumerate(h) for b in h[k + 1 :]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def documents(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def span_hash(raw):
    """The 64-bit hash of a word of up to 64 bytes, number by number."""
    top = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & top
        x ^= x >> 29
        x = x * 0xC4CEB9FE1A85EC53 & top
        return x ^ x >> 32

    h = mix((len(raw) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & top)
    for at in range(0, len(raw), 8):
        h = mix((h * 0xD6E8FEB86659FD93 & top) ^ int.from_bytes(raw[at : at + 8], "little"))
    return h
