"""Plain restatements that the operators are held against."""

import base64
import json
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def shingles(text):
    words = WORD.findall(text or "")
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_classes(texts, least=0.8):
    """{id: least id of its class} by comparing all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    pairs = {(a, b) for ks in holders.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in texts}


def secrets(text):
    text = text or ""
    assign = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 8 and m[1].isascii()]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [s for _, _, s in sorted(found)]


def _crc62(body):
    digits, value, out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", zlib.crc32(body.encode()), ""
    while value:
        value, out = value // 62, digits[value % 62] + out
    return out.rjust(6, "0")


def _alg(part):
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def _tokens(text):
    """Web tokens, the header tried at every place."""
    free = 0
    for i in range(len(text)):
        m = i >= free and re.compile(r"(eyJ[0-9A-Za-z_-]+)\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+", re.A).match(text, i)
        if m and len(m[1]) <= 4096 and _alg(m[1]):
            free = m.end()
            yield i, free


def all_secrets(text):
    """Spans of all kinds, the added ones by their whole patterns tried at every place."""
    text = text or ""
    order = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]
    rules = [
        ("github", r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", lambda m: _crc62(m[1]) == m[2]),
        ("npm", r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", lambda m: _crc62(m[1]) == m[2]),
        ("pem", r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----[0-9A-Za-z+/=\s:,-]*?-----END \1-----", lambda m: True),
    ]
    found = [(int(x.split(":")[1]), order.index(x.split(":")[0]), x) for x in secrets(text)]
    found += [(a, order.index("jwt"), f"jwt:{a}:{b}") for a, b in _tokens(text)]
    for kind, pattern, holds in rules:
        found += [(m.start(), order.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.A) if holds(m)]
    return [x for _, _, x in sorted(found)]


def top_k(vectors, queries, k=5):
    out = []
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return out
