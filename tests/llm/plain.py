"""Brute-force versions of the operators, over lists of rows, and odd documents."""

import hashlib
import random
import re
from collections import Counter, defaultdict


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near(rows, width=4):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def text_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    found, cover = Counter(windows), set()
    for k, x in enumerate(windows):
        if found[x] > 1:
            cover.update(range(k, k + 5))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(cover), failed


def test_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def contamination(docs, items, window=13):
    known, widths = defaultdict(set), set()
    for i, t in items:
        w = test_words(t)
        n = min(window, len(w))
        if n:
            widths.add(n)
            for k in range(len(w) - n + 1):
                known[tuple(w[k : k + n])].add(str(i))
    out = []
    for _, t in docs:
        w, hit, found = test_words(t), set(), set()
        for n in widths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit.update(range(k, k + n))
                    found |= known[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(found), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(rows, width=50):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        starts = {b[k : k + width] for k in range(len(b) - width + 1)}
        for k in range(len(b) - width + 1):
            if seen.get(b[k : k + width], i) < i:
                gone[k : k + width] = b"\1" * width
        for s in starts:
            seen.setdefault(s, i)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    k = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
    return a[k + 1 :] == (b[k:] if len(a) > len(b) else b[k + 1 :])


def line_dedup(rows):
    places = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    places.sort(key=lambda p: p[:2])
    gone = {p[:2] for k, p in enumerate(places) if any(within_one(q[2], p[2]) for q in places[:k])}
    return {
        i: ("\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) if t is not None else None)
        for i, t in rows
    }


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghiklmnoprstuéñ") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def corpus(seed=7, n=60):
    """(doc_id, text, lang, source): prose, copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = prose(30)
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and rows:
            text = rng.choice(rows)[1] or "lone"
        elif kind == 2 and rows:
            w = (rng.choice(rows)[1] or prose(40)).split(" ")
            for _ in range(max(1, len(w) // rng.choice((12, 20, 40)))):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind == 3:
            text = f"{prose(20)}\n{passage}\n{prose(15)}"
        else:
            text = "\n".join(prose(rng.randint(3, 40)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, "xy"[i % 2], f"s{i % 3}"))
    odd = [None, "", " \t\n ", "word", "Three Short Words", "a\nb\n\nab\na", "x" * 300, "wide \U0001f600 ünïcode \x00 nul", prose(6000)]
    rows += [(n + k, t, None, None) for k, t in enumerate(odd)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"
