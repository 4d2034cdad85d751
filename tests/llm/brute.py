"""Plain Python versions of the operators, one text at a time."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def word_list(text):
    return WORDS.findall(text or "")


def quality(text):
    text = text or ""
    words = word_list(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(3))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": failed}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def check_pieces(rows, ids_of, window=1024):
    """Every id of every document lies in one piece, and sequences are gapless and full."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc_id, pieces in by_doc.items():
        ids, at = ids_of[doc_id], 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            part = ids[at:at + p["length"]]
            assert p["start"] == at and len(part) == p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and at & (at - 1) == 0, at


def shingles(text):
    words = [re.sub(r"[A-Z]", lambda m: m[0].lower(), w) for w in word_list(text)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2)) or frozenset([tuple(words)])


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(docs, percent=85):
    """docs: {doc_id: text}; -> {doc_id: (number of shingles, component)} by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs.items()}
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = {}
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                pairs[(a, b)] = pairs.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in pairs.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = groups(sets, links)
    return {d: (len(sets[d]), comp[d]) for d in docs}


def repeated_windows(docs, size=50):
    """docs: {doc_id: text}; -> {doc_id: (words, mask of removed words)}."""
    words = {d: word_list(t) for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i:i + size]), d)
    out = {}
    for d, ws in words.items():
        gone = [False] * len(ws)
        for i in range(len(ws) - size + 1):
            if first[tuple(ws[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        out[d] = (ws, gone)
    return out


def base_identifiers(text):
    """{kind: [(start, end)]} by the plain patterns."""
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if good(m[0])] for k, (p, good) in kinds.items()}


def deduped_lines(docs, percent=80, size=8):
    """docs: {doc_id: text}; -> {doc_id: (lines, removed, text)} by comparing all pairs of lines that share a shingle."""
    def cut(line):
        return frozenset(line[i:i + size] for i in range(max(1, len(line) - size + 1)))

    places = [(d, i, line) for d in sorted(docs) for i, line in enumerate((docs[d] or "").split("\n")) if re.search(r"\S", line)]
    lines = {line: cut(line) for _, _, line in places}
    holders = {}
    for line, s in lines.items():
        for x in s:
            holders.setdefault(x, []).append(line)
    pairs = {}
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1:]:
                pairs[(a, b)] = pairs.get((a, b), 0) + 1
    comp = groups(lines, [(a, b) for (a, b), n in pairs.items() if 100 * n >= percent * (len(lines[a]) + len(lines[b]) - n)])
    seen, gone = set(), set()
    for d, i, line in places:
        if comp[line] in seen:
            gone.add((d, i))
        seen.add(comp[line])
    return {d: (sum(1 for p in places if p[0] == d), sum(1 for p in gone if p[0] == d),
                "\n".join(x for i, x in enumerate((t or "").split("\n")) if (d, i) not in gone)) for d, t in docs.items()}


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def spelling(rows):
    """word: (n, n_near, form, form_n, root), by comparing all words with each other."""
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[a-z\u00c0-\u00ff]+", low(text)):
            h = None if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(links[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical(docs, items, k):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    counted = [(d, TERMS.findall(low(t))) for d, t in docs]
    counted = [(d, t) for d, t in counted if t]
    n, total = len(counted), sum(len(t) for _, t in counted)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(TERMS.findall(low(text)))
    out = set()
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in ts for _, ts in counted) + 1))) for t in terms}
        scored = []
        for d, ts in counted:
            m = 50 + 50 * len(ts) * n // total
            score = sum(w * (10**9 * ts.count(t) // (1000 * ts.count(t) + 20 * m)) for t, w in weight.items())
            if score > 0 and d is not None:
                scored.append((-score, d))
        out |= {(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def judged(url, rules, hosts):
    """(host, path, rule, verdict) of one url."""
    match = re.search("://([^/?#]*)([^?#]*)", url or "")
    host, path = (low(match[1]), match[2]) if match else ("", "")
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in ((h or "", p or "", a) for h, p, a in rules)
            if h and a in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[3], max(fits)[4]
    return host, path, None, "block" if any(host == h or host.endswith("." + h) for h in hosts) else "allow"


def language_grams(text, buckets):
    """Buckets of the 1- to 3-grams of a text's small letters, runs of all else as one blank."""
    low = [(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text]
    low = [c for i, c in enumerate(low) if c != " " or i == 0 or low[i - 1] != " "]
    out = []
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            if n == 1 and low[i] == " ":
                continue
            value = 0
            for k, c in enumerate(low[i:i + n], 1):
                value = (value * 0x100000001B3 + ord(c) + k) % 2 ** 64
            out.append((value * 0x9E3779B97F4A7C15 % 2 ** 64 >> 40) % buckets)
    return out


def naive_bayes(learned, texts, buckets, smoothing=0.5):
    """(language, posterior) of each text by multinomial naive Bayes with equal priors; learned: (lang, text) pairs."""
    counts = {}
    for lang, text in learned:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(language_grams(text, buckets))
    sizes = {lang: sum(c.values()) + smoothing * buckets for lang, c in counts.items()}
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text) or not counts:
            out.append(("und", 0.0))
            continue
        grams = Counter(language_grams(text, buckets))
        logs = {lang: sum(n * math.log((counts[lang][g] + smoothing) / sizes[lang]) for g, n in grams.items()) for lang in sorted(counts)}
        best = max(logs, key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out
