"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def written(spans, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def secrets(text: str | None) -> tuple:
    text = text or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m.group(2)) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    n = Counter(k for k, *_ in out)
    return n["assign"], n["access"], n["hex"], sha(written(out, ["assign", "access", "hex"]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text: str | None) -> tuple:
    text = text or ""
    kinds = ["email", "ip", "card", "phone"]
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    n = Counter(k for k, *_ in out)
    return *(n[k] for k in kinds), sha(written(out, kinds)), written(out, kinds)


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near(docs: list[tuple]) -> dict:
    """doc_id: (n_shingles, component_id)."""
    sets = {d: shingle_set(t) for d, t in docs}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    shared: Counter = Counter()
    for group in having.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def quality(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(covered), failed


def repeats(docs: list[tuple], n: int = 100) -> dict:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\x01" * n
            seen.add(w)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[d] = len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()
    return out


def phrases(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    known = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    found = []
    for p, label in known.items():
        own = p.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def tokens_crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def quality_kept(docs: list[tuple]) -> dict:
    """doc_id: kept, of rows (doc_id, text, lang, source); quartiles from sorted lists of bucketed shares."""
    names = {"symbols": 1, "dup_lines": 1, "repeats": 16, "stutter": 1, "capitals": 1}

    def parts(text: str | None) -> dict:
        words = WORD.findall(text or "")
        n, chars, symbols, dup, again, failed = quality(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        stutter = sum(a == b for a, b in zip(words, words[1:]))
        capitals = sum("A" <= c <= "Z" for c in text or "")
        whole = {"symbols": (symbols, chars), "dup_lines": (dup, lines), "repeats": (again, n), "stutter": (stutter, n), "capitals": (capitals, chars)}
        return {"failed": failed, **whole}

    def share(part: int, whole: int) -> int:
        return max(part, 0) * 1000 // whole if whole else 0

    def width(v: int) -> int:
        return 1 if v < 32 else 1 << (v.bit_length() - 1 - 4)

    def limit(values: list[int]) -> int:
        own = sorted(v // width(v) * width(v) for v in values)
        q1, q3 = (own[-(-len(own) * q // 4) - 1] for q in (1, 3))
        return q3 + 8 * max(q3 - q1, width(q3))

    rows = {d: (parts(t), lang, source) for d, t, lang, source in docs}
    groups = defaultdict(list)
    for p, lang, source in rows.values():
        for key in ((lang, source), (lang,), ()):
            groups[key].append(p)
    tops = {}
    out = {}
    for d, (p, lang, source) in rows.items():
        key = next((k for k in ((lang, source), (lang,)) if len(groups[k]) >= 200), ())
        if key not in tops:
            tops[key] = {m: limit([share(*g[m]) for g in groups[key]]) for m in names}
        out[d] = not p["failed"] and all(share(p[m][0] - less, p[m][1]) <= tops[key][m] for m, less in names.items())
    return out
