"""Plain versions that several tests of this folder compare with."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_fingerprint(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def components(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def luhn(s):
    return sum(v - 9 * (v > 9) for i, c in enumerate(reversed(s)) for v in [int(c) * (1 + i % 2)]) % 10 == 0


def base_spans(x):
    for k, p in BASE.items():
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(z) > 255 for z in m.group().split(".")) or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            yield k, m.start(), m.end()
