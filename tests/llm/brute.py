"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import math
import re
import zlib


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = item_words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = {}
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[t]
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def personal(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


def shingles(text, size=5):
    w = plain_words(low(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def jaccard_components(docs, percent=75):
    sets = {d: shingles(t) for d, t in docs}
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeated(docs, size=50):
    first = {}
    words = {d: plain_words(t) for d, t in docs}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone |= set(range(i, i + size))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def repeated_bytes(docs, size=50):
    first = {}
    raw = {d: (t or "").encode() for d, t in docs}
    for d, b in raw.items():
        for i in range(len(b) - size + 1):
            first[b[i : i + size]] = min(first.get(b[i : i + size], d), d)
    out = {}
    for d, b in raw.items():
        gone = set()
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < d:
                gone |= set(range(i, i + size))
        out[d] = (len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest())
    return out


def infill(doc, text):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{doc}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def trie(turns):
    """Rows of the conversation trie from (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + t[h:]
    members, ends = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    children = {}
    for k in members:
        if k:
            children[k[:-1]] = children.get(k[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children.get(k, 0), leaves[k], saved[k], sha(",".join(map(str, sorted(ends.get(k, [])))))) for k, m in members.items())
