"""Plain versions of the operators, for small inputs."""

import hashlib
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def decontaminate(docs, items, n=10):
    wins = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        size = min(n, len(w))
        for i in range(len(w) - size + 1) if w else ():
            wins.setdefault(tuple(w[i: i + size]), set()).add("" if item is None else str(item))
    out = set()
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i: i + size]) in wins:
                    hit.update(range(i, i + size))
                    found |= wins[tuple(w[i: i + size])]
        out.add((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def order(doc):
    return (doc[0] is not None, doc[0] or 0)


def substrings(docs, n=20):
    """Rows repeated exactly are one document; the caller gives no two other rows of one id."""
    first = {}
    for doc, text in sorted(set(docs), key=order):
        w = SPACED.findall(text or "")
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i: i + n]), (doc, i))
    out = []
    for doc, text in docs:
        w = SPACED.findall(text or "")
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i: i + n])] != (doc, i) for j in range(i, i + n)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def suffixes(docs, span=400):
    seen = {}
    for _, text in docs:
        b = (text or "").encode()
        for i in range(len(b) - span + 1):
            seen[b[i: i + span]] = seen.get(b[i: i + span], 0) + 1
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i: i + span]] > 1:
                gone[i: i + span] = b"\x01" * span
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text, n=4):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i: i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i))) for i, ((doc, _), s) in enumerate(zip(docs, sets))]


def lines(docs, words=25):
    """Text left of each row (None for null), and the numbers of lines deleted."""
    def least(text):
        ls = text.split("\n")
        n = [len(re.findall(r"[^ \t\n\x0B\f\r]+", x)) for x in ls]
        for i in range(len(ls)):
            hi = next((j for j in range(i, len(ls) + 1) if sum(n[i:j]) >= words), None)
            if hi:
                yield i, hi
            lo = next((j for j in range(i + 1, -1, -1) if sum(n[j: i + 1]) >= words), None)
            if lo is not None:
                yield lo, i + 1

    first = {}
    for doc, text in sorted({d for d in docs if d[1] is not None}, key=order):
        for lo, hi in sorted(set(least(text))):
            first.setdefault(tuple(text.split("\n")[lo:hi]), (doc, lo))
    out = []
    for doc, text in docs:
        if text is None:
            out.append((doc, None, 0))
            continue
        ls = text.split("\n")
        gone = {j for lo, hi in set(least(text)) if first[tuple(ls[lo:hi])] != (doc, lo) for j in range(lo, hi)}
        out.append((doc, "\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone)))
    return out
