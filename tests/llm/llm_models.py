"""Brute-force versions of what the operators compute."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def quality(text):
    words = WORDS.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for k in range(len(words) - 2):
        if seen[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    base = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or "")
    return *base, len(lines) - len(set(lines)), len(covered)


def luhn(digits):
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)) % 10 == 0


def pii(text):
    spans = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True,
                kind != 1 or all(int(x) <= 255 for x in m[0].split(".")),
                12 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )
            if good[kind]:
                spans.append((m.start(), kind, m.end()))
    spans.sort()
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return [sum(s[1] == k for s in spans) for k in range(4)], hashlib.sha256(listed.encode()).hexdigest(), listed


def near(docs, n=5, threshold=0.8):
    """Links and smallest id of every document's class; ``docs`` maps distinct ids to texts."""
    sets = {}
    for i, text in docs.items():
        words = WORDS.findall(text or "")
        size = min(n, len(words))
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set()
    links, top = Counter(), {i: i for i in docs}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (find(i), links[i]) for i in ids}


def repeats(docs, n=50):
    """Words of each document that lie in runs of n words found elsewhere too."""
    seen, words = defaultdict(list), {i: WORDS.findall(t or "") for i, t in docs.items()}
    for i, own in words.items():
        for k in range(len(own) - n + 1):
            seen[tuple(own[k : k + n])].append((i, k))
    out = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                out[i].update(range(k, k + n))
    return out


def targets(sizes, most=3):
    """Target of each source by water filling; ``sizes`` maps sources (None last) to words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if share * weights[s] > most * sizes[s]]
        if not over:
            out |= {s: share * weights[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def runs(words, times=4, least=6):
    """Start, length and smallest period of every run."""
    found = {}
    for q in range(1, len(words) // times + 1):
        k = 0
        while k + q < len(words):
            start = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k - start + q >= max(least, times * q):
                found.setdefault((start, k - start + q), q)
            k += 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for start, length, period in found for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(doc_id, words):
    """The words of the document with its planted run, if it has one."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def simhash(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def near_prints(prints, most=2):
    """The smallest id that each id reaches; ``prints`` maps ids to fingerprints."""
    top = {i: i for i in prints}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(prints)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: find(i) for i in ids}


def aligned(text, first, second):
    """Ids of both tokenizers, groups, and linked pairs; all empty where bytes differ."""
    if not text:
        return [], [], [], []
    a, b, data = first.encode([f" {text}"])[0], second.encode([text])[0], f" {text}".encode()
    if any(b"".join(v.tokens[i] for i in ids) != data for v, ids in ((first, a), (second, b))):
        return [], [], [], []
    ends = [list(itertools.accumulate(len(v.tokens[i]) for i in ids)) for v, ids in ((first, a), (second, b))]
    groups, links, at_a, at_b = [], [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_a, to_b = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append("|".join(",".join(map(str, ids)) for ids in (a[at_a:to_a], b[at_b:to_b])))
        links.append((a[to_a - 1], b[to_b - 1]))
        at_a, at_b = to_a, to_b
    return a, b, groups, links
