"""Plain versions of the operators' contracts, row by row."""

import hashlib
import re
import struct
import zlib
from collections import Counter


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(rows, width, percent=80):
    """doc_id -> (n_shingles, component_id) of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def spans_of(text, kinds):
    """kinds: (name, pattern, test of a match), in order; all (start, rank, kind, end)."""
    return sorted((m.start(), n, k, m.end()) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def luhn(s):
    d = [int(c) for c in s if c in "0123456789"][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(d)) % 10 == 0


def n_digits(s):
    return sum(c in "0123456789" for c in s)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= n_digits(m[0]) <= 19 and luhn(m[0])),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= n_digits(m[0]) <= 15),
]
SECRETS = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def contamination(text, items, width=13):
    """(n_words, n_hit, item ids) of a text; items: {id: text}."""
    w, hit, found = words(text), set(), set()
    for item, body in items.items():
        iw = words(body)
        n = min(width, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in grams:
                found.add(str(item))
                hit.update(range(i, i + n))
    return len(w), len(hit), sorted(found)


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return low(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def verdict(url, rules):
    host, path = url_parts(url)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def packed_well(pieces, size):
    """Pieces as (length, sequence_id, offset): every sequence gapless from 0 and no longer than size."""
    at = Counter()
    for n, s, o in sorted(pieces, key=lambda p: (p[1], p[2])):
        if at[s] != o:
            return False
        at[s] += n
    return all(v <= size for v in at.values())


def _mix(x):
    """The library's scrambling of a 64-bit number."""
    m = (1 << 64) - 1
    for factor in (0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93, 1):
        x ^= x >> 32
        x = x * factor & m
    return x


def _context(chars, x=0):
    for c in chars:
        x = (x ^ c) * 0x9FB21C651E98DF25 % (1 << 64)
        x ^= x >> 28
    return x


def fingerprint(text, block, cut, times, places, context):
    """The walk and its samples, character by character."""
    import math

    import numpy as np

    if not text:
        return "0" * places
    codes = [ord(c) for c in text]
    leaves = np.random.default_rng(11).random((256, times)) < 0.5
    seen = [_context(codes[i : i + context], 0 if i + context <= len(codes) else len(codes) - i) for i in range(len(codes))]
    starts = [0]
    for i in range(1, len(codes)):
        if (_mix(seen[i]) >> 20) % cut == 0 or i - starts[-1] == block:
            starts.append(i)
    walks = []
    for a, b in zip(starts, [*starts[1:], len(codes)]):
        t, left = 0, []
        for i in range(a, b):
            row = leaves[_mix(codes[i]) & 255]
            while t < times - 1 and not row[t]:
                t += 1
            t = min(t + 1, times - 1)
            left.append(t)
        walks.append(left)
    rng, out = np.random.default_rng(13), ""
    for k in range(places):
        draw, records = np.random.default_rng(int(rng.integers(1 << 62))), [0]
        while records[-1] <= times:
            records.append(int((records[-1] + 1) / max(draw.random(), 1e-12)))
        wait = [-math.log1p(-((_mix(seen[a] ^ (k + 1) * 0xA24BAED4963EE407 % (1 << 64)) >> 11) / (1 << 53))) / len(w) for a, w in zip(starts, walks)]
        n = wait.index(min(wait))
        took = max(walks[n][-1], 1)
        time = max(r for r in records if r < took)
        step = min(sum(t <= time for t in walks[n]), len(walks[n]) - 1)
        out += "0123456789abcdef"[_mix(seen[starts[n] + step] ^ k * 0xD1342543DE82EF95 % (1 << 64)) & 15]
    return out


def random_spans(text, run, alphabets, share, reject, false):
    """Spans that the battery finds in a text; base spans are those of SECRETS. ``share``: a character's share in ordinary text, by the alphabet's size."""
    import math

    def tail(z):
        return 0.5 * math.erfc(z / math.sqrt(2))

    base = [(a, b) for a, _, _, b in spans_of(text, SECRETS)]
    runs = [(m.start(), m.end(), m[0].rstrip("=")) for m in re.finditer(run, text) if not any(a < m.end() and m.start() < b for a, b in base)]
    judged = []
    for start, end, body in runs:
        alphabet = next(a for fit, a in alphabets if re.fullmatch(fit, body))
        n, size = len(body), len(alphabet)
        codes = [alphabet.find(c) + 1 for c in body]
        chi = sum(c * c for c in Counter(body).values()) * size / n - n
        v = 2 / (9 * (size - 1))
        z_chi = (chi / (size - 1)) ** (1 / 3) - (1 - v) if chi >= 0 else -math.inf
        z_chi /= math.sqrt(v)
        high = [c > size / 2 for c in codes]
        h = sum(high)
        mean = 2 * h * (n - h) / n + 1
        turns = 1 + sum(x != y for x, y in zip(high, high[1:]))
        z_runs = 9 if h in (0, n) else (turns - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        middle = sum(codes) / n
        spread = sum((c - middle) ** 2 for c in codes)
        z_serial = 9 if spread <= 1e-9 else (sum((x - middle) * (y - middle) for x, y in zip(codes, codes[1:])) / spread + 1 / n) * math.sqrt(n)
        p = min(1, 3 * min(tail(z_chi), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial))))
        folded = body if re.search("[a-z]", body) and re.search("[A-Z]", body) else low(body)
        ratio = sum(-math.log(size * share(c, size)) for c in folded)
        judged.append((p, math.exp(-max(ratio, 0)), n, start, end))
    if not judged:
        return []
    mean = sum(x[2] for x in judged) / len(judged)
    ranked = sorted((q * mean / n, a, b) for p, q, n, a, b in judged if p >= reject)
    last = max([0, *(i + 1 for i, x in enumerate(ranked) if x[0] <= false * (i + 1) / len(judged))])
    return sorted((a, b) for _, a, b in ranked[:last])


def mod97(s):
    t = "".join(c for c in s if c.isalnum())
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
