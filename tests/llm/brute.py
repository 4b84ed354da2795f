"""Plain one-document-at-a-time versions of the operators' contracts, without Spark."""

import hashlib
import html as entities
import re
import zlib
from collections import Counter, defaultdict

UPPER = {c: c + 32 for c in range(65, 91)}
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, n=3):
    words = SPACE.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def near_duplicates(rows, n=3, need=85, of=100):
    """{(row number): (n_shingles, component_id, kept)} by comparing all pairs that share a shingle."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    both = Counter()
    for ks in by.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                both[b, a] += 1
    for (a, b), m in both.items():
        if of * m >= need * (len(sets[a]) + len(sets[b]) - m):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)]


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by resharing the excess until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left, share = total - sum(capped.values()), sum(weight[s] for s in free)
        given = {s: left * weight[s] / share for s in free}
        over = [s for s in free if given[s] > most * sizes[s]]
        if not over:
            return {**given, **capped}
        capped.update({s: most * sizes[s] for s in over})


def mixed(rows, weights=(5, 2, 1), most=3):
    """[(id, size, source size, target, taken)]: whole passes, then the last one filled in levels."""
    sized = [(i, s, len(SPACE.findall(t or "")), hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()) for i, t, s in rows]
    total, taken = Counter(), Counter()
    for _, s, n, _ in sized:
        total[s] += n
    want = targets(total, weights, most)
    for s in total:
        mine = sorted((k for k, r in enumerate(sized) if r[1] == s and r[2]), key=lambda k: (sized[k][3], sized[k][0]))
        passes = int(want[s] // total[s]) if total[s] else 0
        part = want[s] - passes * total[s]
        left, used = list(mine), []
        gap = part
        while gap >= 1:
            level, sofar, hit = 1 << (int(gap).bit_length() - 1), 0, []
            for k in [k for k in left if sized[k][2] <= level]:
                sofar += sized[k][2]
                if sofar > gap:
                    break
                hit.append(k)
            if not hit:
                break
            used += hit
            left = [k for k in left if k not in set(hit)]
            gap = part - sum(sized[k][2] for k in used)
        near = min(left, key=lambda k: (abs(gap - sized[k][2]), sized[k][3], sized[k][0]), default=None)
        if near is not None and part > 0 and abs(gap - sized[near][2]) < gap:
            used.append(near)
        for k in mine:
            taken[k] = (passes + (k in set(used))) * sized[k][2]
    return [(i, n, total[s], want[s], taken[k]) for k, (i, s, n, _) in enumerate(sized)]


def contamination(docs, items, window=10):
    by = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(UPPER))
        for k in range(max(1, len(words) - window + 1) if words else 0):
            by[tuple(words[k:k + window])].add("null" if item is None else str(item))
    lengths = {len(w) for w in by}
    out = []
    for doc, text in docs:
        words = ALNUM.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if names := by.get(tuple(words[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def base_secrets(text):
    text = text or ""
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 8]
    access = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    runs = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    kinds = ["assign", "access", "hex"]
    every = sorted(spans + access + runs, key=lambda s: (s[1], kinds.index(s[0])))
    line = ",".join(f"{k}:{s}:{e}" for k, s, e in every)
    return len(spans), len(access), len(runs), hashlib.sha256(line.encode()).hexdigest(), line


def covered(words, n):
    at = defaultdict(list)
    for k in range(len(words) - n + 1):
        at[tuple(words[k:k + n])].append(k)
    return {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(n)}


def repetition(text):
    text = text or ""
    words = SPACE.findall(text)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        found = SPACE.findall(line)
        if found:
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, found))
            seen.add(line)
    chars, repeat = sum(map(len, words)), len(covered(words, 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    limits = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
    shares = {n: sum(len(words[k]) for k in covered(words, n)) for n in limits}
    good = not failed and (len(words) < 200 or all(100 * shares[n] <= limits[n] * chars for n in limits)) and 100 * dup_chars <= 20 * chars \
        and 100 * symbols <= 10 * chars
    return len(words), chars, symbols, dup, repeat, failed, good


def removed_repeats(texts, length=400):
    """(bytes, removed, spans, SHA-256 of what is left) of each text."""
    data, count = [(t or "").encode() for t in texts], Counter()
    for d in data:
        count.update(hash(d[i:i + length]) for i in range(len(d) - length + 1))
    seen = Counter()  # exact strings, only for those whose hash is not alone
    for d in data:
        seen.update(s for s in (d[i:i + length] for i in range(len(d) - length + 1)) if count[hash(s)] > 1)
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[hash(d[i:i + length])] > 1 and seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = host.translate(UPPER)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, verdict


def article(html):
    """Text of the article element of the generated pages, read with regular expressions."""
    m = re.search(r"(?s)<article>(.*?)(?:</article>|$)", html or "")
    parts = re.split(r"</?(?:h1|p|article)>", m[1] if m else "")
    out = []
    for part in parts:
        text = re.sub(r"\s+", " ", entities.unescape(re.sub(r"<(?:/?b|br)>", lambda t: " " if t[0] == "<br>" else "", part))).strip()
        if text:
            out.append(text)
    return "\n".join(out)
