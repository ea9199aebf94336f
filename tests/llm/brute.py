"""Plain versions of the contracts, one row at a time, to hold the operators against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def lowered(text: str | None) -> bytes:
    return (text or "").encode().lower()


def spaced(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x20\x09-\x0D]+", lowered(text))


def alnum(text: str | None) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def shingles(text: str | None) -> frozenset:
    w = spaced(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for d in sorted(sets):
        seen = Counter()
        for s in sets[d]:
            seen.update(inverted[s])
            inverted[s].append(d)
        for e, shared in seen.items():
            if 100 * shared >= 80 * (len(sets[d]) + len(sets[e]) - shared):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


PHRASES = {"mit": b"mit license", "apache": b"apache license", "gpl": b"general public license"}


def licences(text: str | None) -> tuple:
    w = alnum(text)
    found = []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def contamination(text: str | None, items: list[tuple[int, str | None]]) -> tuple:
    w = alnum(text)
    windows = defaultdict(lambda: defaultdict(set))
    for item, t in items:
        x = alnum(t)
        m = min(13, len(x))
        for k in range(len(x) - m + 1 if m else 0):
            windows[m][tuple(x[k : k + m])].add(item)
    hit, names = set(), set()
    for m, those in windows.items():
        for i in range(len(w) - m + 1):
            found = those.get(tuple(w[i : i + m]))
            if found:
                hit.update(range(i, i + m))
                names |= found
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    t, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def listed(spans) -> str:
    order = ("email", "ip", "card", "phone")
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order.index(s[0]), s[1], s[2])))


RULES = {"com/": ("com", "/", "allow"), "example.com/en/": ("example.com", "/en/", "block"), "www.example.com/en/": ("www.example.com", "/en/", "allow"), "net/es/": ("net", "/es/", "block"), "net/fr/": ("net", "/fr/", "block")}


def url(u: str | None) -> tuple:
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r, (h, p, _) in RULES.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES[rule][2] if rule else None


def mix(rows: list[tuple[int, str | None, str | None]]) -> dict[str | None, float]:
    """Target of each source."""
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(spaced(text))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, left, out = set(names), 1.5 * sum(size.values()), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 2.0 * size[s]
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def auc(scores, labels) -> float:
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ranks, i = [0.0] * len(scores), 0
    while i < len(order):
        j = i
        while j < len(order) and scores[order[j]] == scores[order[i]]:
            j += 1
        for k in range(i, j):
            ranks[order[k]] = (i + j + 1) / 2
        i = j
    pos = [r for r, y in zip(ranks, labels, strict=True) if y]
    n, p = len(labels), len(pos)
    return (sum(pos) - p * (p + 1) / 2) / (p * (n - p)) if 0 < p < n else float("nan")


def nearest(dense, terms, weights, k: int) -> list[tuple[int, float]]:
    """The k rows most similar to a sparse vector, of similarity above 0, ties (to nine digits) to the earlier row."""
    sims = [float(sum(row[t] * w for t, w in zip(terms, weights, strict=True))) for row in dense]
    order = sorted((i for i, x in enumerate(sims) if x > 0), key=lambda i: (-round(sims[i], 9), i))
    return [(i, sims[i]) for i in order[:k]]


def boosted(x, y, trees: int, depth: int, bins: int, rate: float, ridge: float, least: int) -> list[float]:
    """Scores of boosted trees on logistic loss, every split tried by going over the rows."""
    import math

    import numpy as np

    n, share = len(y), (sum(y) + 1) / (len(y) + 2)
    total = [math.log(share / (1 - share))] * n
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        grad, hess = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        leaves = [list(range(n))]
        for _ in range(depth):
            new = []
            for rows in leaves:
                best, at = 1e-9, None
                g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
                for f, cuts in enumerate(edges):
                    for c in cuts:
                        left = [i for i in rows if x[i, f] <= c]
                        if len(left) < least or len(rows) - len(left) < least:
                            continue
                        gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        if gain > best + 1e-12:
                            best, at = gain, (f, c)
                new += [rows, []] if at is None else [[i for i in rows if x[i, at[0]] <= at[1]], [i for i in rows if x[i, at[0]] > at[1]]]
            leaves = new
        for rows in leaves:
            for i in rows:
                total[i] -= rate * sum(grad[j] for j in rows) / (sum(hess[j] for j in rows) + ridge)
    return [1 / (1 + math.exp(-t)) for t in total]


def resampled(docs: list[tuple[int, str | None]], items: list[str | None]) -> list[tuple]:
    """doc_id, n_features, weight, score, rank of each row."""
    import math

    def features(text):
        w = alnum(text)
        return w + [b" ".join(w[i : i + 2]) for i in range(len(w) - 1)]

    own = [features(t) for _, t in docs]
    s, t = (Counter(zlib.crc32(f) % 10000 for some in many for f in some) for many in (own, [features(x) for x in items]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out, may = [], []
    for (doc_id, text), some in zip(docs, own, strict=True):
        weight = sum(gain[zlib.crc32(f) % 10000] for f in some) // len(some) if some else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(some), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        may.append(len(alnum(text)) >= 20)
    best = sorted((x for x, m in zip(out, may, strict=True) if m), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for rank, x in enumerate(best[: 25 * len(best) // 100], 1):
        x[4] = rank
    return [tuple(x) for x in out]


def aligned(docs: list[tuple[int, str | None]], path_a: str, path_b: str) -> list[tuple]:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row; texts are encoded whole."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_of, b_of = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    a_of.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char, n = {b: chr(b) for b in keep}, 0
    for b in range(256):
        if b not in char:
            char[b], n = chr(256 + n), n + 1
    back = {c: b for b, c in char.items()}
    rows, counts = [], Counter()
    for doc_id, text in docs:
        groups, linked = [], []
        if text:
            a, b = a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)
            bytes_a = [bytes(back[c] for c in a_of.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
            if b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                ends = []
                for some in (bytes_a, bytes_b):
                    at, own = 0, []
                    for x in some:
                        at += len(x)
                        own.append(at)
                    ends.append(own)
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
                    groups.append((a[i:p], b[j:q]))
                    linked.append((a[p - 1], b[q - 1]))
                    i, j = p, q
        counts.update(linked)
        rows.append((doc_id, groups, linked))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for doc_id, groups, linked in rows:
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(linked), sum(counts[p] == most[p[1]] for p in linked), sum(counts[p] for p in linked), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


def plain_rules(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def kneser_ney(texts: list[tuple[str, str | None]], order: int) -> list[int]:
    """The whole cost of each (language, text), by a model over all of them, n-gram by n-gram."""
    import math

    grams = lambda t: [(b"\0" * (order - 1) + t)[i : i + order] for i in range(len(t))]
    coded = [(lang, (t or "").encode()) for lang, t in texts]
    counts = {order: Counter((lang, g) for lang, t in coded for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter((lang, g[1:]) for lang, g in counts[k + 1])
    p, rest = {0: defaultdict(lambda: 1 / 256)}, {}
    for k in range(1, order + 1):
        t1, t2, t3, t4 = (sum(n == j for n in counts[k].values()) for j in (1, 2, 3, 4))
        d = [0.5, 1.0, 1.5]
        if t1 and t2 and t3:
            y = t1 / (t1 + 2 * t2)
            d = [x if 0 < x < j + 1 else d[j] for j, x in enumerate((1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3))]
        total, off = Counter(), defaultdict(lambda: [0, 0, 0])
        for (lang, g), n in counts[k].items():
            total[lang, g[:-1]] += n
            off[lang, g[:-1]][min(n, 3) - 1] += 1
        rest[k] = {c: (d[0] * x + d[1] * y + d[2] * z) / total[c] for c, (x, y, z) in off.items()}
        p[k] = {(lang, g): (n - d[min(n, 3) - 1]) / total[lang, g[:-1]] + rest[k][lang, g[:-1]] * p[k - 1][lang, g[1:]] for (lang, g), n in counts[k].items()}
    whole = lambda x: math.floor(-math.log(x) * 65536)
    return [sum(whole(p[order][lang, g]) for g in grams(t)) for lang, t in coded]
