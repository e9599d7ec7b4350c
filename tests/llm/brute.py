"""Plain single-machine versions of the operators' contracts."""

import base64
import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rule_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(docs, items):
    """docs: [(id, text)], items: [(id, text)] -> {id: (n_words, n_hit, items)}"""
    windows: dict = {}
    for i, t in items:
        w = bench_words(t)
        if w:
            n = min(13, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    out = {}
    for i, t in docs:
        w, hit, found = bench_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(docs, percent=85):
    """{id: (set size, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = Counter()
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                pairs[own[a], own[b]] += 1
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def line_dedup(docs):
    """{id: (lines, removed, text)}; docs in order of id."""
    seen, out = set(), {}
    for i, t in docs:
        lines = t.split("\n") if t is not None else []
        gone = set()
        n = min(3, len(lines))  # a text of one or two lines is one window
        for k in range(len(lines) - n + 1 if lines else 0):
            w = tuple(lines[k : k + n])
            if "".join(w).strip(" \t\n\v\f\r"):
                if w in seen:
                    gone |= set(range(k, k + n))
                seen.add(w)
        out[i] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


SECRETS = {
    "assign": re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text):
    keep = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "hex": lambda m: len(m[0]) >= 16}
    return sorted(((m.start(), k, name, m.end()) for k, (name, p) in enumerate(SECRETS.items()) for m in p.finditer(text or "") if keep[name](m)))


def warc_rows(pages):
    """{page_id: (bytes, digest, type, refers_to)}"""
    last: dict = {}
    for i, html in pages:
        last[html or ""] = max(i, last.get(html or "", i))
    out = {}
    for i, html in pages:
        data = (html or "").encode()
        keep = last[html or ""]
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if keep == i else "revisit", None if keep == i else keep)
    return out


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def quality_features(text):
    """The sixteen features of the quality model, counted one character at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if not n:
        return [0.0] * 16
    size = lambda w: len(w.encode())
    chars = sum(1 for c in text if c not in " \t\n\v\f\r")
    among = lambda s: sum(1 for c in text if c in s)
    upper, lower, other = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text), sum(ord(c) > 127 for c in text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    pairs = list(zip(words, words[1:]))
    return [
        math.log(n + 1), chars / n, among("|#*$%&<>") / n, upper / max(1, upper + lower + other), among("0123456789") / chars, among(".?") / n, among("!") / n, len(set(words)) / n**0.75,
        sum(a == b for a, b in pairs) / n, 1 - len(set(lines)) / len(lines), n / len(lines), math.log(max(map(size, words)) + 1), other / chars, among("|") / n,
        len(set(pairs)) / max(1, n - 1), sum(size(w) <= 3 for w in words) / n,
    ]


def gam_score(model, text):
    x = quality_features(text)
    place = lambda cuts, v: sum(1 for c in cuts if c <= v)
    total = model.intercept + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x))
    total += sum(t[place(model.coarse[i], x[i])][place(model.coarse[j], x[j])] for i, j, t in model.pairs)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def gru_states(gru, data):
    """One direction of the network, byte by byte."""
    n = gru.h.shape[1]
    h, out = [0.0] * n, []
    for byte in data:
        x = [float(v) for v in gru.x[:, byte]]
        hard = lambda a: min(1.0, max(0.0, a / 4 + 0.5))
        z = [hard(x[i] + sum(float(gru.h[i, j]) * h[j] for j in range(n))) for i in range(n)]
        r = [hard(x[n + i] + sum(float(gru.h[n + i, j]) * h[j] for j in range(n))) for i in range(n)]
        c = [math.tanh(x[2 * n + i] + sum(float(gru.h[2 * n + i, j]) * r[j] * h[j] for j in range(n))) for i in range(n)]
        h = [h[i] + z[i] * (c[i] - h[i]) for i in range(n)]
        out.append(h)
    return out


def language_probabilities(model, data, window):
    """Mean over all positions of each position's softmax; each window of bytes is read by itself, both ways."""
    total = [0.0] * len(model.languages)
    for at in range(0, len(data), window):
        part = data[at : at + window]
        for f, b in zip(gru_states(model.forward, part), gru_states(model.backward, part[::-1])[::-1]):
            e = [math.exp(float(model.bias[k]) + sum(float(w) * s for w, s in zip(model.weights[k], f + b))) for k in range(len(total))]
            total = [t + x / sum(e) for t, x in zip(total, e)]
    return [t / max(1, len(data)) for t in total]


def half_of(doc_id):
    import xxhash

    return xxhash.xxh64_intdigest(b"half", seed=xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)) & 1


def rule_cells(text):
    """Each rule's statistic, as a cell of 1,024."""
    n, chars, symbols, dup, repeats = rule_base(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, bangs, bars = sum("A" <= c <= "Z" for c in text or ""), (text or "").count("!"), (text or "").count("|")
    m, k = max(n, 1), max(chars, 1)
    parts = {
        "symbols": symbols / (symbols + 0.25 * m), "dup_lines": dup / max(len(lines), 1), "repeats": repeats / m, "long_words": chars / (chars + 8 * m), "upper": upper / k,
        "bangs": bangs / (bangs + 0.25 * m), "bars": bars / (bars + 0.25 * m), "few_chars": m / (m + chars), "few_words": 10 / (10 + n),
    }
    return {r: math.floor(1024 * x) for r, x in parts.items()}


def quality_verdicts(docs, good, levels, limit=0.03, error=0.05, languages=("en", "de", "fr", "es")):
    """docs: [(id, text, lang)], one row an id; good: ids of label 1 -> {id: kept}."""
    base = {i: rule_base(t)[0] < 10 or 100 * rule_base(t)[4] > 20 * rule_base(t)[0] for i, t, _ in docs}
    cells = {i: rule_cells(t) for i, t, _ in docs}
    stratum = {i: g if g in languages else "other" for i, _, g in docs}
    chosen = {}
    for s in {*languages, "other"}:
        own = [i for i, _, _ in docs if stratum[i] == s and i in good and not base[i]]
        first, second = [i for i in own if half_of(i) == 0], [i for i in own if half_of(i) == 1]
        if not first or not second:
            continue
        for share in levels:
            cutoffs = {}
            for r in cells[first[0]]:
                values = sorted((cells[i][r] for i in first), reverse=True)
                # the smallest observed cell above which lie at most that share
                cutoffs[r] = next((v for v in sorted(set(values), reverse=True) if sum(x >= v for x in values) > share * len(values)), 0)
            rejected = sum(any(cells[i][r] > c for r, c in cutoffs.items()) for i in second)
            n = len(second)
            if math.fsum(math.comb(n, k) * limit**k * (1 - limit) ** (n - k) for k in range(rejected + 1)) > error / (len(languages) + 1):
                break
            chosen[s] = cutoffs
    return {i: not base[i] and not any(cells[i][r] > c for r, c in chosen.get(stratum[i], {}).items()) for i, _, _ in docs}


def run_up(nodes):
    """Levels of a tree: every eight consecutive digests become that of their texts."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def merkle_rows(docs):
    """docs: [(doc_id, source, lang, n_chars, text)] -> sorted rows of the contract."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d: sha("".join(map(field, d)))
    by: dict = {}
    for d in docs:
        by.setdefault(d[2], []).append(d)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for own in by.values():
        own.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
    trees = {g: run_up([leaf(d) for d in by[g]]) for g in langs}
    top = run_up([trees[g][-1][0] for g in langs])
    out = []
    for place, g in enumerate(langs):
        for i, d in enumerate(by[g]):
            odd = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 and d[4] is not None
            node, proof = leaf((*d[:4], lower(d[4]))) if odd else leaf(d), ""
            for levels, at in ((trees[g], i), (top, place)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    left, right = run[: at % 8], run[at % 8 + 1 :]
                    proof += "".join(left + right)
                    node, at = sha("".join([*left, node, *right])), at // 8
            out.append((d[0], leaf(d), trees[g][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def hard_negatives(rows, positives=5, negatives=10, every=100):
    """rows: [(vec_id, vector, label)] -> sorted rows of the contract, in Python integers."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in fine]
    out = []
    for at, (i, v, y) in enumerate(fine):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z == y) for k, (j, w, z) in enumerate(fine) if k != at and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            found = [s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, rank, n, -p, -q) for rank, (q, n, _) in enumerate(found, 1)]
    return sorted(out)
