"""Plain versions of the operators, from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def near_duplicates(docs, k, percent):
    sets = {}
    for d, text in docs:
        w = SPACED.findall(lower(text))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def quality(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def decontaminate(docs, items, size=10):
    windows = defaultdict(set)
    for i, text in items:
        w = ALNUM.findall(lower(text))
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[j : j + size])].add(i)
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    spans = []
    for rank, (kind, pattern, good) in enumerate(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
        ]
    ):
        spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text) if good(m[0])]
    spans.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    count = Counter(k for _, _, k, _ in spans)
    return count["email"], count["ip"], count["card"], count["phone"], hashlib.sha256(joined.encode()).hexdigest(), {f"{k}:{a}:{b}" for a, _, k, b in spans}


def pieces(text, tokenizer, size=1024):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % size or size
    cuts = [0, *range(first, len(ids), size), len(ids)]
    return [(i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def line_dedup(docs, min_sites, min_words):
    sites, first = defaultdict(set), {}
    for d, text, source in docs:
        for i, x in enumerate((text or "").split("\n")):
            if len(SPACED.findall(x)) >= min_words:
                sites[x].add(source or "")
                first[x] = min(first.get(x, (d, i)), (d, i))
    out = {}
    for d, text, source in docs:
        lines = (text or "").split("\n")
        left = [x for i, x in enumerate(lines) if len(sites[x]) < min_sites or first[x] == (d, i)]
        out[d] = (len(lines), len(lines) - len(left), None if text is None else "\n".join(left))
    return out


def chat(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        turns[c].append((turn, role or "", text or ""))
    out = {}
    for c, ts in turns.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def best_fit(counts, size):
    """Best fit decreasing: the number of sequences, each piece in turn into the smallest gap that holds it."""
    gaps, opened = Counter(), 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = next((g for g in range(length, size + 1) if gaps[g]), None)
            if gap is None:
                gaps[gap := size] = fresh = -(-left // (size // length))
                opened += fresh
            taken = min(gaps[gap], left)
            gaps[gap] -= taken
            gaps[gap - length] += taken
            left -= taken
    return opened


def weak_labels(votes, counts, rounds):
    """Dawid and Skene's model of independent labelers for two truths, voter by voter, with the operator's start and pseudo-counts."""
    n_voters = len(votes[0])
    p = [min(0.95, max(0.05, 0.5 + sum(v) / (2.2 * n_voters))) for v in votes]
    for _ in range(rounds):
        prior = sum(c * q for c, q in zip(counts, p)) / sum(counts)
        rates = []
        for j in range(n_voters):
            by_truth = []
            for truth in (1, 0):
                seen = {-1: 0.1, 0: 0.5, 1: 0.1}
                seen[1 if truth else -1] = 0.5
                for v, c, q in zip(votes, counts, p):
                    seen[v[j]] += c * (q if truth else 1 - q)
                by_truth.append({v: x / sum(seen.values()) for v, x in seen.items()})
            rates.append(by_truth)
        out = []
        for v in votes:
            yes, no = prior, 1 - prior
            for j in range(n_voters):
                yes, no = yes * rates[j][0][v[j]], no * rates[j][1][v[j]]
            out.append(min(1 - 1e-6, max(1e-6, yes / (yes + no))))
        p = out
    return p


def kept(docs, prior=200, spread=3):
    """Whether the quality rules keep each of ``docs`` (doc_id, text, lang, source), in order."""
    slack = {"symbols": (1 << 60, 150), "dup_lines": (1 << 60, 400), "word_length": (1500, 1500)}
    rows = []
    for _, text, lang, source in docs:
        n, chars, symbols, dup, _, failed = quality(text)
        lines = sum(bool(SPACED.search(x)) for x in (text or "").split("\n"))
        values = {"symbols": symbols * 1000 // max(n, 1), "dup_lines": dup * 1000 // max(lines, 1), "word_length": chars * 1000 // max(n, 1)}
        rows.append((lang, source, failed, values))

    def quartiles(feature, group):
        bins = Counter((v >> max(v.bit_length() - 5, 0)) << max(v.bit_length() - 5, 0) for lang, source, failed, values in rows if not failed and group(lang, source) for v in [values[feature]])
        n, out = sum(bins.values()), []
        for q in (1, 3):
            upto = 0
            for b in sorted(bins):
                upto += bins[b]
                if upto * 4 >= n * q:
                    out.append(b)
                    break
        return n, out

    fences = {}
    for lang, source in {r[:2] for r in rows if not r[2]}:
        for f in slack:
            n, own = quartiles(f, lambda a, b: (a, b) == (lang, source))
            m, wide = quartiles(f, lambda a, b: a == lang)
            _, every = quartiles(f, lambda a, b: True)
            near = [(n * o + prior * ((m * w + prior * e) // (m + prior))) // (n + prior) for o, w, e in zip(own, wide, every)]
            gap = spread * (near[1] - near[0])
            fences[lang, source, f] = near[0] - gap - slack[f][0], near[1] + gap + slack[f][1]
    return [not failed and all(fences[lang, source, f][0] <= v <= fences[lang, source, f][1] for f, v in values.items()) for lang, source, failed, values in rows]
