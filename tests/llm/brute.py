"""Plain-Python versions of the contracts, for small tables."""

import hashlib
import re
import string
import zlib


def token_rows(docs, tokenizer, end_id=1):
    """docs: (doc_id, text) pairs. Rows of op2 in order."""
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def jaccard_rows(rows, k=5, needed=75):
    """rows: (doc_id, text). (doc_id, n_shingles, component_id, n_links) of each, from all pairs."""
    sets = []
    for _, text in rows:
        w = _words(text)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= needed * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[top(i)] = min(ids.get(top(i), doc), doc)
    return [(doc, len(sets[i]), ids.get(top(i)), links[i]) for i, (doc, _) in enumerate(rows)]


def _bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def contamination_rows(docs, items, window=13):
    """docs: (doc_id, text), items: (item_id, text). Rows of op7."""
    windows = {}
    for item, text in items:
        w = _bench_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = _bench_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixing_rows(docs, weights=(3, 1, 2), share=1.5, bound=2.0, seed=17):
    """docs: (doc_id, text, source). (doc_id, size, source_size, target, copies) of each."""
    names = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(size_of(t) for _, t, x in docs if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(size.values()), {s for s in names if not size[s]}
    while True:  # share what is left by weight until no target is above its bound
        left = total - sum(bound * size[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else bound * size[s] for s in names}
        above = {s for s in free if target[s] > bound * size[s] + 1e-9}
        if not above:
            break
        fixed |= above
    out = []
    for s in names:
        own = [(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest(), size_of(t)) for d, t, x in docs if x == s]
        whole = int(target[s] / size[s] + 1e-9) if size[s] else 0
        missing = target[s] - whole * size[s]
        last, best, sums = "", abs(missing), 0
        for key in sorted({k for k, _ in own}):
            sums += sum(n for k, n in own if k == key)
            if abs(sums - missing) < best - 1e-9:
                last, best = key, abs(sums - missing)
        for d, t, x in docs:
            if x == s:
                key = hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
                out.append((d, size_of(t), size[s], target[s], whole + (missing > 1e-9 and key <= last)))
    return out
