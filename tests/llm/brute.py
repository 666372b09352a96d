"""Brute-force versions and the awkward rows every operator is run on."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, score string, label int"


def awkward(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows and ids, and columns whose names clash."""
    long = " ".join(f"w{i % 977}" for i in range(30_000)) + "\nend"
    texts = [(1, "a b c\nshared line here\nd e f"), (2, "a b  c\nshared line here\nd e f"), (3, None), (4, ""), (5, " \t\n"), (6, long), (7, long + " x"), (8, "shared line here\nother"), (None, "no id at all"), (9, "tie"), (9, "tie"), (9, "another text of the same id"), (10, "émoji 🙂 naïve Straße"), (11, "<|endoftext|> inside")]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "clash", "clash", "clash", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact(rows):
    """rows: (doc_id, text) -> sorted (doc_id, keep_id, group_size, sha256)."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, most=3):
    """Smallest id reachable by links of `most` bits or fewer."""
    fps = np.array(fps, np.uint64)
    label = list(range(len(ids)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= most).tolist():
            a, b = root(k), root(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) for k in range(len(ids))]


def base_stats(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = WORD.findall(text)
    seen, hit = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(p for i in at for p in range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def chunk_bytes(raw, table, smallest, largest, bits):
    """Chunks by the definition: the gear hash over the last 32 bytes is computed anew for each place."""
    out, begin = [], 0
    for e in range(1, len(raw) + 1):
        inside = e < len(raw) and raw[e] & 0xC0 == 0x80
        h = sum(table[raw[e - 1 - j]] << j for j in range(min(32, e))) % (1 << 32)
        if e - begin == largest:
            stop = e
            while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                stop -= 1
            if stop < e or not (h >> (32 - bits) == 0 and not inside):
                out.append(raw[begin:stop])
                begin = stop
                continue
        if e - begin >= smallest and h >> (32 - bits) == 0 and not inside:
            out.append(raw[begin:e])
            begin = e
    return [*out, raw[begin:]] if begin < len(raw) else out


def without_passages(rows, table, smallest, largest, bits, run_bytes):
    """rows: (doc_id, text) -> (doc_id, text left, chunks, characters removed, spans): the first holder of a chunk keeps it."""
    parts = [chunk_bytes((t or "").encode(), table, smallest, largest, bits) for _, t in rows]
    holders = {}
    for (i, _), ps in zip(rows, parts, strict=True):
        for p in ps:
            if i is not None:
                holders[p] = min(i, holders.get(p, i))
    out = []
    for (i, t), ps in zip(rows, parts, strict=True):
        seen, flags = set(), []
        for p in ps:
            flags.append(p in seen or (i is not None and holders[p] < i))
            seen.add(p)
        left, spans, chars, k = "", [], 0, 0
        while k < len(ps):
            j = k
            while j < len(ps) and flags[j] == flags[k]:
                j += 1
            piece = b"".join(ps[k:j])
            n = len(piece.decode())
            if flags[k] and len(piece) >= run_bytes:
                spans.append([chars, chars + n])
            else:
                left += piece.decode()
            chars += n
            k = j
        out.append((i, left if t is not None else None, len(ps), sum(b - a for a, b in spans), str(spans)))
    return out


def languages(rows, letters):
    """rows: (doc_id, lang, text) -> {doc_id: (language, score)}: words first, then the longest n-grams that are known."""
    seen = defaultdict(Counter)
    for i, lang, text in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 5:
            seen[lang].update(letters.findall((text or "").lower()))
    names = sorted(seen)
    counts = {k: {w: n for w, n in c.items() if n > 1} for k, c in seen.items()}
    grams = {n: {k: Counter() for k in names} for n in range(1, 6)}

    def cut(w, n):
        full = w if n == 1 else f"^{w}$"
        return [full[i : i + n] for i in range(len(full) - n + 1)]

    for k in names:
        for w, c in counts[k].items():
            for n in range(1, 6):
                for g in cut(w, n):
                    grams[n][k][g] += c

    def logs(held, known):
        totals = {k: math.log(sum(held[k].values()) + 0.5 * max(1, len(known))) for k in names}
        return lambda x: [math.log(held[k].get(x, 0) + 0.5) - totals[k] for k in names]

    words = set().union(*counts.values())
    known = {n: {g for g, c in sum(grams[n].values(), Counter()).items() if c >= 3} for n in grams}
    of_word, of_gram = logs(counts, words), {n: logs(grams[n], known[n]) for n in grams}

    def score(w):
        if w in words:
            return of_word(w)
        for n in (5, 4, 3, 2, 1):
            hits = [of_gram[n](g) for g in cut(w, n) if g in known[n]]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return [0.0] * len(names)

    out, memo = {}, {}
    for i, _, text in rows:
        found = letters.findall((text or "").lower())
        if not found:
            out[i] = ("und", 0.0)
            continue
        for w in set(found) - memo.keys():
            memo[w] = score(w)
        total = [sum(x) for x in zip(*(memo[w] for w in found), strict=True)]
        best = max(range(len(names)), key=lambda k: (total[k], -k))
        z = [(t - total[best]) / len(found) * min(len(found), 20) for t in total]
        out[i] = (names[best], 1 / sum(map(math.exp, z)))
    return out
