"""Plain-Python versions of the corpus operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from docspark.llm import language_id, license_scan, quality, url_filter
from docspark.llm.common import LAST_ID

WHITE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(text):
    return WHITE_WORD.findall(text or "")


def alnum(text):
    return ALNUM_WORD.findall(low(text))


def order(doc_id):
    return LAST_ID if doc_id is None else doc_id


def src(value):
    return "-" if value is None else f"+{value}"


def shuffle_key(seed, doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    return hashlib.md5(f"{seed}|{src(doc_id)}|{inner}".encode()).hexdigest()


def substring_dedup(rows, window=50):
    """(n_words, n_removed, sha256) of every row."""
    first = {}
    for d, t in rows:
        w = plain(t)
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            first[g] = min(first.get(g, LAST_ID), order(d))
    out = []
    for d, t in rows:
        w = plain(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < order(d):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def unigram(word, scores):
    """Pieces of the best segmentation; a character without a piece counts as its UTF-8 bytes."""
    unknown = min(scores.values()) - 10
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for e in range(1, len(word) + 1):
        for b in range(e):
            piece = word[b:e]
            if piece in scores and best[b][0] + scores[piece] > best[e][0]:
                best[e] = (best[b][0] + scores[piece], best[b][1] + 1)
            if e - b == 1 and best[b][0] + unknown > best[e][0]:
                best[e] = (best[b][0] + unknown, best[b][1] + len(piece.encode()))
    return best[-1][1]


def license_labels(text):
    """(n_words, places, base labels, labels, score)."""
    w = alnum(text)
    places, base = [], set()
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    labels, share = set(base), 0.0
    for label, template in license_scan.TEMPLATES:
        members, span = set(license_scan.template_words(template)), len(license_scan.template_sequence(template)) + license_scan.MARGIN
        most = max((len(members.intersection(w[i : i + span])) for i in range(len(w))), default=0)
        if most >= math.ceil(license_scan.THRESHOLD * len(members) - 1e-9):
            labels.add(label)
            share = max(share, most / len(members))
    return len(w), sorted(places), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else share


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
    return low(host), path


def url_rule(host, path):
    fits = [(h, p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: len(r[0]) + len(r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def mix(rows, seed, weights=(3, 1, 2)):
    """(size, source_size, target, epochs) of every (doc_id, text, source)."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(plain(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    extra = set()
    for s in names:
        units = Counter()
        for d, t, x in rows:
            if x == s:
                units[shuffle_key(seed, d, t)] += len(plain(t))
        rest = target[s] - (target[s] // sizes[s] * sizes[s] if sizes[s] else 0)
        at = 0
        for key in sorted(units):
            if at < rest and 2 * at + units[key] <= 2 * rest:
                extra.add((s, key))
            at += units[key]
    return [(len(plain(t)), sizes[s], target[s], int(target[s] // sizes[s] if sizes[s] else 0) + ((s, shuffle_key(seed, d, t)) in extra)) for d, t, s in rows]


def repeated(w):
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    return len({p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)})


def norm_line(line):
    return " ".join(plain(low(line)))


def line_fates(rows):
    """(words of common lines with another first holder, rescued, lines lost to another document, kept) of every (doc_id, text, host)."""
    failed, held, found = [], Counter(), []
    for _, t, h in rows:
        w = plain(t)
        failed.append(len(w) < 50 or 100 * repeated(w) > 50 * len(w))
        found.append([norm_line(x) for x in (t or "").split("\n") if plain(x)])
        held.update((h, x) for x in set(found[-1]))
    common = {k for k, n in held.items() if n > quality.LINE_DOCS}
    holders = defaultdict(list)
    for i, (d, _, h) in enumerate(rows):
        for x in set(found[i]):
            if (h, x) in common and not failed[i]:
                holders[h, x].append(i)
    ids = [order(d) for d, *_ in rows]
    first = {k: min(ids[i] for i in v) for k, v in holders.items()}
    gone, thin = [], []
    for i, (_, t, h) in enumerate(rows):
        gone.append(sum(len(x.split(" ")) for x in found[i] if first.get((h, x), ids[i]) < ids[i]))
        thin.append(len(plain(t)) - gone[-1] < quality.KEPT_SHARE * len(plain(t)))
    chosen = {(k[0], min(v, key=lambda i: (hashlib.md5(str(ids[i]).encode()).hexdigest(), ids[i]))) for k, v in holders.items() if all(thin[i] for i in v)}
    chosen = {(h, ids[i]) for h, i in chosen}
    rescued = [
        not failed[i] and (h, ids[i]) in chosen and any((h, x) in common for x in found[i]) for i, (_, _, h) in enumerate(rows)
    ]
    kept = [not failed[i] and (not thin[i] or rescued[i]) for i in range(len(rows))]
    owner = {k: min((ids[i] for i in v if kept[i]), default=None) for k, v in holders.items()}
    lost = [{x for x in found[i] if owner.get((h, x), ids[i]) != ids[i]} for i, (_, _, h) in enumerate(rows)]
    return list(zip(gone, rescued, lost, kept))


def without_lines(text, lost):
    return "\n".join(x for x in text.split("\n") if norm_line(x) not in lost) if lost else text


def quality_rules(rows):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every (doc_id, text, host)."""
    out = []
    for (_, t, _), (*_, kept) in zip(rows, line_fates(rows)):
        w, lines = plain(t), [x for x in (t or "").split("\n") if plain(x)]
        failed = len(w) < 50 or 100 * repeated(w) > 50 * len(w)
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        out.append((len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), repeated(w), failed, kept))
    return out


def decontaminate(rows, items, window=13):
    """(n_words, n_hit, items) of every (doc_id, text)."""
    wanted = defaultdict(set)
    for item, t in items:
        w = alnum(t)
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            wanted[tuple(w[s : s + window])].add(item)
    sizes = {len(g) for g in wanted}
    out = []
    for _, t in rows:
        w, hit, names = alnum(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out.append((len(w), len(hit), sorted(map(str, names))))
    return out


def shards(rows, seed, shards=40):
    """(doc_id, source, size, crc, place, shard, slot), in order of place."""
    groups = defaultdict(list)
    for d, t, s in rows:
        groups[s].append((shuffle_key(seed, d, t), d, t))
    placed = []
    for s, g in groups.items():
        for i, (key, d, t) in enumerate(sorted(g, key=lambda x: x[0])):
            placed.append(((2 * i + 1) / (2.0 * len(g)), key, src(s), i, d, t, s))
    out, total = [], len(rows)
    for place, (*_, d, t, s) in enumerate(sorted(placed, key=lambda x: x[:4])):
        shard = place * shards // total
        data = (t or "").encode()
        out.append((d, s, len(data) + 16, zlib.crc32(data), place, shard, place - -(-shard * total // shards)))
    return out


def fingerprint(text):
    w = (text or "").encode().lower().split()
    size = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(len(w) - size + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(rows):
    """(fingerprint, component_id) of every (doc_id, text)."""
    prints = [fingerprint(t) for _, t in rows]
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    least = {}
    for (d, _), v in zip(rows, prints):
        least[root(v)] = min(least.get(root(v), LAST_ID), order(d))
    return [(f"{v:016x}", None if least[root(v)] == LAST_ID else least[root(v)]) for v in prints]


def pipeline(rows, items, mix_seed, shard_seed):
    """Rows of the last stage for (doc_id, text, source)."""
    rows = [(d, without_lines(t, lost), s) for (d, t, s), (_, _, lost, kept) in zip(rows, line_fates(rows)) if kept]
    rows = [r for r, g in zip(rows, simhash_groups([r[:2] for r in rows])) if g[1] == r[0]]
    rows = [r for r, (n, hit, _) in zip(rows, decontaminate([r[:2] for r in rows], items)) if not (hit and 20 * hit >= n)]
    rows = [r for r, m in zip(rows, mix(rows, mix_seed)) for _ in range(m[3])]
    return shards(rows, shard_seed)


def language(model, text):
    """(language, probability) of a text under a trained model, n-gram by n-gram."""
    spaced = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())) + " "
    z, count = [0.0] * len(model.languages), 0
    for size in language_id.SIZES:
        for at in range(len(spaced) - size + 1):
            code = size
            for c in spaced[at : at + size]:
                code = (code ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                code ^= code >> 29
            count += 1
            for i in range(len(z)):
                z[i] += float(model.table[code % language_id.BUCKETS][i])
    if not spaced.strip(" "):
        return language_id.UNKNOWN, 0.0
    e = [math.exp((x / count + float(b)) / model.temperature) for x, b in zip(z, model.bias)]
    best = max(range(len(e)), key=lambda i: e[i])
    return model.languages[best], e[best] / sum(e)
