"""Proximity and phrase matches against a plain reading of the rule."""

from __future__ import annotations

import random
from collections import Counter

from docspark.llm import decontamination
from tests.llm.brute import alnum, decontaminate


def near(rows, items, window, slop):
    """Sorted further items of every (id, text): all words of a window around its rarest word's place, and no phrase match."""
    counts = Counter(w for _, t in rows for w in alnum(t))
    windows = {}
    for item, t in items:
        ws = alnum(t)
        for s in range(max(len(ws) - window, 0) + 1 if ws else 0):
            windows.setdefault(tuple(ws[s : s + window]), set()).add(item)
    out = []
    for (_, t), (_, _, exact) in zip(rows, decontaminate(rows, items, window)):
        ws, found = alnum(t), set()
        for parts, holders in windows.items():
            if any(p not in counts for p in parts):
                continue
            _, o, term = min((counts[p], o, p) for o, p in enumerate(parts))
            for pos in (i for i, w in enumerate(ws) if w == term):
                begin = pos - o
                if set(parts) <= set(ws[max(begin - slop, 0) : begin + len(parts) + slop]):
                    found |= holders
        out.append(sorted(found - set(exact)))
    return out


def test_random_texts(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 9)))) for k in range(40)]
    items += [("again", items[3][1]), ("", items[5][1]), ("short", "w1")]
    rows = [(d, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))) if d else None) for d in range(40)]
    rows += [(d + 100, f"{items[d % 40][1]} x {' '.join(reversed(items[(d + 1) % 40][1].split()))}") for d in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontamination.find_items(docs, bench, window=5, slop=3).collect()}
    want = near(rows, items, 5, 3)
    assert sum(map(len, want)) > 20
    assert [got[d]["near_items"] for d, _ in rows] == want
    assert [(got[d]["n_words"], got[d]["n_hit"], got[d]["items"]) for d, _ in rows] == decontaminate(rows, items, 5)
    for d, t in rows:
        words = alnum(t)
        for p in got[d]["phrases"]:
            part = alnum(dict(items)[p["item"]])[p["start"] : p["start"] + 5]
            assert words[p["begin"] : p["begin"] + len(part)] == part


def test_many_near_equal_items_and_places(spark):
    """Two rare words of 300 items stand 300 times in one text: words are gathered once per window, not per place."""
    items = [(f"{i:03d}", f"rare pair {' '.join(f'c{(i + k) % 320}' for k in range(11))}") for i in range(300)]
    text = " ".join(f"rare pair c{i}" for i in range(320)) + " " + " ".join(alnum(items[7][1]))
    docs = spark.createDataFrame([(1, text), (2, "rare"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_items(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert (got[1]["items"], got[1]["n_hit"]) == (["007"], 13)
    assert got[2]["items"] == got[3]["items"] == []
