"""Which of many strings occur in a text, without scanning the text once per string."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1 << 20
FEW = 8


def missing(needles: Column, text: Column, piece: int = PIECE, few: int = FEW) -> Column:
    """For every string of the array ``needles``: does it occur nowhere in ``text``?

    Strings equal to a trimmed line of the text are settled by a set. The others go by their length: more than ``few`` of a
    length are looked up in one pass of rolling hashes over the text's windows of that length, and every hit is compared
    at its place; fewer are searched for one by one. Strings of total length t have at most sqrt(2t) lengths, so the
    work is text times that, not text times strings. The text is hashed in pieces of ``piece`` characters (or of the longest string,
    if that is more), so memory beyond the text itself stays bounded. Null needles or a null text give null; the empty string occurs everywhere.
    """
    work = _absent(piece, few)

    @F.arrow_udf("array<boolean>")
    def absent(needle_lists: pa.Array, texts: pa.Array) -> pa.Array:
        return work(needle_lists, texts)

    return absent(needles, text)


def _absent(piece: int, few: int):
    """The work of ``missing`` on Arrow arrays; one row at a time becomes Python strings."""
    def absent(needle_lists, texts):
        import numpy as np
        import pyarrow as pa

        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)

        def powers(of: int, n: int):
            steps = np.full(n, of, dtype=np.uint64)
            steps[:1] = 1
            return np.cumprod(steps, dtype=np.uint64)

        def codes(s: str):
            return np.frombuffer(s.encode("utf-32-le"), dtype="<u4").astype(np.uint64)

        def settle(open_by_length: dict[int, list[str]], text: str) -> set[str]:
            """Those that occur, by rolling hashes: the sum of code * base^place over a window, shifted back to place 0."""
            longest = max(open_by_length)
            step = max(piece, longest)
            size = min(len(text), step + longest - 1)
            up, down = powers(base, size), powers(inverse, size)
            wanted = {}
            for length, strings in open_by_length.items():
                by_hash: dict[int, list[str]] = {}
                for s in strings:
                    by_hash.setdefault(int((codes(s) * up[:length]).sum(dtype=np.uint64)), []).append(s)
                wanted[length] = by_hash
            found: set[str] = set()
            for begin in range(0, len(text), step):
                part = codes(text[begin : begin + step + longest - 1])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
                for length, by_hash in wanted.items():
                    n = len(part) - length + 1
                    if n <= 0 or not by_hash:
                        continue
                    hashes = (sums[length:] - sums[:n]) * down[:n]
                    targets = np.sort(np.fromiter(by_hash, dtype=np.uint64, count=len(by_hash)))
                    slot = np.minimum(np.searchsorted(targets, hashes), len(targets) - 1)
                    hits = np.flatnonzero(targets[slot] == hashes)
                    which, first = np.unique(slot[hits], return_index=True)
                    for target, place in zip(targets[which].tolist(), hits[first].tolist()):
                        found.update(s for s in by_hash.pop(target) if text.startswith(s, begin + place) or s in text)
            return found

        def one(needle_list, text):
            if needle_list is None or text is None:
                return None
            lines = {line.strip() for line in text.split("\n")}
            open_by_length: dict[int, list[str]] = {}
            for s in {n for n in needle_list if n} - lines:
                if len(s) <= len(text):
                    open_by_length.setdefault(len(s), []).append(s)
            found = {s for group in open_by_length.values() if len(group) <= few for s in group if s in text}
            many = {length: group for length, group in open_by_length.items() if len(group) > few}
            if many:
                found |= settle(many, text)
            return [None if n is None else n != "" and n not in lines and n not in found for n in needle_list]

        return pa.array((one(n.as_py(), t.as_py()) for n, t in zip(needle_lists, texts)), pa.list_(pa.bool_()), size=len(texts))

    return absent
