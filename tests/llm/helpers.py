"""Documents with every awkward case, and brute-force forms of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, id string, `key` string, rank int"


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward_rows(seed: int = 5) -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, near copies, and clashing extra columns."""
    r = random.Random(seed)
    base = sentence(r, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    texts = [
        None, "", "   \n\t ", "a", "one two three four", base, base, near, base.upper(), sentence(r, 60), "x" * 300_000, ("word " * 40_000).strip(),
        "line one here\n" * 30, "Mail a.b@c.example.com or +1 (555) 123-4567 now", "é" * 50 + " ñandú", "\x01\x02 ∑ 日本語 テキスト", sentence(r, 3000),
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 2}" if i % 5 else None, len(t) if t is not None else None, True, "s", "i", "k", 1) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [rows[5], rows[9], rows[9]]  # repeated rows
    return rows


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None, size: int = 5) -> frozenset:
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows: list[tuple[int, str | None]], percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest linked id), comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    ids = list(sets)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}
