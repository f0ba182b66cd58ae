"""Small tables with the odd rows that every operator must take, and plain versions to compare with."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

#: Columns that the operators use inside, as extra columns of the input.
CLASHING = ["key", "tag", "node", "row", "label", "band", "doc", "start", "length", "_key", "id", "n_words"]
LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
ODD = [(5, None), (6, ""), (7, " \n\t "), (None, "a text without an id, of some more words than a few"),
       (8, LONG), (9, "one two three"), (9, "one two three"), (10, "one two three"), (11, "!!! ??? ..."),
       (12, "Ünïcode wörds \u00a0 stay \u2028 together <|endoftext|> it's 42")]


def odd_table(spark, extra=True):
    rows = [(i, t, "en" if i and i % 2 else None, "s", len(t or "")) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in CLASHING:
            df = df.selectExpr("*", f"'{c}' AS `{c}`")
    return df


def empty_table(spark):
    return odd_table(spark, extra=False).where("false")


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def bag(text, width=5) -> Counter:
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def similarity(a: Counter, b: Counter) -> float:
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def groups(texts: dict[int, str | None], least=0.8) -> dict[int, int]:
    """Least id of the group of each document, from all pairs that share a shingle."""
    bags = {i: bag(t) for i, t in texts.items()}
    holders: dict = {}
    for i, b in bags.items():
        for s in b:
            holders.setdefault(s, []).append(i)
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    pairs |= set(combinations(sorted(i for i, t in texts.items() if not t), 2))
    for a, b in pairs:
        if (texts[a] or "") == (texts[b] or "") or similarity(bags[a], bags[b]) >= least:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in texts}


def without_repeats(texts: dict[int, str | None], width=13) -> dict[int, list[bytes]]:
    """Words left of each document."""
    first: dict = {}
    split = {i: words(t) for i, t in texts.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][k:k + width]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def leaks(texts: dict[int, str | None], items: dict[int, str | None], least=0.8) -> dict:
    """Best similarity of each document and item by trying every window."""
    found, wanted = {}, {i: bag(t) for i, t in items.items() if words(t)}
    holders: dict = {}
    for i, b in wanted.items():
        for s in b:
            holders.setdefault(s, set()).add(i)
    for d, t in texts.items():
        w = words(t)
        runs = [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        for i in {i for s in runs for i in holders.get(s, ())}:
            n = min(sum(wanted[i].values()), len(runs))
            best = max(similarity(Counter(runs[k:k + n]), wanted[i]) for k in range(len(runs) - n + 1)
                       if sum(x in wanted[i] for x in runs[k:k + n]) * 2 >= n or k == 0)
            if best >= least:
                found[d, i] = best
    return found
