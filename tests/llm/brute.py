"""Plain versions of the operators, to hold their results against."""

from __future__ import annotations

import re


def sentences(text: str) -> list[str]:
    """Lines and sentences with the white space behind them; one of one word, in a line, goes with the one before."""
    ends, at = [], 0
    while match := re.compile(r"\n|[.!?;](?:[^\w\s]|_)*\s").search(text, at):
        at = re.compile(r"\s*").match(text, match.end()).end()
        if at < len(text):
            ends.append(at)
    out: list[str] = []
    for a, b in zip([0, *ends], [*ends, len(text)], strict=True):
        own = text[a:b]
        if out and len(own.split()) == 1 and own == own.strip() + " " and b < len(text) and not out[-1].endswith("\n"):
            out[-1] += own
        else:
            out.append(own)
    return out


def units(text: str, most: int) -> list[str]:
    """Sentences; those of more than ``most`` words are cut after words of the first kind that occurs, and so on."""
    kinds = [lambda w, c=c: w[-1] in c for c in (",;:)]dl", "ghyfkp", "uizmcbv", "an", "ro", "ts")]
    kinds += [lambda w, a=a, b=b: a <= len(w) <= b for a, b in ((12, 10**9), (9, 10**9), (7, 10**9), (5, 10**9), (4, 4), (3, 3), (1, 2))]
    parts = sentences(text)
    for kind in kinds:
        cut = []
        for part in parts:
            if len(part.split()) <= most:
                cut.append(part)
                continue
            words = re.findall(r"\s*\S+\s*", part)
            now = ""
            for word in words:
                now += word
                if kind(word.strip()) and word[-1].isspace():
                    cut.append(now)
                    now = ""
            if now:
                cut.append(now)
        parts = cut
    return parts


def line_dedup(docs: list[tuple[int, str]], min_words: int) -> dict[int, str]:
    """Delete every unit in a run of ``min_words`` words that occurs at an earlier place."""
    docs = sorted(docs)
    cut = {d: units(t or "", max(min_words // 2, 1)) for d, t in docs}
    plain = {d: [u.strip() for u in us] for d, us in cut.items()}
    seen: set[tuple[str, ...]] = set()
    out = {}
    for d, _ in docs:
        own, drop = plain[d], set()
        for a in range(len(own)):
            words = 0
            for b in range(a, len(own)):
                words += len(own[b].split())
                key = tuple(own[a : b + 1])
                if words >= min_words:
                    if key in seen:
                        drop |= set(range(a, b + 1))
                    seen.add(key)
                if words >= 4 * min_words:
                    break  # longer runs are made of shorter ones
        out[d] = "".join(u for k, u in enumerate(cut[d]) if k not in drop)
    return out


def word_set(text: str | None) -> frozenset[tuple[str, ...]]:
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if 0 < len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def jaccard_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to (size of its set, smallest doc_id of its component)."""
    sets = {d: word_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    lists: dict[tuple[str, ...], list[int]] = {}
    for d in sorted(sets):
        near = {o for shingle in sets[d] for o in lists.get(shingle, [])}
        for o in near:
            both = len(sets[d] & sets[o])
            if 100 * both >= 75 * len(sets[d] | sets[o]):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
        for shingle in sets[d]:
            lists.setdefault(shingle, []).append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def tiling(doc: list[str], item: list[str], least: int) -> int:
    """Greedy string tiling by its definition: words of the item covered by tiles."""
    used_doc, used_item = [False] * len(doc), [False] * len(item)
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not used_doc[i + n] and not used_item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, j, i)
        if best[0] < least:
            return sum(used_item)
        for x in range(best[0]):
            used_item[best[1] + x] = used_doc[best[2] + x] = True
