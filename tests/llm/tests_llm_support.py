import re
from collections import Counter

from kindred.llm import quality_rules as q


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(k, len(w)) or 1
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_targets(sizes, weights, share=1.5, most=2.0):
    """Water-filling: all sources above their bound are set to it, round by round."""
    want, left, free = {}, share * sum(sizes.values()), {k for k in sizes if weights[k]}
    while free:
        over = [k for k in free if weights[k] * left / sum(weights[j] for j in free) > most * sizes[k]]
        if not over:
            return want | {k: weights[k] * left / sum(weights[j] for j in free) for k in free}
        want |= {k: most * sizes[k] for k in over}
        left, free = left - sum(most * sizes[k] for k in over), free - set(over)
    return want


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
    m = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines),
        "n_stop_words": sum(x.lower() in q.WORDS_TO_STOP for x in w), "n_bullet_lines": sum(bool(re.match(r"[-*•]\s", x.lstrip(" "))) for x in lines), "n_cut_lines": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
    }
    bad = any((100 * m[r.part] > r.percent * m[r.whole]) if r.sense == ">" else (100 * m[r.part] < r.percent * m[r.whole]) for r in (*q.BASE_RULES, *q.RULES) if m["n_words"] >= r.least)
    return m["n_words"] >= q.BASE_WORDS and not bad
