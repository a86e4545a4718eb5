"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials.

For each family of credentials a prefix tree of its labelled examples is built, states counting how
many examples arrive, end and go on by each symbol. Symbols are characters where a state has few of them for its
examples (FEW), as in a format's literal parts; elsewhere letters and digits are one symbol, for which the state keeps
how they fall into ranges, and each sign is its own. States are merged, the tree folded along, where all their
frequencies differ by less than the Hoeffding bound, with the state of the nearest depth first, so lengths stay in
the states; what is left is a deterministic probabilistic automaton of the format. Every candidate is scored by all
automata: each run of 20 or more token characters, and what each base span has as its secret. The score is the
log-likelihood under the likeliest format over that under the automaton of ordinary tokens, per character. In a run
the automata also start behind each sign and may end before each sign or at its end (key=..., paths, query
strings); of parts that overlap the one of the largest ratio in all is taken. What an automaton accepts, from its
first state to an end, at a score of ``LEAST_SCORE`` or more, and what meets no base span, is a span of its own. The
automata are inferred on the driver and broadcast.

Defined cases: a null or empty text has no spans and the digest of an empty string; offsets are code
points; repeated rows are searched alike; a null id is returned as null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import column_text, slices

# The base patterns.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE = ("assign", "access", "hex")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
SIGN = re.compile(r"[+/_.=-]")
LEAST_LENGTH = 20
# Ranges of letters and digits.
CLASSES = {"a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ", "0": "0123456789"}
RANGE = {c: k for k, members in CLASSES.items() for c in members}
ANY = "any"  # the symbol of a letter or digit where characters are not told apart
FEW, LEAST_ARRIVALS, PRIOR = 10, 20, 5.0
FLOOR = math.log(1e-4)
LEAST_SCORE = 0.35


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "=" in text or ":" in text:
        lower = text.lower()
        if any(k in lower for k in KEYWORDS):
            found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # str.split() may split more, never inside such a run
    if max(map(len, text.split()), default=0) >= 24:
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, BASE[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


class Automaton:
    """A deterministic probabilistic automaton: by state, how many arrive, end, and go on by each symbol."""

    def __init__(self, examples: list[str], alpha: float = 0.05):
        self.arrive, self.ends, self.next, self.depth = [], [], [], []
        self.literal: list[bool] = []
        self.ranges: list[dict[str, int]] = []
        self._grow(examples)
        every = [sum(r.get(k, 0) for r in self.ranges) for k in CLASSES]
        self.prior = {k: (n + 0.5) / (sum(every) + 0.5 * len(CLASSES)) for k, n in zip(CLASSES, every, strict=True)}
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.logs = {q: (self._steps(q), math.log(self.ends[q] / self.arrive[q]) if self.ends[q] else None) for q in self.red}

    def _grow(self, examples: list[str]) -> None:
        """The prefix tree; a state's characters are symbols where it has at most one a FEW examples."""
        stack: list[tuple[int, list[str], list | None]] = [(0, examples, None)]
        while stack:
            depth, own, edge = stack.pop()
            q, on = len(self.arrive), [x for x in own if len(x) > depth]
            literal = len(on) >= LEAST_ARRIVALS and FEW * len({x[depth] for x in on}) <= len(on)
            by: dict[str, list[str]] = {}
            ranges: dict[str, int] = {}
            for x in on:
                kind = RANGE.get(x[depth])
                by.setdefault(ANY if kind and not literal else x[depth], []).append(x)
                if kind and not literal:
                    ranges[kind] = ranges.get(kind, 0) + 1
            self.arrive.append(len(own))
            self.ends.append(len(own) - len(on))
            self.next.append({c: [-1, len(xs)] for c, xs in by.items()})
            self.depth.append(depth)
            self.literal.append(literal)
            self.ranges.append(ranges)
            if edge:
                edge[0] = q
            stack += [(depth + 1, by[c], self.next[q][c]) for c in sorted(by, reverse=True)]

    def _steps(self, q: int) -> dict[str, tuple[float, int]]:
        """By character, its log-probability and the state that it leads to."""
        out = {c: (math.log(n / self.arrive[q]), to) for c, (to, n) in self.next[q].items() if c != ANY}
        if ANY in self.next[q]:
            to, n = self.next[q][ANY]
            for k, members in CLASSES.items():
                log = math.log(n / self.arrive[q]) + math.log((self.ranges[q].get(k, 0) + PRIOR * self.prior[k]) / (n + PRIOR) / len(members))
                out |= {c: (log, to) for c in members}
        return out

    def _differs(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            n1, n2 = self.arrive[p], self.arrive[q]
            if not n1 or not n2:
                continue
            if self.literal[p] != self.literal[q]:
                return False
            if self._differs(self.ends[p], n1, self.ends[q], n2):
                return False
            for c in self.next[p].keys() | self.next[q].keys():
                to1, m1 = self.next[p].get(c, (None, 0))
                to2, m2 = self.next[q].get(c, (None, 0))
                if self._differs(m1, n1, m2, n2):
                    return False
                if to1 is not None and to2 is not None:
                    stack.append((to1, to2))
        return True

    def _fold(self, p: int, q: int) -> None:
        """The tree below q is added to p's."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            self.arrive[p] += self.arrive[q]
            self.ends[p] += self.ends[q]
            for k, n in self.ranges[q].items():
                self.ranges[p][k] = self.ranges[p].get(k, 0) + n
            for c, (to, n) in self.next[q].items():
                if c in self.next[p]:
                    self.next[p][c][1] += n
                    stack.append((self.next[p][c][0], to))
                else:
                    self.next[p][c] = [to, n]

    def _merge_all(self) -> None:
        self.red = [0]
        while True:
            reds = set(self.red)
            blue = [(q, c, to) for q in self.red for c, (to, _) in sorted(self.next[q].items()) if to not in reds]
            if not blue:
                return
            q, c, b = max(blue, key=lambda x: (self.arrive[x[2]], -x[2]))
            for r in sorted(self.red, key=lambda r: (abs(self.depth[r] - self.depth[b]), r)):
                if self._compatible(r, b):
                    self.next[q][c][0] = r
                    self._fold(r, b)
                    break
            else:
                self.red.append(b)

    def loglik(self, token: str) -> float:
        """Of the token's characters and its end; what the automaton does not know costs FLOOR."""
        q, total = 0, 0.0
        for c in token:
            if q is None:
                total += FLOOR / 2
                continue
            log, q = self.logs[q][0].get(c, (FLOOR, None))
            total += log
        end = self.logs[q][1] if q is not None else None
        return total + (FLOOR if end is None else end)

    def ended(self, token: str, stops: set[int], start: int) -> list[tuple[int, float]]:
        """(end, loglik of token[start:end]) for each of the stops at which the automaton accepts."""
        q, total, found = 0, 0.0, []
        for i in range(start, len(token) + 1):
            steps, end = self.logs[q]
            if i in stops and i - start >= LEAST_LENGTH and end is not None:
                found.append((i, total + end))
            if i == len(token) or token[i] not in steps:
                break
            log, q = steps[token[i]]
            total += log
        return found


# The formats of the labelled credentials; x any letter or digit, h hexadecimal, d digit, u upper or digit, b base64, w base64 of URLs.
FORMATS = {
    "github": ("ghp_", "x36"),
    "access": ("AKIA", "u16"),
    "stripe": ("sk_live_", "x24-99"),
    "slack": ("xoxb-", "d10-13", "-", "d10-13", "-", "x24-32"),
    "google": ("AIza", "w35"),
    "aws": ("b40",),
    "jwt": ("eyJ", "w17-60", ".eyJ", "w20-200", ".", "w43-342"),
    "digest": ("h40",),
}
LETTERS = {"x": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "h": "0123456789abcdef", "d": "0123456789", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
LETTERS |= {"b": LETTERS["x"] + "+/", "w": LETTERS["x"] + "-_"}
SYLLABLES = "an ar be con de ed en er es for ge in ing ion le ment ou per re se sta th ti tion un ver".split()


def labelled_credentials(count: int = 400, seed: int = 5) -> list[tuple[str, str]]:
    """(token, family), ordinary tokens under "plain"; made by rule."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    for family, parts in FORMATS.items():
        for _ in range(count):
            drawn = [(p, re.fullmatch(r"([xhdubw])(\d+)(?:-(\d+))?", p)) for p in parts]
            rows.append(("".join("".join(rng.choice(LETTERS[m[1]]) for _ in range(rng.randint(int(m[2]), int(m[3] or m[2])))) if m else p for p, m in drawn), family))
    for _ in range(6 * count):
        kind = rng.randrange(7)
        text = "_".join(word() for _ in range(rng.randint(2, 6))) if kind == 0 else "/".join(word() for _ in range(rng.randint(2, 7))) if kind == 1 else "-".join(word() for _ in range(rng.randint(2, 6)))
        text = f"{word()}.{word()}.{word()}.com/{word()}" if kind == 2 else word().capitalize() + word().capitalize() + word().capitalize() if kind == 3 else text
        text = "".join(rng.choice("0123456789") for _ in range(rng.randint(6, 24))) if kind == 4 else f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}" if kind == 5 else text
        rows.append((text + str(rng.randint(0, 9999)) * (rng.random() < 0.5), "plain"))
    return rows


class Scanner:
    def __init__(self, rows: list[tuple[str, str]] | None = None):
        by: dict[str, list[str]] = {}
        for token, family in rows or labelled_credentials():
            by.setdefault(family, []).append(token)
        self.plain = Automaton(by.pop("plain"))
        self.families = {k: Automaton(v) for k, v in by.items()}

    def score(self, token: str) -> tuple[float, str]:
        """Log-likelihood ratio per character to ordinary tokens, and the family."""
        ll, family = max((a.loglik(token), k) for k, a in self.families.items())
        return (ll - self.plain.loglik(token)) / len(token), family

    def parts(self, token: str) -> tuple[list[tuple[int, int, str, float]], bool]:
        """(start, end, family, score) of the parts between signs (the whole among them) that a format accepts at LEAST_SCORE,
        the best of those that overlap; of the whole, and False, where there is none."""
        signs = [m.start() for m in SIGN.finditer(token)]
        score, family = self.score(token)
        whole, found = (0, len(token), family, score), []
        stops = {*signs, len(token)}
        for start in (0, *(i + 1 for i in signs)):
            if len(token) - start < LEAST_LENGTH:
                break
            for family, automaton in self.families.items():
                for end, ll in automaton.ended(token, stops, start):
                    part = token[start:end]
                    score = (ll - self.plain.loglik(part)) / len(part)
                    if score >= LEAST_SCORE:
                        found.append((-score * len(part), (start, end, family, score)))
        taken: list[tuple[int, int, str, float]] = []
        for _, part in sorted(found):
            if not any(s < part[1] and part[0] < e for s, e, *_ in taken):
                taken.append(part)
        return (taken, True) if taken else ([whole], False)

    def find(self, text: str) -> tuple[list, list, list]:
        """(base spans, all spans, all candidates as (start, end, family, score))."""
        base = base_spans(text)
        scored, accepted = [], set()
        for start, end, kind in base:
            inner = ASSIGN.match(text, start) if kind == "assign" else None
            start = inner.start(1) if inner else start
            score, family = self.score(text[start:end])
            scored.append((start, end, family, score))
        own = {x[:2] for x in scored}
        if max(map(len, text.split()), default=0) >= LEAST_LENGTH:
            for m in CANDIDATE.finditer(text):
                taken, known = self.parts(m[0])
                for s, e, family, score in taken:
                    x = (m.start() + s, m.start() + e, family, score)
                    if x[:2] not in own:
                        scored.append(x)
                        accepted |= {x[:2]} if known else set()
        more = [(s, e, f"format-{family}") for s, e, family, _ in scored if (s, e) in accepted and not any(a < e and s < b for a, b, _ in base)]
        rank = {k: i for i, k in enumerate(BASE)}
        return base, sorted(base + more, key=lambda x: (x[0], rank.get(x[2], 9), x[2])), sorted(scored)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_scored, top_score, top_family, scored) of each row.

    ``scored`` has every candidate as family:start:end:score, base ones too; the top is the likeliest of them."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_scored", "top_score", "top_family", "scored")

    def run(batches):
        for batch in slices(batches):
            base, spans, scored = zip(*map(shared.value.find, column_text(batch, "text")), strict=True)
            tops = [max(((round(score, 6) + 0.0, f) for *_, f, score in x), default=(None, None)) for x in scored]
            columns = [
                batch.column(0),
                *(pa.array([sum(k == kind for _, _, k in b) for b in base], pa.int64()) for kind in BASE),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([joined(x) for x in spans], pa.string()),
                pa.array(list(map(len, scored)), pa.int64()),
                pa.array([t for t, _ in tops], pa.float64()),
                pa.array([f for _, f in tops], pa.string()),
                pa.array([",".join(f"{f}:{s}:{e}:{score:.3f}" for s, e, f, score in x) for x in scored], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, list(names))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_scored long, top_score double, top_family string, scored string")
