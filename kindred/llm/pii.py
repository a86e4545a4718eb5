"""Personal data: fixed patterns and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field is trained on the driver from a small labelled table
(``labelled_rows``, or the caller's) and decoded by Viterbi in numpy batches. A word without a digit
or an @ can only be outside, in training as in decoding, so the chain falls apart at such words and
only the runs of other words are decoded, exactly: kinds whose words need hold neither (names, postal
addresses in words, spelled-out addresses) are out of the field's reach, and a labelled table with such a
span is an error. What it finds beside the base spans is added: numbers of national phone formats, social
security numbers and bank account numbers.

Defined cases: a null or empty text has no spans and the digest of an empty string; offsets are code
points; repeated rows are searched alike; a null id is returned as null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import column_text, slices

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")

MARK = re.compile(r"[0-9@]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")
SPACES = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _is_ip(x: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in x.split("."))


def _is_card(x: str) -> bool:
    digits = x.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _is_phone(x: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in x) <= 15


def marked_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that hold a digit or an @, as (start, end) of each word."""
    runs: list[list[tuple[int, int]]] = []
    end = -1
    m = MARK.search(text)
    while m:
        at = m.start()
        start = at
        while start > 0 and text[start - 1] not in SPACES:
            start -= 1
        gap = SPACE.search(text, at)
        stop = gap.start() if gap else len(text)
        if runs and not NOT_SPACE.search(text, end, start):
            runs[-1].append((start, stop))
        else:
            runs.append([(start, stop)])
        end = stop
        m = MARK.search(text, stop)
    return runs


def base_spans(text: str, runs: list[list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed. All but phone stay within a run of marked words."""
    found = []
    for run in runs:
        lo, hi = run[0][0], run[-1][1]
        if text.find("@", lo, hi) >= 0:
            for s, e in run:
                if text.find("@", s, e) >= 0:
                    found += [(m.start(), m.end(), 0) for m in EMAIL.finditer(text, s, e)]
        if text.count(".", lo, hi) >= 3:
            found += [(m.start(), m.end(), 1) for m in IP.finditer(text, lo, hi) if _is_ip(m[0])]
        if hi - lo >= 14:
            found += [(m.start(), m.end(), 2) for m in CARD.finditer(text, lo, hi) if _is_card(m[0])]
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if _is_phone(m[0])]
    return [(s, e, BASE[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


# -- the field ------------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Sentences of the labelled table; {kind} is a labelled value, {other} a number that is none.
SENTENCES = (
    "call {phone} before noon", "phone: {phone}, room {other}", "tel {phone} or write to {email}", "you can reach her at {phone}",
    "mail {email} about item {other}", "from {email} on {other}", "the server {ip} answered {other} times", "blocked {ip} since {other}",
    "card {card} was charged {other}", "paid with {card} in {other}", "ssn {ssn} on file", "social security number {ssn} and born {other}",
    "account {iban} at the bank", "transfer to iban {iban} by {other}", "in {other} there were {other} of them", "version {other} of {other}",
    "it rose {other} to {other} after {other}", "see page {other} and section {other}", "of the {ip} and on", "le numéro {phone} est",
    "die nummer {phone} ist", "que el {phone} con", "and {card} was the", "with {email} for", "de la {card} que", "at {other} the",
    "token = {other} and", "the {other} ## {other} ##", "order {other} shipped {other}", "{other} {other} {other} {other}",
)
SUFFIXES = ("", "", "", "", ".", ",", "###", "&&&", "!!")


def _value(kind: str, rng: random.Random) -> str:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdehilmnorstu") for _ in range(rng.randint(2, 8)))
    if kind == "phone":
        a, b, c = f"{rng.randint(2, 9)}{d(2)}", d(3), d(4)
        return rng.choice((f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{rng.randint(20, 99)} {d(3)} {d(3)} {d(4)}"))
    if kind == "email":
        return f"{word()}.{d(2)}@{word()}{rng.randint(1, 9)}.{rng.choice(('com', 'org', 'example.com'))}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        x = "4" + d(15)
        return rng.choice((x, " ".join(x[i : i + 4] for i in range(0, 16, 4)), "-".join(x[i : i + 4] for i in range(0, 16, 4))))
    if kind == "ssn":
        return f"{d(3)}-{d(2)}-{d(4)}"
    if kind == "iban":
        return rng.choice(("DE", "FR", "ES")) + d(2) + " " + " ".join(d(4) for _ in range(4)) + " " + d(2)
    year = str(rng.randint(1900, 2030))
    return rng.choice((
        year, d(1), d(2), d(3), d(5), d(7), f"{d(1)},{d(3)}", f"{d(1)}.{d(2)}", f"{d(2)}%", f"${d(2)}", f"{year}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{year}", f"{d(2)}:{d(2)}",
        f"{d(1)}.{d(2)}.{d(1)}", f"No.{d(3)}", f"{word()}{d(2)}", f"{d(2)}-{d(2)}", f"({year})", f"{year}-{year}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"{d(3)}x{d(3)}", f"{d(3)} {d(3)}", f"@{word()}",
    ))


def labelled_rows(count: int = 360, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The built-in labelled table: sentences with values made by rule."""
    rng, rows = random.Random(seed), []
    for i in range(count):
        text, spans = "", []
        for part in re.split(r"(\{\w+\})", SENTENCES[i % len(SENTENCES)]):
            if part.startswith("{"):
                value = _value(part[1:-1], rng)
                if part != "{other}":
                    spans.append((len(text), len(text) + len(value), part[1:-1]))
                text += value + rng.choice(SUFFIXES)
            else:
                text += part
        rows.append((text, spans))
    return rows


SHAPE = str.maketrans({**{chr(c): "d" for c in range(48, 58)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "x" for c in range(97, 123)}})
LONG = re.compile(r"(.)\1{4,}")
RUN = re.compile(r"(.)\1+")
TAIL = re.compile(r"[#%&*$!.,;:?|]+$")


def _shape(word: str) -> str:
    return LONG.sub(r"\1\1\1\1+", word.translate(SHAPE))


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after a run."""
    hi = start
    while hi > 0 and text[hi - 1] in SPACES:
        hi -= 1
    lo = hi
    while lo > 0 and text[lo - 1] not in SPACES:
        lo -= 1
    after = WORDS.search(text, end)
    return text[lo:hi] or "^", after[0] if after else "$"


def run_features(text: str, run: list[tuple[int, int]]) -> list[list[str]]:
    before, after = _around(text, run[0][0], run[-1][1])
    words = [TAIL.sub("", text[s:e]) for s, e in run]
    shapes = [_shape(w) for w in words]
    out = []
    for i, (word, shape) in enumerate(zip(words, shapes, strict=True)):
        prev = shapes[i - 1] if i else before.lower()
        following = shapes[i + 1] if i + 1 < len(run) else "$"
        digits = sum(c == "d" for c in word.translate(SHAPE))
        own = [f"s={shape}", f"c={RUN.sub(chr(92) + '1', shape)}", f"n={min(digits, 17)}", f"p={prev}", f"q={following}", f"sp={shape}|{prev if i else '^'}", f"sq={shape}|{following}", "b"]
        out.append(own)
    return out


class Field:
    """Emission weights by feature, transition weights by pair of labels; neighbours of a run are O."""

    def __init__(self, features: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.features, self.emit, self.step = features, emit, step

    def scores(self, run: list[list[str]]) -> np.ndarray:
        known = self.features
        return np.stack([self.emit[[known[f] for f in own if f in known]].sum(axis=0) for own in run])


def forward_backward(e: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each label, and the expected count of each transition, of one run."""
    n, k = e.shape
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    alpha[0] = step[0] + e[0]
    for i in range(1, n):
        alpha[i] = lse(alpha[i - 1][:, None] + step, 0) + e[i]
    beta[-1] = step[:, 0]
    for i in range(n - 2, -1, -1):
        beta[i] = lse(step + (e[i + 1] + beta[i + 1])[None, :], 1)
    z = lse(alpha[-1] + step[:, 0], 0)
    pairs = np.zeros((k, k))
    pairs[0] += np.exp(alpha[0] + beta[0] - z)
    pairs[:, 0] += np.exp(alpha[-1] + beta[-1] - z)
    for i in range(1, n):
        pairs += np.exp(alpha[i - 1][:, None] + step + (e[i] + beta[i])[None, :] - z)
    return np.exp(alpha + beta - z), pairs


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 60, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with L2, by Adam over the whole table; the same table gives the same field."""
    runs, features = [], {}
    for text, spans in rows:
        words = [w for run in marked_runs(text) for w in run]
        for a, b, kind in spans:
            if kind not in KINDS or not any(a < e and s < b for s, e in words):
                raise ValueError(f"a labelled span is of a kind in {', '.join(KINDS)} and holds a digit or an @: {kind} at {a}")
        for run in marked_runs(text):
            labels = []
            for s, e in run:
                hit = next(((a, k) for a, b, k in spans if a < e and s < b), None)
                labels.append(0 if hit is None else LABELS.index(("B-" if hit[0] >= s else "I-") + hit[1]))
            own = [[features.setdefault(f, len(features)) for f in x] for x in run_features(text, run)]
            runs.append((own, labels))
    k = len(LABELS)
    emit, step = np.zeros((len(features), k)), np.zeros((k, k))
    moments = [np.zeros_like(x) for x in (emit, step, emit, step)]
    for t in range(1, rounds + 1):
        ge, gs = decay * emit * len(runs), decay * step * len(runs)
        for own, labels in runs:
            e = np.stack([emit[x].sum(axis=0) for x in own])
            post, pairs = forward_backward(e, step)
            post[np.arange(len(labels)), labels] -= 1
            for x, g in zip(own, post, strict=True):
                ge[x] += g
            for a, b in zip([0, *labels], [*labels, 0], strict=True):
                pairs[a, b] -= 1
            gs += pairs
        for i, (w, g) in enumerate(((emit, ge), (step, gs))):
            g = g / len(runs)
            moments[i] = 0.9 * moments[i] + 0.1 * g
            moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * g * g
            w -= rate * (moments[i] / (1 - 0.9**t)) / (np.sqrt(moments[i + 2] / (1 - 0.99**t)) + 1e-8)
    return Field(features, emit, step)


def viterbi(batch: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """The best labels of each run; runs of one length are decoded together."""
    out: list = [None] * len(batch)
    by_length: dict[int, list[int]] = {}
    for i, e in enumerate(batch):
        by_length.setdefault(len(e), []).append(i)
    for n, which in by_length.items():
        e = np.stack([batch[i] for i in which])
        score, back = step[0] + e[:, 0], []
        for i in range(1, n):
            options = score[:, :, None] + step[None]
            back.append(options.argmax(axis=1))
            score = options.max(axis=1) + e[:, i]
        label = (score + step[:, 0]).argmax(axis=1)
        path = [label]
        for b in reversed(back):
            label = b[np.arange(len(which)), label]
            path.append(label)
        for i, labels in zip(which, np.stack(path[::-1], axis=1), strict=True):
            out[i] = labels
    return out


LEFT, RIGHT = re.compile(r"[^\w(+]+"), re.compile(r"[^\w)]+$")


def added_spans(text: str, run: list[tuple[int, int]], labels, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the decoded labels, without punctuation at their ends, apart from base spans."""
    found, i = [], 0
    while i < len(run):
        name = LABELS[labels[i]]
        if name == "O":
            i += 1
            continue
        kind, j = name[2:], i + 1
        while j < len(run) and LABELS[labels[j]] == f"I-{kind}":
            j += 1
        start, end = run[i][0], run[j - 1][1]
        lead = LEFT.match(text, start, end)
        start = lead.end() if lead else start
        tail = RIGHT.search(text, start, end)
        end = tail.start() if tail else end
        value = text[start:end]
        digits = sum("0" <= c <= "9" for c in value)
        # a kind with a check of its own must pass it
        valid = {"email": "@" in value and "." in value, "ip": bool(IP.fullmatch(value)) and _is_ip(value), "card": _is_card(value), "phone": 9 <= digits <= 15, "ssn": digits == 9, "iban": digits >= 14}[kind]
        if valid and not any(s < end and start < e for s, e, _ in base):
            found.append((start, end, kind))
        i = j
    return found


def find_all(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    runs = [marked_runs(t) for t in texts]
    base = [base_spans(t, r) for t, r in zip(texts, runs, strict=True)]
    jobs = [(i, run) for i, own in enumerate(runs) for run in own]
    more: list[list] = [[] for _ in texts]
    for at in range(0, len(jobs), 4096):
        part = jobs[at : at + 4096]
        decoded = viterbi([field.scores(run_features(texts[i], run)) for i, run in part], field.step)
        for (i, run), labels in zip(part, decoded, strict=True):
            if labels.any():
                more[i] += added_spans(texts[i], run, labels, base[i])
    order = {k: i for i, k in enumerate(KINDS)}
    return [(b, sorted(b + m, key=lambda x: (x[0], order[x[2]]))) for b, m in zip(base, more, strict=True)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans the first gives the kind."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train(labelled_rows()))

    def run(batches):
        for batch in slices(batches):
            results = find_all(column_text(batch, "text"), shared.value)
            counts = [[sum(k == kind for _, _, k in b) for b, _ in results] for kind in BASE]
            digests = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in results]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([joined(a) for _, a in results], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of docs with personal data replaced in the text; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train(labelled_rows()))
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            at = names.index(text_col)
            raw = batch.column(at).to_pylist()
            results = find_all([x or "" for x in raw], shared.value)
            texts = [None if x is None else redacted(x, spans) for x, (_, spans) in zip(raw, results, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_col in names:
                i = names.index(length_col)
                old = columns[i].to_pylist()
                columns[i] = pa.array([o if t is None else len(t) for o, t in zip(old, texts, strict=True)], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
