r"""Personal data by a skip-chain conditional random field over what patterns find.

Patterns give the base spans (email, ip, card, phone), which always stay. The field then labels the other mentions that
might be personal data: numbers in groups without the plus sign, cards in other groupings, addresses with `[at]` or
`[dot]`, defanged IPs, addresses that stop at the host. Each mention is a node, its whole span at once. Nodes that
follow each other within `NEAR` characters share a chain potential; distant nodes with the same or a similar key (the
last seven digits, the local part of an address, the octets of an IP) share a skip potential. Loopy belief propagation
then carries a label from a clear mention to one that no pattern matches, and so keeps a document consistent: bare digits
are a phone number where the same digits stand with a plus sign elsewhere, and remain a number where they do not.
Nodes that are base spans are clamped to their kind. A node that is of a kind with probability `SURE` or more is added.

Skip edges join a mention to the one before it with the same key, so their number is that of the mentions, not of
pairs. A text without a digit or @ or `at` in brackets costs one scan. No shuffle; texts are read in Arrow batches.

Fit. On about `SAMPLE` documents, taken by a hash threshold on their ids and texts, that base patterns find something in.
Labels beyond the patterns do not exist, so each document is given mentions whose labels are known: other forms of one
of its own base spans (labelled with its kind), forms that speak for themselves, and fresh numbers in the same forms
without a clear mention (labelled as none). What is planted depends on the text alone, not on the order of rows. Only the
features, labels and edges of the nodes reach the driver, of documents with at most `MOST_NODES` nodes.

Defined cases: null text is empty, with no spans; ties and repeated ids are rows of their own; an empty table gives an
empty result; other columns are ignored. Counts and base_sha256 are of base spans, spans lists all.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import text_of

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2000
MOST_NODES = 300
SURE = 0.9
NEAR = 40
LONG = 60
ROUNDS = 12
#: The look-behind changes no match (a digit run that fails from its start fails from within), but keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AFTER = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[^0-9]")
#: Other forms of a mention, by name; each is a whole span. Tried in this order at each place.
_NUMBERS = re.compile(
    r"(?<![0-9A-Za-z.])(?:"
    r"(?P<defanged>[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\x20\.\x20)[0-9]{1,3}){3})"
    r"|(?P<dotted>[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{1,7})"
    r"|(?P<spaced>[0-9]{4}\x20{1,2}[0-9]{4}\x20{1,2}[0-9]{4}\x20{1,2}[0-9]{1,7})"
    r"|(?P<paren>(?:\+?[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4})"
    r"|(?P<grouped>(?:\+?[0-9]{1,3}[\x20./-])?[0-9]{3}[\x20./-][0-9]{3}[\x20./-][0-9]{4})"
    r"|(?P<bare>\+?[0-9]{7,19})"
    r")(?![0-9A-Za-z]|\.[0-9])"
)
_AT = r"\x20?[\[({]\x20?at\x20?[\])}]\x20?"
_DOT = r"\x20?[\[({]\x20?dot\x20?[\])}]\x20?"
_HIDDEN = re.compile(rf"(?i)(?:{_AT}|\x20at\x20(?=[A-Z0-9-]+(?:{_DOT}|\x20dot\x20))|@(?=[A-Z0-9-]+{_DOT}))[A-Z0-9-]+(?:(?:{_DOT}|\x20dot\x20|\.)[A-Z0-9-]+)+")
_HOST = re.compile(r"@[A-Za-z0-9-]+")
_MAYBE = re.compile(r"[0-9@]|[\[({]\x20?at\x20?[\])}]", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _local(text: str, at: int, done: int) -> int:
    """Where the local part that ends at `at` starts, not before `done`."""
    while at > done and (c := text[at - 1]).isascii() and (c.isalnum() or c in "._%+-"):
        at -= 1
    return at


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ in linear time: the pattern itself
    would retry every start of a long run."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = _local(text, at, done)
        if start < at and (m := _AFTER.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    ips, cards, phones = [], [], []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            ips.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            cards.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                phones.append(("phone", m.start(), m.end()))
    return out + ips + cards + phones


def other_spans(text: str) -> list[tuple[str, int, int]]:
    """(form, start, end) of the mentions in other forms, base spans among them; of those that overlap the first stays."""
    found: list[tuple[str, int, int]] = []
    done = 0
    for m in _HIDDEN.finditer(text):
        if (start := _local(text, m.start(), done)) < m.start():
            found.append(("hidden", start, m.end()))
        done = m.end()
    done, at = 0, text.find("@")
    while at >= 0:
        if (m := _HOST.match(text, at)) and (start := _local(text, at, done)) < at:
            found.append(("host", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    found += [(m.lastgroup, m.start(), m.end()) for m in _NUMBERS.finditer(text)]
    return found


def key_of(kind: str, span: str) -> str:
    """What two mentions of one thing have in common."""
    if kind in ("email", "hidden", "host"):
        return "a" + re.split(r"@|(?i:\x20?[\[({]\x20?at\x20?[\])}]|\x20at\x20)", span, maxsplit=1)[0].lower()
    if kind in ("ip", "defanged"):
        return "i" + ".".join(x.lstrip("0") or "0" for x in re.findall(r"[0-9]+", span))
    return "n" + _DIGITS.sub("", span)[-7:]


class Nodes:
    """The mentions of a text: spans, features, edges, and the kinds of those that are base spans (0: not known)."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]) -> None:
        mentions = [(a, b, kind, True) for kind, a, b in spans]
        covered = sorted((a, b) for _, a, b in spans)
        ends = 0
        merged: list[tuple[int, int]] = []
        for a, b in covered:
            if merged and a < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], b))
            else:
                merged.append((a, b))
        begin = [a for a, _ in merged]
        for form, a, b in sorted(other_spans(text), key=lambda s: (s[1], -s[2])):
            k = bisect.bisect_left(begin, b) - 1  # the last base span that starts before b
            if a >= ends and not (k >= 0 and merged[k][1] > a):
                mentions.append((a, b, form, False))
                ends = b
        mentions.sort()
        self.spans = [(a, b) for a, b, *_ in mentions]
        self.kind = np.array([KINDS.index(kind) + 1 if base else 0 for *_, kind, base in mentions], np.int64)
        self.features, self.chain, self.skip = [], [], []
        last: dict[str, int] = {}
        for n, (a, b, form, _) in enumerate(mentions):
            digits = _DIGITS.sub("", text[a:b])
            shape = "-".join(str(len(x)) for x in re.findall(r"[0-9]+", text[a:b])) if form in ("grouped", "paren", "bare", "dotted", "spaced") else ""
            self.features.append([f"form={form}", f"shape={form}:{shape}", f"digits={form}:{len(digits)}", f"luhn={form}:{len(digits) >= 13 and luhn(digits)}", f"plus={form}:{text[a] == '+'}", *_around(text, a, b)])
            if n and a - mentions[n - 1][1] <= NEAR:
                self.chain.append((n - 1, n))
            key = key_of(form, text[a:b])
            if len(key) >= 4:
                if key in last:
                    self.skip.append((last[key], n))
                last[key] = n


def _around(text: str, a: int, b: int) -> list[str]:
    """The whole words beside a span, in lower case; a word that is longer than `LONG` is only known to be long."""
    left, right = text[max(0, a - LONG) : a].split(), text[b : b + LONG].split()
    word = lambda s: " ".join(_LETTERS.findall(s.lower()))
    before = "^" if not left else word(left[-1]) if len(left) > 1 or a <= LONG else "long"
    after = "$" if not right else word(right[0]) if len(right) > 1 or b + LONG >= len(text) else "long"
    return [f"before={before}", f"after={after}"]


class Field:
    """Weights of the random field: unary (feature, label), chain and skip (label, label)."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.names, self.unary, self.chain, self.skip = names, unary, chain, skip

    def local(self, nodes: Nodes) -> np.ndarray:
        out = np.zeros((len(nodes.features), len(KINDS) + 1))
        for k, fs in enumerate(nodes.features):
            rows = [self.names[f] for f in fs if f in self.names]
            out[k] = self.unary[[0, *rows]].sum(axis=0)
        return out

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Beliefs after loopy sum-product message passing, damped, in log space."""
        unary = self.local(nodes)
        fixed = nodes.kind > 0
        unary[fixed] = -50.0
        unary[fixed, nodes.kind[fixed]] = 0.0
        edges = [(a, b, self.chain) for a, b in nodes.chain] + [(a, b, self.skip) for a, b in nodes.skip]
        if not edges:
            return _normal(unary)
        a = np.array([e[0] for e in edges])
        b = np.array([e[1] for e in edges])
        w = np.array([e[2] for e in edges])
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.concatenate([w, w.transpose(0, 2, 1)])  # (source label, target label)
        m = np.zeros((len(source), unary.shape[1]))
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, m)
            out = np.logaddexp.reduce(pair + (belief[source] - m[back])[:, :, None], axis=1)
            m = 0.5 * m + 0.5 * (out - out.max(axis=1, keepdims=True))
        belief = unary.copy()
        np.add.at(belief, target, m)
        return _normal(belief)


def _normal(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def other_form(rng: random.Random, kind: str, span: str) -> str:
    """A form of a clear mention that no pattern matches."""
    if kind == "email":
        local, host = span.split("@", 1)
        return rng.choice([f"{local} [at] {host}", f"{local}(at){host.replace('.', '(dot)')}", f"{local} at {host.replace('.', ' dot ')}", f"{local}@{host.split('.')[0]}"])
    if kind == "ip":
        return rng.choice(["[.]", "(.)", " . ", "[dot]"]).join(span.split("."))
    d = _DIGITS.sub("", span)
    if kind == "card":
        return rng.choice([".", "/", "  "]).join([d[:4], d[4:8], d[8:12], d[12:]])
    tail = d[-10:]
    return rng.choice([d, tail, f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"({tail[:3]}) {tail[3:6]}-{tail[6:]}"])


def fresh_span(rng: random.Random, kind: str) -> str:
    """A clear mention of a kind, with invented digits and letters."""
    if kind == "email":
        return f"{''.join(rng.choice('abcdefghijklmnop') for _ in range(6))}.{_digits(rng, 2)}@{''.join(rng.choice('qrstuvwxyz') for _ in range(5))}.example"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        d = _digits(rng, 15)
        return next(d + c for c in "0123456789" if luhn(d + c))
    return f"+{rng.randrange(1, 99)} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}"


def plant(text: str, rng: random.Random, most: int = 3) -> tuple[str, list[tuple[str, int, int]]]:
    """(text with mentions put in at word ends, their labels as (kind, '' for none; start, end)).

    One of the text's own base spans comes again in another form, an address or IP stands in a hidden form alone, and a
    fresh number stands in a form that only a clear mention elsewhere would make personal."""
    own = [(k, text[a:b]) for k, a, b in base_spans(text)]
    put: list[tuple[str, str]] = []
    if own:
        kind, span = own[rng.randrange(len(own))]
        put.append((kind, other_form(rng, kind, span)))
    if rng.random() < 0.5:
        kind = rng.choice(("email", "ip"))
        form = other_form(rng, kind, fresh_span(rng, kind))
        put.append((kind if "@" not in form else "", form))
    kind = rng.choice(("phone", "card"))
    form = other_form(rng, kind, fresh_span(rng, kind))
    put.append(("phone" if form.startswith("(") else "", form))
    places = [0, *(m.end() for m in re.finditer(r"[^\W\d_](?=\s)", text))]
    chosen = sorted(rng.choice(places) for _ in put[:most])
    rng.shuffle(put)
    out, labels, at, size = [], [], 0, 0
    for place, (kind, form) in zip(chosen, put, strict=False):
        out.append(text[at:place] + (" " if place else ""))
        size += len(out[-1])
        labels.append((kind, size, size + len(form)))
        out.append(form + ("" if place else " "))
        size += len(out[-1])
        at = place
    return "".join([*out, text[at:]]), labels


def example(text: str, rng: random.Random) -> dict | None:
    """Features, labels (-1: not known) and edges of a text with planted mentions."""
    planted, labels = plant(text, rng)
    nodes = Nodes(planted, base_spans(planted))
    if not 0 < len(nodes.kind) <= MOST_NODES:
        return None
    gold = nodes.kind.copy()
    known = nodes.kind > 0
    where = {(a, b): kind for kind, a, b in labels}
    learn = np.zeros(len(gold), bool)
    for k, span in enumerate(nodes.spans):
        if not known[k]:
            gold[k] = KINDS.index(where[span]) + 1 if where.get(span) else 0
            learn[k] = True
    return {"features": nodes.features, "gold": gold.tolist(), "learn": learn.tolist(), "chain": nodes.chain, "skip": nodes.skip}


def fit(examples: list[dict], rounds: int = 800) -> Field:
    """Pseudo-likelihood by AdaGrad on the nodes that no base pattern gives, in the examples' order; small in any order."""
    width = len(KINDS) + 1
    labels, rows, near = [], [], []
    counts: dict[str, int] = {}
    for e in examples:
        both = np.zeros((len(e["gold"]), 2, width))
        for which, edges in enumerate((e["chain"], e["skip"])):
            for a, b in edges:
                both[a, which, e["gold"][b]] += 1
                both[b, which, e["gold"][a]] += 1
        for k in np.flatnonzero(e["learn"]).tolist():
            labels.append(e["gold"][k])
            rows.append(e["features"][k])
            near.append(both[k])
            for f in rows[-1]:
                counts[f] = counts.get(f, 0) + 1
    names = {f: k + 1 for k, f in enumerate(sorted(f for f, c in counts.items() if c >= 5))}
    unary = np.zeros((len(names) + 1, width))
    chain, skip = np.zeros((width, width)), np.zeros((width, width))
    if not labels:
        unary[0, 0] = 5.0
        return Field(names, unary, chain, skip)
    y, around = np.array(labels), np.array(near)
    node = np.repeat(np.arange(len(rows)), [len(fs) + 1 for fs in rows])
    col = np.concatenate([[0, *(names.get(f, -1) for f in fs)] for fs in rows])
    node, col = node[col >= 0], col[col >= 0]
    goal = np.eye(width)[y]
    sums = [np.full(x.shape, 1e-6) for x in (unary, chain, skip)]
    for _ in range(rounds):
        z = np.zeros((len(rows), width))
        np.add.at(z, node, unary[col])
        z += around[:, 0] @ chain + around[:, 1] @ skip
        err = (_normal(z) - goal) / len(rows)
        d = np.zeros_like(unary)
        np.add.at(d, col, err[node])
        pairs = [around[:, which].T @ err for which in (0, 1)]  # a potential is the same from either end
        grads = (d + 1e-6 * unary, pairs[0] + pairs[0].T + 1e-6 * chain, pairs[1] + pairs[1].T + 1e-6 * skip)
        for x, g, s in zip((unary, chain, skip), grads, sums, strict=True):
            s += g * g
            x -= 0.5 * g / np.sqrt(s)
    return Field(names, unary, chain, skip)


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans)."""
    if not _MAYBE.search(text) and not (" at " in (low := text.lower()) and " dot " in low):
        return [], []
    base = base_spans(text)
    nodes = Nodes(text, base)
    more = []
    if len(nodes.kind) and not nodes.kind.all():
        p = field.marginals(nodes)
        for k in np.flatnonzero((nodes.kind == 0) & (p[:, 1:].max(axis=1) >= SURE)).tolist():
            more.append((KINDS[int(p[k, 1:].argmax())], *nodes.spans[k]))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return base, sorted({*base, *more}, key=lambda s: (order[s[0]], s[1], s[2]))


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [example(t, random.Random(zlib.crc32(t.encode("utf-8", "replace")))) for t in b.column("text").to_pylist() if base_spans(t)]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(e) for e in found if e], pa.string())], ["example"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on documents with a digit or @, of which a threshold on a hash takes about `sample`."""
    ship(docs.sparkSession)
    texts = docs.select(F.xxhash64("doc_id", text_of()).alias("h"), text_of().alias("text")).where("text rlike '[0-9@]'")
    steps = 1 << 20
    limit = min(steps, steps * sample // max(1, texts.count()) + 1)
    examples = texts.where(F.pmod("h", F.lit(steps)) < limit).select("text").mapInArrow(_examples, "example string")
    return fit([json.loads(x) for x in sorted(r[0] for r in examples.collect())])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, listed, added = [], [], []
            for text in b.column("text").to_pylist():
                base, every = find(text, field)
                kinds = [k for k, *_ in base]
                for k, kind in enumerate(KINDS):
                    counts[k].append(kinds.count(kind))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                listed.append(_listed(every))
                added.append(len(every) - len(set(base)))
            columns = [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
