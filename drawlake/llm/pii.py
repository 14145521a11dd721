"""Personal data: fixed rules, and a linear-chain conditional random field that adds what they miss.

Rules give the base spans (email, ip, card, phone). The field labels tokens (runs of letters, runs of
digits, single marks) with O or begin/inside of a kind, over word-shape features of the token and its
neighbours. It is trained in numpy from the small labelled table below and decoded by Viterbi over padded
batches. Tokens further than ``REACH`` characters from a digit, ``@`` or ``(at)`` have O as their only
label, so only stretches around those are decoded; overlapping reaches are one stretch. A stretch of more
than ``TILE`` tokens is decoded in tiles that see ``MARGIN`` tokens more on both sides. Decoded spans must pass the kind's arithmetic test
(Luhn, parts up to 255, digit counts) and may not overlap a base span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
REACH = 60
TILE = 256
MARGIN = 64
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The labelled table: lines whose personal data stands as <kind|text>.
LABELLED = (
    "Write to <email|jane.doe@example.org> before Friday.",
    "Mail: <email|sales-team@shop.example.com>, office open 9 to 5",
    "contact <email|info (at) garden.example.org> or come by",
    "contact <email|john.smith [at] mail.example.com> any time",
    "Ask <email|k.mayer (at) web.example.de> for the 3 forms",
    "reach us: <email|help [at] desk.example.net> (24 hours)",
    "the <email|the.90@mail2.example.com> la",
    "Phone <phone|+1 (017) 555-7713> or fax",
    "Tel. <phone|+49 30 1234567> until 18 h",
    "call <phone|(212) 555-0184> today",
    "please call <phone|(415) 555-0100>.",
    "Phone: <phone|(030) 555-2233>, ask for 2 seats",
    "tel <phone|(089) 555-9911> and leave a note",
    "her number is <phone|(303) 555-6612> now",
    "server <ip|192.168.12.7> answered",
    "Blocked <ip|97.51.17.173> after 5 tries",
    "from <ip|10.0.0.254>, port 443",
    "Card <card|4111 1111 1111 1111> was charged 20.50",
    "card: <card|5500005555555559>, paid",
    "las <card|4012888888881881> en",
    "Version 3.0 of the License, version 2.0 and 4.0.",
    "CC BY-NC 4.0. All rights reserved 2024.",
    "In 1998 there were 12,500 people and 3.5 % more in 1999.",
    'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" here',
    'key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    "Order 9807915762804491 shipped on 2023-04-05 at 10:30",
    "number 1234567890123456 is no card",
    "pages 12-14, chapter 3, section 2.1.4",
    "the score was 3-2 (2-1) after 90 minutes",
    "pay 1,299.00 or 15 (fifteen) a day",
    "see (1) and (2), 300 of 500 items",
    "code (555) and lot 2021-7713",
    "@home we met 7 of @the others",
    "room 101 at 8:00, gate B12",
)

_LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
_N = len(_LABELS)
_BITS = 14


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == "ip":
        parts = found.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", found.end() if found else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by the fixed rules, in order; code points, end exclusive."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for kind, pattern in ((1, _IP), (2, _CARD)):
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if passes(KINDS[kind], m[0])]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if passes("phone", m[0])]
    return sorted(out)


def _shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 20)}" + ("L" if 12 <= len(token) <= 19 and token.isascii() and luhn(token) else "")
    if token[0].isalpha():
        return ("A" if token.isupper() else "Aa" if token[0].isupper() else "a") + ("1" if len(token) == 1 else "")
    return token


def _feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") >> (32 - _BITS)


_known: dict[str, int] = {}


def _features(text: str, tokens: list[tuple[int, int]]) -> list[list[int]]:
    shape = [_shape(text[s:e]) for s, e in tokens]
    # whether white space stands before the token
    shape = [("_" if i == 0 or tokens[i - 1][1] < tokens[i][0] else "") + x for i, x in enumerate(shape)]
    around = ["<<", "<<", "<<", *shape, ">>", ">>", ">>"]
    out = []
    for i, (s, e) in enumerate(tokens):
        w = around[i : i + 7]
        names = ["", f"0{w[3]}", f"-1{w[2]}", f"+1{w[4]}", f"a{w[2]} {w[3]}", f"b{w[3]} {w[4]}", f"c{w[2]} {w[3]} {w[4]}", f"d{w[3]} {w[4]} {w[5]}", f"e{w[1]} {w[2]} {w[3]}", f"f{w[3]} {w[4]} {w[5]} {w[6]}", f"g{w[0]} {w[1]} {w[2]} {w[3]}"]
        if e - s <= 8:
            names.append(f"w{text[s:e].lower()}")
        row = []
        for n in names:
            if n not in _known:
                if len(_known) > 200_000:
                    _known.clear()
                _known[n] = _feature(n)
            row.append(_known[n])
        out.append(row)
    return out


@dataclass
class Field:
    """Weights of a linear-chain conditional random field."""

    emit: np.ndarray
    move: np.ndarray

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((x for r in rows for x in r), np.int64)
        return np.add.reduceat(self.emit[flat], np.r_[0, np.cumsum([len(r) for r in rows])[:-1]], axis=0)

    def viterbi(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequences of a batch of emission matrices; outside a sequence the label is O."""
        sizes = np.array([len(x) for x in batch])
        top = int(sizes.max())
        score = np.zeros((len(batch), top, _N))
        for i, x in enumerate(batch):
            score[i, : len(x)] = x
            score[i, len(x) :, 1:] = -1e9
        back = np.zeros((len(batch), top, _N), np.int8)
        now = score[:, 0] + self.move[0]
        for t in range(1, top):
            path = now[:, :, None] + self.move
            back[:, t] = path.argmax(1)
            now = path.max(1) + score[:, t]
        now = now + self.move[:, 0]
        label = now.argmax(1)
        out = np.zeros((len(batch), top), np.int64)
        for t in range(top - 1, -1, -1):
            out[:, t] = label
            label = back[np.arange(len(batch)), t, label]
        return [o[:n] for o, n in zip(out, sizes)]


def _legal() -> np.ndarray:
    """Inside follows begin or inside of its kind only."""
    ok = np.zeros((_N, _N))
    for j, b in enumerate(_LABELS):
        for i, a in enumerate(_LABELS):
            if b[0] == "I" and a[1:] != b[1:]:
                ok[i, j] = -1e6
    return ok


def train(lines: tuple[str, ...] = LABELLED, epochs: int = 40, rate: float = 0.3, seed: int = 1) -> Field:
    """Maximize the conditional likelihood by AdaGrad with forward-backward gradients."""
    rng = np.random.default_rng(seed)
    data = []
    for line in lines:
        text, spans = "", []
        for part in re.split(r"(<\w+\|[^>]*>)", line):
            if part.startswith("<") and "|" in part:
                kind, _, value = part[1:-1].partition("|")
                spans.append((len(text), len(text) + len(value), kind))
                part = value
            text += part
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        gold = []
        for s, e in tokens:
            hit = next(((a, k) for a, b, k in spans if a <= s < b), None)
            gold.append(0 if hit is None else _LABELS.index(("B-" if s == hit[0] else "I-") + hit[1]))
        data.append((_features(text, tokens), gold))
    field = Field(np.zeros((1 << _BITS, _N)), _legal())
    legal = field.move > -1e5
    g_emit, g_move = np.full((1 << _BITS, _N), 1e-2), np.full((_N, _N), 1e-2)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis)
        return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))

    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            rows, gold = data[i]
            e = field.emissions(rows)
            n = len(e)
            alpha, beta = np.zeros((n, _N)), np.zeros((n, _N))
            alpha[0] = e[0] + field.move[0]
            for t in range(1, n):
                alpha[t] = lse(alpha[t - 1][:, None] + field.move, 0) + e[t]
            beta[-1] = field.move[:, 0]
            for t in range(n - 2, -1, -1):
                beta[t] = lse(field.move + e[t + 1] + beta[t + 1], 1)
            total = lse(alpha[-1] + beta[-1], 0)
            unary = np.exp(alpha + beta - total)
            unary[np.arange(n), gold] -= 1
            pair = np.zeros((_N, _N))
            for t in range(1, n):
                pair += np.exp(alpha[t - 1][:, None] + field.move + e[t] + beta[t] - total)
                pair[gold[t - 1], gold[t]] -= 1
            pair = np.where(legal, pair + 1e-3 * field.move, 0)
            g_move += pair**2
            field.move -= rate * pair / np.sqrt(g_move)
            for t, row in enumerate(rows):
                grad = unary[t] + 1e-3 * field.emit[row]
                g_emit[row] += grad**2
                field.emit[row] -= rate * grad / np.sqrt(g_emit[row])
    return field


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within ``REACH`` of a trigger, to the next blank on both sides, not across lines; overlapping ones are one."""
    out: list[list[int]] = []
    end = -1  # of the line
    for m in _TRIGGER.finditer(text):
        p = m.start()
        if p > end:
            line = text.rfind("\n", out[-1][1] if out else 0, p) + 1
            end = text.find("\n", p)
            end = len(text) if end < 0 else end
        if out and p + REACH <= out[-1][1] or out and out[-1][1] == end:
            continue
        last = out[-1][1] if out else 0
        lo = p - REACH
        if lo > max(line, last):
            lo = max(text.rfind(" ", max(line, last), lo) + 1, line, last)
        lo = max(lo, line)
        hi = text.find(" ", p + REACH, end) if p + REACH < end else end
        hi = end if hi < 0 else hi
        if out and lo <= last and line <= last:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def find_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    work, tiles = [], []
    for i, text in enumerate(texts):
        for lo, hi in stretches(text):
            tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
            if tokens:
                step = TILE if len(tokens) > TILE else len(tokens)
                tiles += [(len(work), at, max(at - MARGIN, 0), min(at + step + MARGIN, len(tokens))) for at in range(0, len(tokens), step)]
                work.append((i, tokens, np.zeros(len(tokens), np.int8)))
    spans = [list(b) for b in base]
    tiles.sort(key=lambda x: x[3] - x[2])
    for at in range(0, len(tiles), 512):
        some = tiles[at : at + 512]
        paths = field.viterbi([field.emissions(_features(texts[work[w][0]], work[w][1][lo:hi])) for w, _, lo, hi in some])
        for (w, own, lo, _), path in zip(some, paths):
            label = work[w][2][own : own + TILE] if len(work[w][1]) > TILE else work[w][2]
            label[:] = path[own - lo : own - lo + len(label)]
    for i, tokens, path in work:
        t = 0
        while t < len(path):
            label = _LABELS[path[t]]
            end = t + 1
            if label[0] == "B":
                while end < len(path) and _LABELS[path[end]] == "I" + label[1:]:
                    end += 1
                s, e, kind = tokens[t][0], tokens[end - 1][1], label[2:]
                if passes(kind, texts[i][s:e]) and not any(a < e and s < b for a, _, b in spans[i]):
                    spans[i].append((s, KINDS.index(kind), e))
            t = end
    return [(b, sorted(s)) for b, s in zip(base, spans)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find_spans([t or "" for t in batch.column(1).to_pylist()], field)
            counts = [pa.array([sum(k == kind for _, k, _ in b) for b, _ in found], pa.int64()) for kind in range(4)]
            hashes = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            spans, n = pa.array([_joined(a) for _, a in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, hashes, spans, n], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans)`` for each row.

    Counts by kind and the hash are of the base spans; ``spans`` also lists those the field adds, and ``n_spans``
    counts them all. Null text is empty,
    a null doc_id is kept, repeated rows are judged each, very long texts are read whole, no rows give no rows.
    Other columns are ignored, whatever their names.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(_find(train()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def _mask(field: Field, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(column).to_pylist()
            out = []
            for text, (_, spans) in zip(texts, find_spans([t or "" for t in texts], field)):
                parts, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append(text if text is None or not spans else "".join([*parts, text[at:]]))
            columns = list(batch.columns)
            columns[column] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; null stays null; other columns unchanged."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_mask(train(), docs.columns.index("text")), kinds)
