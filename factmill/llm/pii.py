"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes.

The base patterns (email, ip, card, phone) are found exactly as defined. The field adds spans of three kinds that have no
fixed form: names after a form of address, telephone numbers without a country prefix, and national identity numbers. Its
features are the class (a cue word or a shape) of a word and of its two neighbours; it is trained on a small labelled
table by gradient ascent, and decoded by Viterbi over numpy batches of lines. A line is decoded only if some word of it
could, by an upper bound that is computed from the weights, take part in a labelled path; for all others the path without
labels is proven best, so the result is that of decoding every line. An added span that meets a base span is left out.

Defined results: a null text counts as empty; texts without personal data have an empty list; repeated rows give repeated
results; other columns are left out. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import keyed, map_batches, read, texts_of
from factmill.llm.secret_scan import SPANS, joined

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("name", "tel", "natid")

# The base patterns of the contract. The possessive forms find the same matches in linear time.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- the field

LABELS = ("O", *(f"{b}-{k}" for k in ADDED_KINDS for b in "BI"))
_CUES = {
    "HON": "mr mrs ms miss dr prof mister herr frau monsieur madame mme senor señor senora señora sr sra",
    "TEL": "tel phone telephone call fax mobile telefon téléphone teléfono",
    "IDC": "ssn passport social security nif dni insurance",
}
CUES = {w: k for k, words in _CUES.items() for w in words.split()}
_EDGE = ".,;:!?()[]{}\"'<>“”«»"
_RUNS = re.compile(r"([xX])\1+")
_SHAPE = str.maketrans(
    {**{c: "d" for c in "0123456789"}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}}
)


def word_class(word: str) -> str:
    """The cue that a word is, or its shape: digits stay, so do marks; runs of letters become one letter."""
    core = word.strip(_EDGE)
    if cue := CUES.get(core.lower()):
        return cue
    if core.isascii() and core.isalpha():
        if len(core) > 24:
            return "long"
        if core.islower():
            return "x"
        if core[0].isupper() and core[1:].islower():
            return "Xx"
    if len(core) > 24:
        return "long"
    shape = core.translate(_SHAPE)
    if not shape.isascii():
        shape = "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in shape)
    return _RUNS.sub(r"\1", shape) or "mark"


def labelled_table(rows: int = 300, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: lines from templates whose slots name what stands there, with the labels of their words."""
    rng = random.Random(seed)
    digits = lambda pattern: re.sub("d", lambda _: str(rng.randrange(10)), pattern)
    low = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9)))
    cap = lambda: low().capitalize()
    cue = lambda kind: rng.choice(_CUES[kind].split())
    tel = ("ddd-ddd-dddd", "ddd.ddd.dddd", "(ddd) ddd-dddd", "ddd ddd dddd", "dddd dddddd", "ddd-dddd")
    ids = ("ddd-dd-dddd", "ddd-dd-dddd", "dddddddd", "ddddddddd")
    noise = (
        lambda: [low()], lambda: [low() + ","], lambda: [low() + "."], lambda: [cap()], lambda: [cap(), cap()], lambda: [digits("dddd")],
        lambda: [digits("d.d")], lambda: [digits("+d (ddd) ddd-dddd")], lambda: [digits("dd")], lambda: [digits("d" * 16)], lambda: [digits("ddd.dd.ddd.dd")],
        lambda: [f"{low()}.{digits('dd')}@{low()}.com"], lambda: [low().upper()], lambda: [digits("dddd-dd-dd")], lambda: [cue("TEL"), low()], lambda: [cue("IDC"), low()], lambda: [cue("HON"), low()],
    )
    out = []
    for _ in range(rows):
        words, labels = [], []

        def put(parts: list[str], kind: str = "") -> None:
            parts = " ".join(parts).split()
            words.extend(parts)
            labels.extend([f"{'B' if i == 0 else 'I'}-{kind}" if kind else "O" for i in range(len(parts))])  # noqa: B023

        for _ in range(rng.randint(1, 4)):
            put(rng.choice(noise[:4] if rng.random() < 0.5 else noise)())
        for _ in range(rng.randint(0, 2)):
            kind = rng.choice(ADDED_KINDS)
            if kind == "name":
                put([cue("HON").capitalize() + rng.choice(("", "."))])
                put([cap() for _ in range(rng.randint(1, 2))], "name")
            elif kind == "tel":
                put([cue("TEL").capitalize() + rng.choice(("", ":"))])
                put([digits(rng.choice(tel))], "tel")
            else:
                put([cue("IDC").upper()])
                put([digits(rng.choice(ids))], "natid")
            for _ in range(rng.randint(1, 3)):
                put(rng.choice(noise[:3])())
        out.append((words, labels))
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


class Field:
    """Weights: of the class before, at and after a word for each label, and of each pair of labels in a row."""

    def __init__(self, table: list[tuple[list[str], list[str]]], rounds: int = 120, penalty: float = 0.002):
        seen = sorted({word_class(w) for words, _ in table for w in words})
        # 0: the edge of a line; 1: a class that the table doesn't hold.
        self.number = {c: i + 2 for i, c in enumerate(seen)}
        f, k = len(seen) + 2, len(LABELS)
        n, t = len(table), max(len(w) for w, _ in table)
        x, y, size = np.zeros((n, t), np.int64), np.zeros((n, t), np.int64), np.array([len(w) for w, _ in table])
        for i, (words, labels) in enumerate(table):
            x[i, : len(words)] = [self.number[word_class(w)] for w in words]
            y[i, : len(words)] = [LABELS.index(z) for z in labels]
        inside = np.arange(t)[None] < size[:, None]
        before, after = np.pad(x, ((0, 0), (1, 0)))[:, :-1], np.pad(x, ((0, 0), (0, 1)))[:, 1:]
        self.w = [np.zeros((f, k)) for _ in range(3)] + [np.zeros((k, k))]
        m, v = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w]
        own = np.eye(k)[y] * inside[..., None]
        pairs = np.einsum("ntj,ntk->jk", own[:, :-1], own[:, 1:])
        for r in range(1, rounds + 1):
            e = (self.w[0][before] + self.w[1][x] + self.w[2][after]) * inside[..., None]
            alpha, beta = [e[:, 0]], [np.zeros((n, k))]
            for j in range(1, t):
                alpha.append(np.where(inside[:, j, None], _lse(alpha[-1][:, :, None] + self.w[3][None], 1) + e[:, j], alpha[-1]))
            for j in range(t - 1, 0, -1):
                beta.append(np.where(inside[:, j, None], _lse(self.w[3][None] + (e[:, j] + beta[-1])[:, None, :], 2), 0))
            alpha, beta = np.stack(alpha, 1), np.stack(beta[::-1], 1)
            z = _lse(alpha[:, -1], 1)[:, None, None]
            gamma = np.exp(alpha + beta - z) * inside[..., None]
            xi = np.exp(alpha[:, :-1, :, None] + self.w[3] + (e + beta)[:, 1:, None, :] - z[..., None]) * inside[:, 1:, None, None]
            grads = []
            for at in (before, x, after):
                g = np.zeros((f, k))
                np.add.at(g, at.ravel(), (own - gamma).reshape(-1, k))
                grads.append(g)
            grads.append(pairs - xi.sum((0, 1)))
            for i, g in enumerate(grads):
                g = g / n - penalty * self.w[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
                self.w[i] += 0.1 * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
        # A label inside a span can't follow anything but its own span, nor begin a line.
        for j, b in enumerate(LABELS):
            for i, a in enumerate(LABELS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.w[3][i, j] = -1e9
            if b[0] == "I":
                self.w[0][0, j] = -1e9
        # Upper bound, for each class with its neighbours or an edge, of what each label can gain over O there: its
        # emission, the best transition into it and, as it may be the last of its span, out of it.
        gain = [a[:, 1:] - a[:, :1] for a in self.w[:3]]
        step = self.w[3] - self.w[3][0, 0]
        gain[1] = gain[1] + step[:, 1:].max(0) + np.maximum(0, step[1:, 0])
        b, a = np.maximum(gain[0], gain[0][:1]), np.maximum(gain[2], gain[2][:1])
        bound = np.maximum(b[:, None, None, :] + gain[1][None, :, None, :] + a[None, None, :, :], -50.0).reshape(f**3, -1)
        self.first, self.more, self.size = bound[:, ::2], bound[:, 1::2], f

    def possible(self, x: np.ndarray) -> bool:
        """Whether a row of classes may have a labelled path that is no worse than the path without labels. A span gains
        at most what its first word gains with a B label and its others with I labels; the best sum over all spans comes
        from running sums and running maxima."""
        at = (np.append(0, x[:-1]) * self.size + x) * self.size + np.append(x[1:], 0)
        first = self.first[at]
        if (first >= 0).any():
            return True
        sums = self.more[at].cumsum(0)
        return bool((sums[1:] + np.maximum.accumulate(first - sums, 0)[:-1] >= -1e-6).any())

    def classes(self, words: list[str]) -> list[int]:
        return [self.number.get(word_class(w), 1) for w in words]

    def decode(self, lines: list[list[int]]) -> list[list[int]]:
        """The best labels of each line of classes, lines of like length together."""
        out: list[list[int]] = [[] for _ in lines]
        order = sorted((i for i, x in enumerate(lines) if x), key=lambda i: len(lines[i]))
        while order:
            n = max(1, min(len(order), 200_000 // len(lines[order[-1]])))
            part, order = order[-n:], order[:-n]
            size = np.array([len(lines[i]) for i in part])
            x = np.zeros((n, size.max()), np.int64)
            for r, i in enumerate(part):
                x[r, : size[r]] = lines[i]
            e = self.w[0][np.pad(x, ((0, 0), (1, 0)))[:, :-1]] + self.w[1][x] + self.w[2][np.pad(x, ((0, 0), (0, 1)))[:, 1:]]
            best, back = e[:, 0], []
            for j in range(1, x.shape[1]):
                s = best[:, :, None] + self.w[3][None]
                came = s.argmax(1)
                live = (j < size)[:, None]
                best = np.where(live, s.max(1) + e[:, j], best)
                back.append(np.where(live, came, np.arange(len(LABELS))[None]).astype(np.int8))
            label = best.argmax(1)
            path = [label]
            for came in reversed(back):
                label = came[np.arange(n), label]
                path.append(label)
            path = np.stack(path[::-1], 1)
            for r, i in enumerate(part):
                out[i] = path[r, : size[r]].tolist()
        return out


class Tagger:
    """Spans of the field in whole texts."""

    def __init__(self, field: Field, table_rows: int = 300_000):
        self.field, self.table, self.table_rows = field, {}, table_rows

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        field, table = self.field, self.table
        lines, places = [], []
        for i, text in enumerate(texts):
            words = text.split()
            if not words:
                continue
            if len(table) > self.table_rows:
                table.clear()
            for w in {w for w in words if w not in table}:
                table[w] = field.number.get(word_class(w), 1)
            c = np.fromiter(map(table.__getitem__, words), np.int32, len(words))
            if not field.possible(c):
                continue
            at = 0
            for line in text.split("\n"):
                own = [(m.start(), m.end()) for m in re.finditer(r"\S+", line)]
                x = np.array([table[w] if (w := line[a:b]) in table else field.number.get(word_class(w), 1) for a, b in own], np.int32)
                if len(x) and field.possible(x):
                    lines.append(x.tolist())
                    places.append((i, at, own))
                at += len(line) + 1
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for labels, (i, at, own) in zip(field.decode(lines), places, strict=True):
            for j, label in enumerate(labels):
                if label and LABELS[label][0] == "B":
                    e = j
                    while e + 1 < len(labels) and labels[e + 1] and LABELS[labels[e + 1]] == "I" + LABELS[label][1:]:
                        e += 1
                    a, b = at + own[j][0], at + own[e][1]
                    while a < b and texts[i][a] in ".,;:!?[]{}\"'<>":
                        a += 1
                    while b > a and texts[i][b - 1] in _EDGE and texts[i][b - 1] != ")":
                        b -= 1
                    if a < b:
                        out[i].append((LABELS[label][2:], a, b))
        return out


def find(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """All spans of each text by kind (base ones first), then start; added ones that meet a base span are left out."""
    out = []
    for text, added in zip(texts, tagger.spans(texts), strict=True):
        base = base_spans(text)
        added = [s for s in added if not any(s[1] < e and b < s[2] for _, b, e in base)]
        out.append(base + sorted(added, key=lambda s: (ADDED_KINDS.index(s[0]), s[1])))
    return out


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """id_col and spans array<struct<kind,start,end>>. The field is a few hundred numbers, trained here if none is given."""
    field = field or Field(labelled_table())

    def prepare():
        tagger = Tagger(field)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in find(texts_of(batch, "t"), tagger)]
            return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(rows, kind)], ["k", "spans"])

        return step

    kind = dict(df.dtypes)[id_col]
    return map_batches(keyed(df, k=id_col, t=text_col), f"k {kind}, spans {SPANS}", prepare).withColumnRenamed("k", id_col)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest of every document, all spans and their number."""
    out = detect(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *map(count, BASE_KINDS),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(list(BASE_KINDS)))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
