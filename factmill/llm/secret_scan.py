"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams that every match must hold is derived. Each batch of
texts gets an inverted index from those trigrams (of the ASCII-lower-cased UTF-8 bytes) to its texts; the queries run
over its postings and only texts that they leave are searched with the expression. A rule without mandatory trigrams
scans every text. The index is never larger than its batch, so memory is bounded and no row is shuffled.

Defined results: a null text counts as empty; texts without secrets have an empty list; repeated rows give repeated
results; other columns are left out. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as _c
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import append_columns, read


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the group that must have at least so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base rules of the contract.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Rules of the method's own; each begins where its run of characters begins, so no text takes quadratic time.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("forge", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay", r"(?<![A-Za-z0-9_])[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Strings that the analysis of an expression may hold at once; beyond it the part counts as anything.
MOST_STRINGS = 64


# A query is True (anything), or ("and" | "or", parts), or a trigram of bytes.
def _all(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts: list) -> object:
    if not parts or True in parts:
        return True
    return parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _grams(strings: set[bytes]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _char(code: int) -> bytes:
    return chr(code).encode().translate(_LOWER)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _part(op, arg) -> tuple[set[bytes] | None, object]:
    """The strings that an element can match, where they are few, or else what each of its matches must hold."""
    if op is _c.LITERAL:
        return {_char(arg)}, True
    if op is _c.IN and all(x[0] is _c.LITERAL for x in arg):
        return {_char(x[1]) for x in arg}, True
    if op is _c.SUBPATTERN:
        return _sequence(arg[-1])
    if op is _c.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*[s for s, _ in parts]), True
        return None, _any([q if s is None else _grams(s) for s, q in parts])
    if op in (_c.MAX_REPEAT, _c.MIN_REPEAT, _c.POSSESSIVE_REPEAT):
        least, most, item = arg
        strings, query = _sequence(item)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {b""}, True
        if least == most == 1:
            return strings, query
        return None, True if least == 0 else query if strings is None else _grams(strings)
    if op in (_c.AT, _c.ASSERT, _c.ASSERT_NOT):
        return {b""}, True
    return None, True


def _sequence(items) -> tuple[set[bytes] | None, object]:
    run, queries, whole = {b""}, [], True
    for op, arg in items:
        strings, query = _part(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        queries.append(_grams(run))
        whole, run = False, {b""}
        if strings is None:
            queries.append(query)
        else:
            queries.append(_grams(strings))
    return (run, True) if whole else (None, _all([*queries, _grams(run)]))


def trigram_query(pattern: str) -> object:
    """What every match of the expression holds, as a Boolean query over trigrams; True where nothing is mandatory."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else _grams(strings)


def _leaves(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(_leaves, query[1]))


class Index:
    """Postings of wanted trigrams over a batch of texts."""

    def __init__(self, wanted: list[bytes]):
        self.number = {g: i + 1 for i, g in enumerate(wanted)}
        self.of_code = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint16)
        for g, i in self.number.items():
            self.of_code[g[0] << 16 | g[1] << 8 | g[2]] = i
        self.postings: dict[int, np.ndarray] = {}
        self.every = np.arange(0)

    def build(self, texts: list[str]) -> None:
        raw = [t.encode().translate(_LOWER) for t in texts]
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
        b = np.frombuffer(b"\xff".join(raw) + b"\xff\xff\xff", np.uint8).astype(np.int32)
        found = self.of_code[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        gram, text = pairs // max(1, len(texts)), pairs % max(1, len(texts))
        cuts = np.flatnonzero(np.diff(gram)) + 1
        self.postings = {int(g[0]): d for g, d in zip(np.split(gram, cuts), np.split(text, cuts), strict=True) if len(g)}
        self.every = np.arange(len(texts))

    def ask(self, query) -> np.ndarray:
        if query is True:
            return self.every
        if isinstance(query, bytes):
            return self.postings.get(self.number[query], self.every[:0])
        lists = sorted((self.ask(q) for q in query[1]), key=len)
        out = lists[0]
        for more in lists[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if query[0] == "and" else np.union1d(out, more)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.index = Index(sorted(set().union(*[_leaves(q) for _, _, q in self.rules])))

    def scan(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text by start, then by the order of the rules."""
        self.index.build(texts)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, pattern, query) in enumerate(self.rules):
            for i in self.index.ask(query).tolist():
                for m in pattern.finditer(texts[i]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        spans[i].append((m.start(), n, m.end()))
        return [[(self.rules[n][0].kind, a, b) for a, n, b in sorted(x)] for x in spans]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each run of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, redacted: bool = False, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """id_col, the columns in keep, and after prefix spans array<struct<kind,start,end>>; with redacted also the text without its secrets."""

    def prepare():
        scanner = Scanner(rules)

        def work(texts):
            spans = scanner.scan([t or "" for t in texts])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            out = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans], kind)]
            if redacted:
                out.append(pa.array([t if not x else redact(t, x) for t, x in zip(texts, spans, strict=True)], pa.string()))
            return out

        return work

    return append_columns(df, [id_col, *keep], text_col, f"spans {SPANS}" + ", redacted string" * redacted, prepare, prefix)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest of every document, all spans of base and further rules, and their number."""
    out = scan(read(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
