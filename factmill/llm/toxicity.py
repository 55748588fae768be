"""Toxicity by nearest labelled examples, with exact TF-IDF cosine over a block-max inverted index.

Terms are whole words and their character 5-grams (with word ends). The vocabulary is that of the sample's terms which
depend on the label: a chi-square test at ALPHA, corrected for the number of terms (and never fewer than LEAST_TERMS). A
text is the normalised vector of its terms' tf-idf, (1 + log tf) * idf. Labelled examples are sorted so that like ones lie
together and cut into blocks. The index has for each term its postings (example and weight), in block order, and for each
of its blocks the largest weight. A query's bound for a block is the sum of its weights times those maxima, over its own
terms; blocks are opened from the highest bound down, only their postings are read, and none is opened once the K best
cosines found reach the next bound, so the K nearest examples are exact. Their votes, weighted by the fourth power of the
cosine, are mapped to a probability by isotonic regression on the examples themselves, each scored without itself and
weighted by its label's true share. The nearest examples are the evidence.

The examples are at most PER_LABEL distinct ids of each label, those of smallest hash among texts of at most FIT_CHARS,
and SAMPLE_CHARS characters in all; of near copies among them one is left, as a group of copies would else make its words
look as if they depended on the label. All other things cover all rows. What is broadcast has a fixed bound from that.

Defined results: null, empty and blank texts, and texts without any term of the vocabulary, score as the examples without
terms do; without labelled rows of both kinds every score is the share of label 1 (0 without any); repeated rows give
repeated results and count once in the sample; of several texts of one id the smallest is the example; equal cosines go
to the example with the smaller id; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import near
from factmill.llm.common import append_columns, crc_mod, hash_sample, keyed, read
from factmill.llm.decontaminate import WORDS

#: Bounds of the sample.
PER_LABEL, FIT_CHARS, SAMPLE_CHARS = 2400, 50_000, 32_000_000
#: Examples of a label that agree in half of so many MinHash values are near copies.
VALUES = 64
GRAM = 5
#: Level of the test that chooses terms, and the least and largest vocabulary.
ALPHA, LEAST_TERMS, MOST_TERMS = 0.01, 100, 20_000
NEAREST = 31
#: A neighbour's vote is its cosine to this power.
POWER = 4
BLOCK = 32
THRESHOLD = 0.3
TABLE_ROWS = 300_000


def terms_of(word: bytes) -> list[bytes]:
    """A word's terms: itself between marks, and its n-grams; n is in bytes."""
    w = b"<" + word + b">"
    return [w, *{w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}] if len(w) > GRAM else [w]


def dependent_terms(counts: dict[bytes, list[int]], n0: int, n1: int) -> list[bytes]:
    """Terms, in at least 5 texts, whose presence depends on the label, by falling chi-square. counts: texts of either label."""
    n, rank = n0 + n1, []
    for t, (a, b) in counts.items():
        m = a + b
        if 5 <= m < n:
            rank.append((-n * (b * n0 - a * n1) ** 2 / (m * (n - m) * n0 * n1), t))
    rank.sort()
    limit = NormalDist().inv_cdf(1 - ALPHA / max(1, len(rank)) / 2) ** 2
    passed = sum(-x >= limit for x, _ in rank)
    return [t for x, t in rank[: min(MOST_TERMS, max(passed, LEAST_TERMS))] if x < 0]


class Index:
    def __init__(self, ids: list[int], texts: list[str], labels: list[int], share: float):
        """share: of label 1 among all labelled rows, of which the examples are a sample that may have another."""
        self.share = share
        y = np.array(labels, int)
        self.terms: dict[bytes, int] = {}
        self.fitted = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        df: dict[bytes, list[int]] = {}
        memo: dict[bytes, list[bytes]] = {}
        for text, label in zip(texts, labels, strict=True):
            own: set[bytes] = set()
            for w in set(text.encode().translate(WORDS).split()):
                if w not in memo:
                    memo[w] = terms_of(w)
                own.update(memo[w])
            for t in own:
                df.setdefault(t, [0, 0])[label] += 1
        del memo
        n1, n0 = int(y.sum()), int(len(y) - y.sum())
        chosen = dependent_terms(df, n0, n1)
        self.terms = {t: i for i, t in enumerate(chosen)}
        self.idf = np.array([np.log((1 + len(y)) / (1 + sum(df[t]))) + 1 for t in chosen], np.float64)
        vectors = self.vectors(texts)
        # Like examples together: by their strongest term, then label, then id.
        order = sorted(range(len(y)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]) if len(vectors[i][0]) else -1, labels[i], ids[i]))
        self.ids, self.y = np.array([ids[i] for i in order], np.int64), y[order]
        self._postings([vectors[i] for i in order])
        # Calibration: each example scored without itself; its label's true share is its weight.
        own = [self.nearest(*vectors[i], skip=j) for j, i in enumerate(order)]
        votes = np.array([self.vote(*x) for x in own])
        w = np.where(self.y == 1, share / n1, (1 - share) / n0)
        bare = np.array([not len(x[0]) for x in own])
        self.bare = float((w * self.y)[bare].sum() / w[bare].sum()) if bare.any() and w[bare].sum() > 0 else share
        self.steps, self.values = _isotonic(votes[~bare], self.y[~bare].astype(float), w[~bare])

    def _postings(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """place and weight of every posting, by term and then place; spans: each term's blocks, with the first posting and
        the largest weight of each; first: each term's first span."""
        term = np.concatenate([at for at, _ in vectors] or [np.zeros(0, np.int64)])
        place = np.repeat(np.arange(len(vectors)), [len(at) for at, _ in vectors])
        weight = np.concatenate([v for _, v in vectors] or [np.zeros(0)])
        order = np.lexsort((place, term))
        term, self.place, self.weight = term[order], place[order], weight[order]
        self.blocks = -(-len(vectors) // BLOCK)
        span = term * self.blocks + self.place // BLOCK
        begin = np.flatnonzero(np.diff(span, prepend=-1))
        self.span_block = (self.place // BLOCK)[begin]
        self.span_start = np.append(begin, len(span))
        self.span_most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.zeros(0)
        self.first = np.searchsorted(term[begin], np.arange(len(self.terms) + 1))

    def vectors(self, texts: list[str], table: dict[bytes, tuple[int, ...]] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms and normalised weights of each text."""
        table = {} if table is None else table
        out, get, terms = [], table.get, self.terms
        for text in texts:
            words = text.encode().translate(WORDS).split()
            if len(table) > TABLE_ROWS:
                table.clear()
            for w in {w for w in words if w not in table}:
                table[w] = tuple(terms[t] for t in terms_of(w) if t in terms)
            hits = [x for x in map(get, words) if x]
            if not hits:
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            at, n = np.unique(np.array([i for x in hits for i in x], np.int64), return_counts=True)
            v = (1 + np.log(n)) * self.idf[at]
            out.append((at, v / np.sqrt((v * v).sum())))
        return out

    def nearest(self, at: np.ndarray, v: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the K nearest examples with a positive cosine, exactly."""
        place, cos = np.zeros(0, np.int64), np.zeros(0)
        if not len(at):
            return place, cos
        spans = _ranges(self.first[at], self.first[at + 1])
        value = np.repeat(v, self.first[at + 1] - self.first[at])
        bound = np.bincount(self.span_block[spans], value * self.span_most[spans], self.blocks) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        opened, step = 0, 4
        while opened < len(order):
            some = order[opened : opened + step]
            if len(cos) == NEAREST:
                some = some[bound[some] >= cos[-1]]
            if not len(some):
                break
            take = np.zeros(self.blocks, bool)
            take[some] = True
            mine = take[self.span_block[spans]]
            a, b = self.span_start[spans[mine]], self.span_start[spans[mine] + 1]
            read = _ranges(a, b)
            got = np.bincount(self.place[read], np.repeat(value[mine], b - a) * self.weight[read])
            new = np.flatnonzero(got)
            new = new[new != skip]
            place, cos = np.concatenate([place, new]), np.concatenate([cos, got[new]])
            best = np.lexsort((self.ids[place], -np.round(cos, 9)))[:NEAREST]
            place, cos = place[best], cos[best]
            opened += step
            step *= 4
        return place, cos

    def vote(self, place: np.ndarray, cos: np.ndarray) -> float:
        """The share of label 1, with a tenth of a vote that is undecided, so that few or far neighbours say little."""
        w = cos**POWER
        return (float(w[self.y[place] == 1].sum()) + 0.05) / (float(w.sum()) + 0.1) if len(place) else 0.0

    def score(self, texts: list[str], table: dict) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Score and evidence (id, label and cosine of the three nearest examples) of each text."""
        if not self.fitted:
            return [(self.share, [])] * len(texts)
        out = []
        for at, v in self.vectors(texts, table):
            place, cos = self.nearest(at, v)
            if not len(place):
                out.append((self.bare, []))
                continue
            s = float(np.interp(self.vote(place, cos), self.steps, self.values))
            out.append((min(1.0, max(0.0, s)), [(int(self.ids[p]), int(self.y[p]), float(c)) for p, c in zip(place[:3], cos[:3], strict=True)]))
        return out


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integers of the ranges from a to b, one range after another."""
    n = b - a
    return np.arange(n.sum()) + np.repeat(a - np.cumsum(n) + n, n)


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising function of x that is nearest to y (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted y, weighted x
    for i in order.tolist():
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    return np.array([p[2] / p[0] for p in pools] or [0.0]), np.array([p[1] / p[0] for p in pools] or [0.0])


def without_copies(rows: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Examples (id, label, text) of which none agrees with an earlier one of its label in half of the MinHash values."""
    shingler, (a, b) = near.Shingler(), near.multipliers(VALUES)
    out = []
    for label in (0, 1):
        seen, n = np.zeros((len(rows), VALUES), np.uint16), 0
        for r in (r for r in rows if r[1] == label):
            s = shingler.shingles(r[2])
            if len(s):
                seen[n] = near.signature(s, a, b)
                if ((seen[:n] == seen[n]).sum(1) >= VALUES // 2).any():
                    continue
                n += 1
            out.append(r)
    return sorted(out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Index:
    """Fit on a bounded sample: ids by narrow columns first, then their texts by a broadcast join with at most
    2 * per_label ids."""
    y = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    rows = keyed(docs, k=id_col, t=text_col).filter(F.length("t") <= FIT_CHARS)
    lengths = rows.select("k", F.length("t").alias("n"))
    # Labelled rows need not have a text of the right length; those found in a scan of narrow columns are chosen from.
    sized = lambda found: lengths.join(F.broadcast(found), "k").groupBy("y", "k", "h").agg(F.max("n").alias("n"))
    ids = hash_sample(y, "y", "k", per_label, 2 * per_label, SAMPLE_CHARS, sized)
    if not ids:
        return Index([], [], [], share)
    chosen = docs.sparkSession.createDataFrame(ids, f"y int, k {dict(rows.dtypes)['k']}")
    got = rows.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    kept = without_copies(sorted((r["k"], r["y"], r["t"]) for r in got))
    return Index([k for k, _, _ in kept], [t for _, _, t in kept], [y for _, y, _ in kept], share)


def score(df: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, score and evidence array<struct<doc_id,label,cosine>> of every row."""
    shared = df.sparkSession.sparkContext.broadcast(index)

    def prepare():
        own, table = shared.value, {}

        def work(texts):
            got = own.score([t or "" for t in texts], table)
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
            evidence = [[{"doc_id": a, "label": b, "cosine": c} for a, b, c in e] for _, e in got]
            return [pa.array([s for s, _ in got], pa.float64()), pa.array(evidence, kind)]

        return work

    return append_columns(df, [id_col, *keep], text_col, "score double, evidence array<struct<doc_id:bigint,label:int,cosine:double>>", prepare)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from labels that are not held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    index = fit(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    out = score(docs, index)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
