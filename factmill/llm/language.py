"""Language identification by the nearest of several centroids per language.

A text is the vector of its byte n-grams (one to three bytes, ASCII letters lower-cased, everything else that is not a
letter taken as a space) over a vocabulary that the sample chooses, weighted by 1 + log of the count and by inverse document
frequency, and normalised. Spherical k-means clusters the sample of each language into several centroids. The prediction
is the language of the centroid of highest cosine. A text is rejected if its cosine is below the distance limit of that
language's centroids, a low quantile of the cosines of its sample's texts with the mean of the others in their cluster, or
if it has no letter (und).

The model is fitted on at most PER_LANGUAGE distinct ids of every language, those of smallest hash, and no text longer than
FIT_CHARS; beyond SAMPLE_TEXTS texts or SAMPLE_CHARS characters in all, every language gets fewer, but never none. Document
frequencies of the sample are all the statistics there are. Everything else covers all rows.

Defined results: null texts and texts without a letter are und with score 0, and are rejected; without learned languages
every text is und; repeated rows give repeated results and count once in the sample; of several texts of one id and
language the smallest is taken; equal cosines go to the first language in alphabetical order; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import append_columns, crc_mod, hash_sample, keyed, read

#: Bounds of the sample.
PER_LANGUAGE, FIT_CHARS = 300, 50_000
SAMPLE_TEXTS, SAMPLE_CHARS = 6000, 64_000_000
VOCABULARY = 3000
CENTROIDS = 3
#: A text is rejected below this quantile of the cosines of its language's sample. One limit for all clusters of a language,
#: since short texts, which have low cosines, gather in one of them; languages with fewer than two
#: texts below the quantile share that of all samples.
REJECT_QUANTILE = 0.01
#: Texts of fewer characters have few n-grams, and so low cosines in their own language; half the limit holds for them.
SHORT = 64
#: A cluster has at least this share of the sample of its language, so that no outlier is a centroid.
LEAST_SHARE = 0.1
_BATCH_BYTES = 2 << 20

# ASCII letters in lower case and all bytes beyond ASCII stay; whatever else stands becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the n-grams of one, two and three bytes; those of different lengths differ."""
    b = np.frombuffer(raw, np.uint8).astype(np.int32)
    two = b[:-1] << 8 | b[1:]
    return b, two + 256, (two[:-1] << 8 | b[2:]) + 65792


_CODES = 65792 + (1 << 24)


class Model:
    def __init__(self, texts: list[str], langs: list[str], size: int = VOCABULARY, k: int = CENTROIDS):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        counts: dict[int, int] = {}
        per_lang: dict[str, dict[int, int]] = {x: {} for x in self.langs}
        for t, lang in zip(texts, langs, strict=True):
            own = per_lang[lang]
            for code in np.unique(np.concatenate(grams(self.bytes_of(t)))).tolist():
                counts[code] = counts.get(code, 0) + 1
                own[code] = own.get(code, 0) + 1
        # The n-grams that are in the largest share of the texts of some language.
        of = {x: langs.count(x) for x in self.langs}
        least = min(2, max(counts.values(), default=0))  # n-grams of a single text tell nothing, unless there are no others
        share: dict[int, float] = {}
        for x, own in per_lang.items():
            for c, n in own.items():
                if counts[c] >= least:
                    share[c] = max(share.get(c, 0.0), n / of[x])
        chosen = sorted(share, key=lambda c: (-share[c], c))[:size]
        self.codes = np.array(sorted(chosen), np.int64)
        self.idf = np.array([np.log((1 + len(texts)) / (1 + counts[c])) + 1 for c in self.codes.tolist()])
        x = np.concatenate([v for v, _ in self.vectors(texts)]) if texts else np.zeros((0, len(self.codes)))
        self.centroids, self.owner, self.limit = [], [], []
        langs_ = np.array(langs)
        near: list[np.ndarray] = []
        for i, lang in enumerate(self.langs):
            own = x[langs_ == lang]
            own = own[np.linalg.norm(own, axis=1) > 0]
            for c, cos in self._cluster(own, k):
                self.centroids.append(c)
                self.owner.append(i)
                near.append(cos)
        every = np.concatenate(near) if near else np.zeros(0)
        for i in self.owner:
            own = np.concatenate([cos for j, cos in zip(self.owner, near, strict=True) if j == i])
            own = own if len(own) * REJECT_QUANTILE >= 2 else every
            self.limit.append(float(np.quantile(own, REJECT_QUANTILE)) - 1e-6 if len(own) > 1 else 0.0)
        self.centroids = np.array(self.centroids).reshape(len(self.owner), len(self.codes))
        self.owner, self.limit = np.array(self.owner, int), np.array(self.limit)

    @staticmethod
    def _cluster(x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Centroids of spherical k-means and the cosines of their texts. It begins at the text nearest to the mean and then always at the
        farthest one but for as many as a cluster needs at least; clusters that get too small are dissolved."""
        if not len(x):
            return []
        least = max(2, int(np.ceil(LEAST_SHARE * len(x))))
        c = [x[int((x @ x.mean(0)).argmax())]]
        while len(c) < k and len(x) >= least * (len(c) + 1):
            c.append(x[int(np.argsort((x @ np.array(c).T).max(1), kind="stable")[least - 1])])
        c = np.array(c)
        while True:
            for _ in range(10):
                own = (x @ c.T).argmax(1)
                c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
                c /= np.linalg.norm(c, axis=1, keepdims=True)
            size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
            if len(c) == 1 or size.min() >= least:
                break
            c = np.delete(c, size.argmin(), 0)
        own = (x @ c.T).argmax(1)
        return [(c[j], Model._cosines(x[own == j])) for j in range(len(c))]

    @staticmethod
    def _cosines(x: np.ndarray) -> np.ndarray:
        """The cosines of a cluster's texts with the mean of the others."""
        rest = x.sum(0) - x
        norm = np.linalg.norm(rest, axis=1)
        return (x * rest).sum(1) / np.where(norm > 0, norm, 1)

    @staticmethod
    def bytes_of(text: str) -> bytes:
        return b" " + text.encode().translate(_LETTERS) + b" "

    def prepare(self) -> None:
        """The table from code to place in the vocabulary, made in each task."""
        self.place = np.full(_CODES, -1, np.int16)
        self.place[self.codes] = np.arange(len(self.codes))

    def vectors(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Normalised vectors of the texts in order, in slices of bounded bytes, with the slice's places."""
        if not hasattr(self, "place"):
            self.prepare()
        n = len(self.codes)
        at = 0
        while at < len(texts):
            rows, held = [], 0
            while at < len(texts) and (not rows or (held < _BATCH_BYTES and len(rows) < 256)):
                rows.append(at)
                held += len(texts[at])
                at += 1
            count = np.zeros((len(rows), n), np.float32)
            for j, i in enumerate(rows):
                raw = self.bytes_of(texts[i])
                for a in range(0, len(raw), _BATCH_BYTES):  # overlaps by two bytes; grams that begin there count once
                    part = grams(raw[a : a + _BATCH_BYTES + 2])
                    for size, g in enumerate(part, 1):
                        g = g if a + _BATCH_BYTES + 2 >= len(raw) else g[:_BATCH_BYTES]
                        p = self.place[g]
                        count[j] += np.bincount(p[p >= 0], minlength=n)
            v = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * self.idf.astype(np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield v / np.where(norm > 0, norm, 1), rows

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and rejection of each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        own = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.langs or not len(self.centroids):
            return out
        for v, rows in self.vectors([texts[i] for i in own]):
            cos = v @ self.centroids.T
            best = cos.argmax(1)
            for j, r in enumerate(rows):
                c = best[j]
                limit = self.limit[c] / (2 if len(texts[own[r]]) < SHORT else 1)
                score = float(min(1.0, max(0.0, cos[j, c])))
                out[own[r]] = (self.langs[self.owner[c]], score, bool(score < limit or score == 0.0))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, texts: int = SAMPLE_TEXTS) -> Model:
    """Fit on a bounded sample: first the sampled ids, from narrow columns, then their texts, by a broadcast join with those
    at most texts ids (one a language at least)."""
    rows = keyed(docs, k=id_col, t=text_col, g=lang_col).filter("k is not null and g is not null")
    rows = rows.filter(F.length("t").between(1, FIT_CHARS) & F.col("t").rlike(r"\p{L}"))
    ids = hash_sample(rows.select("g", "k", F.length("t").alias("n")), "g", "k", per_language, texts, SAMPLE_CHARS)
    if not ids:
        return Model([], [])
    kinds = dict(rows.dtypes)
    chosen = docs.sparkSession.createDataFrame(ids, f"g {kinds['g']}, k {kinds['k']}")
    got = rows.join(F.broadcast(chosen), ["k", "g"]).groupBy("k", "g").agg(F.min("t").alias("t")).collect()
    got.sort(key=lambda r: (str(r["k"]), r["g"], r["t"]))
    got = [r for r in got if has_letter(r["t"])]
    return Model([r["t"] for r in got], [r["g"] for r in got])


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """id_col, the columns in keep, and after prefix lang_pred, score and rejected of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few MB at most, by the model's bounds

    def prepare():
        own = shared.value
        if own.langs:
            own.prepare()

        def work(texts):
            got = own.predict(texts)
            return [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

        return work

    return append_columns(df, [id_col, *keep], text_col, "lang_pred string, score double, rejected boolean", prepare, prefix)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.filter(crc_mod("doc_id", 5) != 0))
    out = identify(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
