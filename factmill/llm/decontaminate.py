"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item becomes windows of 13 consecutive words (an item of fewer words is one window). Windows of like
length form a pattern set. A set has a shift table, from the hash of a block of two words to how far the search may move
when that block ends at the current place, and buckets from the hash of the last block to the windows that end with it;
windows of a bucket are told apart by direct comparison of all their words. Texts of a batch are put in a row, cut into
lanes that overlap by one window, and all lanes move at once: each step looks up one shift per lane, so positions are
skipped just as in the scalar search, and only lanes whose shift is 0 compare words. Windows of one word have a table of
their own words.

Tasks over the benchmark write the tables, as packed arrays of at most MOST_WINDOWS windows each, to the shared folder;
nothing of it passes through the driver but their names. A larger benchmark makes several tables. Every batch of texts is
searched with one after another, and its hits are united in the batch, so no pass needs a join; a worker holds at most
HELD tables and, if there are more, loads each again for every batch.

Defined results: a null, empty or blank text has no words and no hits; an empty benchmark hits nothing; items without
words are left out; repeated items count as one item_id; an item without an id marks words but is not listed; repeated
documents stay rows, each with its own hits; other columns are left out.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import append_columns, bound_batches, file_system, read, shared_path

WINDOW = 13
#: Windows in one table: at most 13 * 4 bytes of words and 160 of shifts and buckets for each, and its items.
MOST_WINDOWS = 500_000
#: Tables that a worker keeps in memory.
HELD = 4
LANE = 512
_EMPTY = np.zeros(0, np.int64)

# Words are runs of digits, letters a-z and everything beyond ASCII; A-Z are lower-cased, all other bytes part words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every window of an item; the whole item if it is shorter; nothing without words."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class PatternSet:
    """Windows of one length as rows of word numbers, with their shift table and suffix buckets."""

    def __init__(self, rows: np.ndarray, shift: np.ndarray | None = None, starts: np.ndarray | None = None):
        self.m = m = rows.shape[1]
        self.block = min(2, m)
        if shift is not None:
            self.rows, self.shift, self.starts = rows, shift, starts
            self.bits = len(shift).bit_length() - 1
            return
        self.bits = max(12, int(2 * len(rows) * m).bit_length())
        default = m - self.block + 1
        self.shift = np.full(1 << self.bits, default, np.int8 if m < 128 else np.int32)
        for end in range(self.block - 1, m):
            at = self.hash(rows[:, end - 1] if self.block == 2 else rows[:, end], rows[:, end])
            np.minimum.at(self.shift, at, m - 1 - end)
        last = self.hash(rows[:, -2] if self.block == 2 else rows[:, -1], rows[:, -1])
        self.order = np.argsort(last, kind="stable")
        self.rows = rows[self.order].astype(np.int32)
        self.starts = np.searchsorted(last[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and rows of all occurrences in x. Number 0 stands between texts and is in no window."""
        m, n = self.m, len(x)
        if n < m:
            return _EMPTY, _EMPTY
        # Lane k ends windows at places from k * LANE to (k + 1) * LANE - 1, so lanes share no end and miss none.
        at = np.arange(0, n, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, n)
        at = np.maximum(at, m - 1)
        live = at < stop
        at, stop = at[live], stop[live]
        starts, found = [], []
        while len(at):
            h = self.hash(x[at - 1] if self.block == 2 else x[at], x[at])
            move = self.shift[h]
            stand = np.flatnonzero(move == 0)
            if len(stand):
                lo, hi = self.starts[h[stand]], self.starts[h[stand] + 1]
                place = at[stand]
                while len(place):
                    place, lo, hi = place[lo < hi], lo[lo < hi], hi[lo < hi]
                    if not len(place):
                        break
                    same = np.ones(len(place), bool)
                    for j in range(m):
                        same &= x[place - m + 1 + j] == self.rows[lo, j]
                    starts.append(place[same] - m + 1)
                    found.append(lo[same])
                    lo = lo + 1
            at = at + np.maximum(move, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not starts:
            return _EMPTY, _EMPTY
        return np.concatenate(starts), np.concatenate(found)


class Patterns:
    """A table: numbers of its words, a pattern set for each window length, and the items of each window."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[int]]):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for w in windows:
            by_length.setdefault(len(w), []).append(w)
            for word in w:
                self.number.setdefault(word, len(self.number) + 1)
        self.sets: list[PatternSet] = []
        self.items: list[tuple[np.ndarray, np.ndarray]] = []
        for group in by_length.values():
            s = PatternSet(np.array([[self.number[word] for word in w] for w in group], np.int64))
            owners = [sorted({i for i in windows[group[r]] if i is not None}) for r in s.order.tolist()]
            self.sets.append(s)
            self.items.append((np.cumsum([0, *map(len, owners)]).astype(np.int64), np.array([i for o in owners for i in o], np.int64)))

    def packed(self) -> bytes:
        """All of it as the bytes of an archive of arrays."""
        words = list(self.number)
        arrays = {"words": np.frombuffer(b" ".join(words), np.uint8)}
        for k, (s, (ends, ids)) in enumerate(zip(self.sets, self.items, strict=True)):
            arrays |= {f"{n}_{k}": x for n, x in (("rows", s.rows), ("shift", s.shift), ("starts", s.starts), ("ends", ends), ("ids", ids))}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Patterns:
        own = cls({})
        with np.load(io.BytesIO(raw)) as z:
            own.number = {w: i + 1 for i, w in enumerate(z["words"].tobytes().split())}
            for k in range((len(z.files) - 1) // 5):
                own.sets.append(PatternSet(z[f"rows_{k}"], z[f"shift_{k}"], z[f"starts_{k}"]))
                own.items.append((z[f"ends_{k}"], z[f"ids_{k}"]))
        return own

    def hits(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """Text, start, end and items of every occurrence of a window in texts of words."""
        get = self.number.get
        gap = np.zeros(1, np.int64)
        x = np.concatenate([y for w in texts for y in (np.fromiter((get(v, -1) for v in w), np.int64, len(w)), gap)] or [gap])
        begin = np.cumsum([0, *(len(w) + 1 for w in texts)])[:-1]
        for s, (ends, ids) in zip(self.sets, self.items, strict=True):
            starts, rows = s.search(x)
            if len(starts):
                text = np.searchsorted(begin, starts, "right") - 1
                for i, a, r in zip(text.tolist(), (starts - begin[text]).tolist(), rows.tolist(), strict=True):
                    yield i, a, a + s.m, ids[ends[r] : ends[r + 1]]


class Searcher:
    """The tables of a benchmark: those given, or loaded from files when they are needed."""

    def __init__(self, tables: Iterable[Patterns | str]):
        self.tables = list(tables)
        self.held: dict[str, Patterns] = {}

    def _table(self, t: Patterns | str) -> Patterns:
        if isinstance(t, Patterns):
            return t
        if (own := self.held.get(t)) is None:
            system, path = file_system(t)
            with system.open_input_file(path) as f:
                own = Patterns.unpacked(f.read())
            if len(self.held) < HELD:
                self.held[t] = own
        return own

    def search(self, texts: list[str | None]) -> list[tuple[int, list[int], list[int], list[int]]]:
        """For each text its number of words, the starts and ends of its hit ranges, and its items."""
        words = [words_of(t) for t in texts]
        ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        for t in self.tables:
            for i, a, b, ids in self._table(t).hits(words):
                ranges[i].append((a, b))
                items[i].update(ids.tolist())
        return [(len(w), *merged(r), sorted(x)) for w, r, x in zip(words, ranges, items, strict=True)]


def merged(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of ranges."""
    starts, ends = [], []
    for a, b in sorted(ranges):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def write_tables(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW, most: int = MOST_WINDOWS) -> list[str]:
    """Write the tables of a benchmark to the shared folder; returns their files. A task that is repeated writes files of
    other names, and only those of tasks that ended well are used."""
    folder = shared_path(benchmark.sparkSession, "windows")
    bound_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        held: dict[tuple[bytes, ...], list[int]] = {}

        def flush() -> pa.RecordBatch:
            system.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(Patterns(held).packed())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        for batch in batches:
            for i, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for w in windows_of(words_of(text), size):
                    held.setdefault(w, []).append(i)
                    if len(held) >= most:
                        yield flush()
        if held:
            yield flush()

    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
    parts = -(-(rows.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0) // (8 * most))  # of eight characters a word
    names = rows.coalesce(max(1, int(parts))).mapInArrow(run, "name string").collect()
    return sorted(f"{folder}/{r['name']}" for r in names)


HITS = "n_words long, starts array<int>, ends array<int>, items array<long>"


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), size: int = WINDOW, most_windows: int = MOST_WINDOWS, prefix: str = "") -> DataFrame:
    """id_col, the columns in keep, and after prefix n_words, the ranges of hit words (starts, ends) and the items that occur."""
    names = write_tables(benchmark, item_id, item_text, size, most_windows)

    def prepare():
        searcher = Searcher(names)

        def work(texts):
            rows = searcher.search(texts)
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return work

    return append_columns(df, dict.fromkeys([id_col, *keep]), text_col, HITS, prepare, prefix)


def verdict(p: str = "") -> tuple[F.Column, F.Column]:
    """n_hit and contaminated of what find() returns after the prefix p."""
    n_hit = F.aggregate(F.zip_with(f"{p}starts", f"{p}ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return n_hit, (n_hit > 0) & (20 * n_hit >= F.col(f"{p}n_words"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in benchmark windows, the items they come from, and whether the document is contaminated."""
    found = find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit, contaminated = verdict()
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated.alias("contaminated")
    )
