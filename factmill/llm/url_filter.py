"""URL filters over a sorted digest array.

Entries are a host and a path prefix, with a verdict; an entry is either a rule or an item of the block list. The 64-bit
xxhash keys of all entries, sorted, the offsets of their full strings and the strings themselves are files that every task
maps into memory. Rules and items of the block list are told apart in the strings, so neither hides the other. A URL's candidates are its host's suffixes of label counts that occur among the entries, each with the
path's prefixes of lengths that occur; their hashes are looked up for a whole batch by binary search, and a hit counts
only if the stored string equals the candidate, so colliding hashes do no harm. The longest fitting rule decides; without
one the block list does (block if an item fits, else allow).

An array holds at most SHARD_ENTRIES entries; longer lists make several arrays, which are probed one after another. They
are mapped, not loaded, so their size is bounded by disk and not by memory. They lie in the shared folder, whence tasks map
them; where that is no mounted folder, Spark fetches them to the executors.

Defined results: a null URL or one without :// has an empty host and path, fits no entry and is allowed; repeated rows
give repeated results; of equally long rules the one with the longer host decides, and of equal ones of unlike verdicts
the one that blocks; other columns are left out.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from factmill.llm.common import file_system, keyed, map_batches, read, shared_path

SHARD_ENTRIES = 4_000_000


@dataclass(frozen=True)
class Entry:
    host: str
    path: str
    verdict: str
    rule: bool = True


# The rules of the contract.
RULES = (
    Entry("com", "/", "allow"),
    Entry("example.com", "/en/", "block"),
    Entry("www.example.com", "/en/", "allow"),
    Entry("net", "/es/", "block"),
    Entry("net", "/fr/", "block"),
)
#: The method's own list, for URLs that no rule fits; names that are reserved for such uses.
BLOCK_LIST = (Entry("invalid", "", "block", False), Entry("test", "", "block", False), Entry("localhost", "", "block", False))

_LOWER = {c: c + 32 for c in range(65, 91)}


def host_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_VERDICTS = ("allow", "block")


def build(entries: Iterable[Entry], folder: str, shard_entries: int = SHARD_ENTRIES) -> list[str]:
    """Write entries as arrays in a folder; returns their paths. Entries come one by one and at most a shard is held."""
    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    paths: list[str] = []
    held: dict[bytes, int] = {}
    shapes: set[tuple[int, int, int]] = set()

    def flush() -> None:
        order = sorted(held, key=xxhash.xxh3_64_intdigest)
        out = io.BytesIO()
        for x in (
            np.array([len(order), len(shapes)], "<u8"),
            np.array(sorted(shapes), "<u8").reshape(-1),
            np.array([xxhash.xxh3_64_intdigest(s) for s in order], "<u8"),
            np.cumsum([0, *map(len, order)]).astype("<u8"),
            np.array([held[s] for s in order], np.uint8),
        ):
            out.write(x.tobytes())
        out.write(b"".join(order))
        paths.append(f"{folder}/urls-{uuid.uuid4().hex}.bin")
        with system.open_output_stream(f"{base}/{paths[-1].rpartition('/')[2]}", compression=None) as f:
            f.write(out.getbuffer())
        held.clear()
        shapes.clear()

    for e in entries:
        s = key(e.rule, e.host, e.path)
        held[s] = max(held.get(s, 0), _VERDICTS.index(e.verdict))
        shapes.add((int(e.rule), e.host.count(".") + 1, len(e.path)))
        if len(held) >= shard_entries:
            flush()
    if held:
        flush()
    return paths


def key(rule: int, host: str, path: str) -> bytes:
    """The string of an entry: its kind, host and path."""
    return f"{'r' if rule else 'b'}{host}/\0{path}".encode()


class DigestArray:
    """A mapped array of entries."""

    def __init__(self, path: str):
        n, shapes = (int(x) for x in np.fromfile(path, "<u8", 2))
        at = 16
        self.shapes = [tuple(map(int, x)) for x in np.fromfile(path, "<u8", 3 * shapes, offset=at).reshape(-1, 3)]
        at += 24 * shapes
        self.keys = np.memmap(path, "<u8", "r", at, (n,))
        self.ends = np.memmap(path, "<u8", "r", at + 8 * n, (n + 1,))
        self.codes = np.memmap(path, np.uint8, "r", at + 16 * n + 8, (n,))
        self.text = np.memmap(path, np.uint8, "r", at + 17 * n + 8)

    def find(self, candidates: list[bytes], digest=xxhash.xxh3_64_intdigest) -> np.ndarray:
        """The code of each candidate, or -1."""
        probe = np.fromiter(map(digest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, probe)
        out = np.full(len(candidates), -1)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == probe)).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == probe[i]:  # all entries of this digest
                if self.text[int(self.ends[j]) : int(self.ends[j + 1])].tobytes() == candidates[i]:
                    out[i] = self.codes[j]
                    break
                j += 1
        return out


def judge(urls: list[str | None], arrays: list[DigestArray]) -> list[tuple[str, str, str | None, str]]:
    """Host, path, deciding rule (host and path prefix; null without one) and verdict of each URL."""
    parts = [host_path(u) for u in urls]
    rules: list[tuple[int, int, str, int] | None] = [None] * len(urls)
    blocked = [False] * len(urls)
    for array in arrays:
        candidates, places = [], []
        for i, (host, path) in enumerate(parts):
            if not host:
                continue
            suffixes: dict[int, str | None] = {}
            for rule, labels, size in array.shapes:
                if labels not in suffixes:
                    cut = host.rsplit(".", labels)
                    suffixes[labels] = host if len(cut) == labels else ".".join(cut[1:]) if len(cut) > labels else None
                if suffixes[labels] is not None and size <= len(path):
                    candidates.append(key(rule, suffixes[labels], path[:size]))
                    places.append((i, rule, suffixes[labels], path[:size]))
        codes = array.find(candidates) if candidates else []
        for (i, rule, h, p), code in zip(places, codes, strict=True):
            if code >= 0 and rule:
                rules[i] = max(rules[i] or (-1,), (len(h) + len(p), len(h), h + p, int(code)))
            elif code == 1:
                blocked[i] = True
    return [(h, p, r[2] if r else None, _VERDICTS[r[3] if r else int(b)]) for (h, p), r, b in zip(parts, rules, blocked, strict=True)]


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[Entry] = RULES, block_list: Iterable[Entry] = BLOCK_LIST, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """id_col, host, path, rule and verdict of every row."""
    spark = df.sparkSession

    def entries():
        yield from rules
        yield from block_list

    paths = build(entries(), shared_path(spark, "urls"), shard_entries)
    mounted = all(re.match(r"file:/|/", p) for p in paths)
    if not mounted:
        for p in paths:
            spark.sparkContext.addFile(p)

    def prepare():
        arrays = [DigestArray(file_system(p)[1] if mounted else SparkFiles.get(p.rpartition("/")[2])) for p in paths]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = judge(batch.column("u").to_pylist(), arrays)
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            return pa.RecordBatch.from_arrays([batch.column("k"), *columns], ["k", "host", "path", "rule", "verdict"])

        return step

    kind = dict(df.dtypes)[id_col]
    return map_batches(keyed(df, k=id_col, u=url_col), f"k {kind}, host string, path string, rule string, verdict string", prepare).withColumnRenamed("k", id_col)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return filter_urls(read(spark, sf_dir, "pages"))


#: The same by a join with the entries.
OP6_SQL = """
WITH e(host, path, verdict, is_rule) AS (VALUES
  ('com', '/', 'allow', true), ('example.com', '/en/', 'block', true), ('www.example.com', '/en/', 'allow', true),
  ('net', '/es/', 'block', true), ('net', '/fr/', 'block', true), ('invalid', '', 'block', false), ('test', '', 'block', false), ('localhost', '', 'block', false)
), p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*', 0) ELSE '' END AS r FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN instr(r, '/') > 0 THEN substr(r, instr(r, '/')) ELSE '' END AS path
  FROM p
), f AS (
  SELECT s.page_id, s.host, s.path, e.host || e.path AS rule, e.verdict, e.is_rule,
         row_number() OVER (PARTITION BY s.page_id ORDER BY e.is_rule DESC NULLS LAST, length(e.host || e.path) DESC, length(e.host) DESC) AS n
  FROM s LEFT JOIN e ON (s.host = e.host OR ends_with(s.host, '.' || e.host)) AND starts_with(s.path, e.path)
)
SELECT page_id, host, path, CASE WHEN is_rule THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
