"""SentencePiece encoding and decoding with a distinct-chunk table.

In a model none of whose pieces holds the whitespace mark after another character, no piece can cross from a word into
the mark that follows it. A text is then a row of chunks, each some marks and the word after them, and the pieces of a
chunk depend on nothing else. Each task keeps a table from chunk to packed ids, gives every distinct chunk to the
library once, and joins the ids of a text back by position. A model that breaks the rule is encoded text by text.

Defined results: null and empty texts hold only the begin and end ids and decode to the empty text; repeated rows give
repeated results; an empty table gives an empty result; other columns are left out, so clashing names do no harm.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.common import append_columns, keyed, map_batches, read

MARK = "▁"
_CHUNKS = re.compile(r" *[^ ]+| +")

#: Chunks in a task's table before it is emptied, and characters of a chunk that is worth a place in it.
TABLE_ROWS = 400_000
TABLE_CHUNK = 64


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizer files of this machine are; the executors resolve it themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoding and decoding that give what the library gives, one distinct chunk at a time."""

    def __init__(self, path: str, begin_end: bool = True, table_rows: int = TABLE_ROWS):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table: dict[str, bytes] = {}
        self.table_rows = table_rows
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        # Only with a dummy prefix, and with every space kept, does a text fall into chunks that the library also makes.
        self.by_chunk = (
            all(MARK not in p.lstrip(MARK) for p in pieces)
            and sp.encode("a  b", out_type=str)[:1] == [MARK + "a"]
            and sp.decode(sp.encode("  a b ")) == "  a b "
        )
        self.alone = np.array([sp.piece_to_id(MARK)], "<u4").tobytes()
        self.begin = np.array([sp.bos_id()], "<u4").tobytes() if begin_end and sp.bos_id() >= 0 else b""
        self.end = np.array([sp.eos_id()], "<u4").tobytes() if begin_end and sp.eos_id() >= 0 else b""
        self.plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        self.surface = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() if self.plain[i] else b""
            for i, p in enumerate(pieces)
        ]
        self.unknown = sp.unk_id()
        self.inside = np.array(self.plain)
        self.opens = np.array([p.startswith(MARK) for p in pieces])

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks of a text without their first mark, which the library adds again."""
        if not text:
            return []
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in _CHUNKS.findall(" " + text)]
        return text.split(" ")

    def segment(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct chunks. Those of one mark go to the library in one string and are parted at the marks."""
        made = {}
        single = [c for c in chunks if c and " " not in c]
        for at in range(0, len(single), 2000):
            some = single[at : at + 2000]
            ids = np.array(self.sp.encode(" ".join(some), num_threads=1), "<u4")
            starts = (np.flatnonzero(self.opens[ids]) * 4).tolist()
            if len(starts) != len(some):
                raise ValueError("a piece crosses a whitespace mark")
            raw = ids.tobytes()
            made.update(zip(some, [raw[i:j] for i, j in zip(starts, [*starts[1:], len(raw)], strict=True)], strict=True))
        for c in chunks:
            if c not in made:
                made[c] = np.array(self.sp.encode(c, num_threads=1), "<u4").tobytes() if c else self.alone
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        if not self.by_chunk:
            return [self.begin + np.array(x, "<u4").tobytes() + self.end for x in self.sp.encode(texts, num_threads=1)]
        if len(self.table) > self.table_rows:
            self.table.clear()
        out = []
        for text in texts:
            own = self.chunks(text)
            table = self.table
            new = list({c for c in own if c not in table})
            once = {}
            if new:
                once = self.segment(new)
                table.update((c, once[c]) for c in new if len(c) <= TABLE_CHUNK)
                once = {c: once[c] for c in new if len(c) > TABLE_CHUNK}
            if once:
                body = b"".join([table[c] if c in table else once[c] for c in own])
            else:
                body = b"".join(map(table.__getitem__, own))
            out.append(self.begin + body + self.end)
            if len(table) > 2 * self.table_rows:
                table.clear()
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        """The text of each row of ids, as the library's decode(ids) gives it."""
        out = []
        for row in packed:
            ids = np.frombuffer(row, "<u4")
            text = None
            if self.by_chunk and (not ids.size or ids.max() < len(self.surface)) and not (ids == self.unknown).any():
                inside = np.flatnonzero(self.inside[ids])
                if inside.size and inside[-1] - inside[0] + 1 == inside.size:  # no special id between others
                    body = ids[inside[0] : inside[-1] + 1].tolist()
                    try:
                        text = b"".join(map(self.surface.__getitem__, body)).decode()
                        if self.opens[body[0]]:
                            text = text[1:]
                    except UnicodeDecodeError:
                        text = None  # the library marks every stray byte
            out.append(self.sp.decode(ids.tolist()) if text is None else text)
        return out


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(x) // 4 for x in packed)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, begin_end: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in keep, ids array<int>, and packed binary, the same ids as little-endian unsigned 32-bit integers."""

    def prepare():
        codec = Codec(model or model_path(), begin_end)

        def work(texts):
            packed = codec.encode([t or "" for t in texts])
            return [_lists(packed), pa.array(packed, pa.binary())]

        return work

    return append_columns(df, [id_col, *keep], text_col, "ids array<int>, packed binary", prepare)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """id_col and decoded: the text of each row of ids (null: the empty text)."""

    def prepare():
        codec = Codec(model or model_path())

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.array(x or [], "<u4").tobytes() for x in batch.column("i").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("k"), pa.array(codec.decode(rows), pa.string())], ["k", "decoded"])

        return step

    kind = dict(df.dtypes)[id_col]
    return map_batches(keyed(df, k=id_col, i=ids_col), f"k {kind}, decoded string", prepare).withColumnRenamed("k", id_col)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, keep: tuple[str, ...] = (), lists: bool = False, prefix: str = "") -> DataFrame:
    """Encode and decode in one pass: id_col, the columns in keep, and after prefix packed binary, decoded string; with lists also ids array<int>."""

    def prepare():
        codec = Codec(model or model_path())

        def work(texts):
            packed = codec.encode([t or "" for t in texts])
            out = [pa.array(packed, pa.binary()), pa.array(codec.decode(packed), pa.string())]
            return [*out, _lists(packed)] if lists else out

        return work

    return append_columns(df, [id_col, *keep], text_col, "packed binary, decoded string" + ", ids array<int>" * lists, prepare, prefix)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document, as digests of the operator's own output."""
    out = round_trip(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
