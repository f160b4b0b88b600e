"""Token ids of documents in files of Simple-8b words.

Documents are ranged by id over the tasks, encoded there and written, one
file a task. A file is the magic ``TS8B`` and a row of segments; a segment is

    number of ids, words, blocks and documents          4 int64
    Simple-8b words                                     uint64 each
    word at which each block of 256 ids begins          int64 each
    document ids, their null marks, ids of each         int64, uint8, int64

all little-endian, so that a reader can map the arrays and unpack any block
alone. What a task holds is one segment, about 4 MB of text. File names are
reported in a small table with what each holds; the ids before a file are the
running sum over that table."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import new_file, scratch, shared_files, slices, stored

MAGIC = b"TS8B"
#: Bytes of text in a segment, about.
SEGMENT = 4 << 20
#: Distinct chunks that a task keeps at a time.
KEEP = 400_000
#: New chunks that are encoded side by side.
JOINED = 5_000
MANIFEST = "part int, file string, n_docs long, n_ids long"


def tokenizer_path(path: str | None) -> str:
    """``path``, or the public byte-level vocabulary by default; resolved where it is read."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


class BatchEncoder:
    """Ids of texts, by the tokenizers library.

    The byte-level split never joins a space to what stands before it, unless
    that is white space. So if a text has no space beside other white space,
    its ids are those of its chunks (a space and what follows), and each
    distinct chunk of a batch is encoded once. New chunks are encoded side by
    side as one text, whose ids the bytes of each token part again; those met
    twice in a batch are kept. Texts with a hard chunk (white space at an end,
    an added token's string) and other kinds of tokenizer are encoded whole.

    A Python worker keeps its encoder from task to task (``encoder``), since
    the next task meets the same frequent chunks."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.by_chunk = (split.get("type") == "ByteLevel" and split.get("use_regex", True)
                         and not split.get("add_prefix_space") and spec["normalizer"] is None
                         and not any(" " in a for a in self.added))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)  # bytes of a token: a letter each
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many each has, of chunks, which are not hard, with a space before them."""
        blocks = [chunks.slice(k, JOINED) for k in range(0, len(chunks), JOINED)]
        flat, size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for block, ids in zip(blocks, self.plain([f" {' '.join(strings(b))}" for b in blocks]), strict=True):
            ids = np.array(ids, np.int32)
            ends = np.cumsum(pc.binary_length(block).to_numpy() + 1, dtype=np.int64)
            reached = np.cumsum(self.width[ids])
            to = np.searchsorted(reached, ends) + 1
            if len(ids) != to[-1] or (reached[to - 1] != ends).any():
                own = self.plain([f" {c}" for c in strings(block)])  # it joined chunks that a space parts: each by itself
                flat += [np.array(i, np.int32) for i in own]
                size.append(np.fromiter(map(len, own), np.int64, len(own)))
                continue
            flat.append(ids)
            size.append(np.diff(to, prepend=0))
        return np.concatenate(flat), np.concatenate(size)

    def hard(self, chunks: pa.Array) -> np.ndarray:
        """Which chunks, without their space, are empty, have white space at an end or an added token's string."""
        hard = pc.or_(pc.equal(chunks, ""), pc.not_equal(pc.utf8_trim_whitespace(chunks), chunks))
        for added in self.added:
            hard = pc.or_(hard, pc.match_substring(chunks, added))
        return hard.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text, a null being an empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(texts) or not self.by_chunk:
            return [np.array(i, np.int32) for i in self.plain(texts.to_pylist())]
        if len(self.known) > KEEP:
            self.clear()
        split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy()[:-1].astype(np.int64) - split.offsets[0].as_py()
        pieces = split.flatten()
        first, coded = pieces.take(pa.array(starts)), pieces.dictionary_encode()
        # distinct chunks, which stand behind a space; then the texts' first chunks, which do not
        inner, n_inner = strings(coded.dictionary), len(coded.dictionary)
        chunks = inner + strings(first)
        code = coded.indices.to_numpy().astype(np.int64)
        code[starts] = n_inner + np.arange(len(first))
        # where each chunk's ids are: among the known ones, which are not hard, or behind them
        at = np.full(len(chunks), -1, np.int64)
        at[:n_inner] = np.fromiter(map(self.known.get, inner, repeat(-1)), np.int64, n_inner)
        new = np.flatnonzero(at[:n_inner] < 0)
        hard = np.zeros(len(chunks), bool)
        hard[new], hard[n_inner:] = self.hard(coded.dictionary.take(pa.array(new))), self.hard(first)
        easy = ~hard & (np.arange(len(chunks)) < n_inner)
        side, alone = np.flatnonzero((at < 0) & easy), np.flatnonzero((at < 0) & ~easy)
        flat, size = self.joined(coded.dictionary.take(pa.array(side)))
        own = self.plain([f" {chunks[k]}" if k < n_inner else chunks[k] for k in alone.tolist()])
        n = len(self.size)
        at[side], at[alone] = n + np.arange(len(side)), n + len(side) + np.arange(len(alone))
        ids = np.concatenate([self.flat, flat, *(np.array(i, np.int32) for i in own)])
        sizes = np.concatenate([self.size, size, np.fromiter(map(len, own), np.int64, len(own))])
        index = at[code]
        ends = np.cumsum(np.add.reduceat(sizes[index], starts))
        out = np.split(gather(ids, sizes, index), ends[:-1])
        several = np.diff(np.append(starts, len(index))) > 1
        whole = np.flatnonzero(several & np.logical_or.reduceat(hard[code], starts))
        for k, theirs in zip(whole, self.plain(texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[k] = np.array(theirs, np.int32)
        # keep the new chunks that the batch has twice
        twice = np.bincount(code, minlength=len(chunks))[side] > 1
        self.known.update((inner[k], n + j) for j, k in enumerate(side[twice].tolist()))
        self.flat = np.concatenate([self.flat, flat[np.repeat(twice, size)]])
        self.size = np.concatenate([self.size, size[twice]])
        return out


def strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, which makes a scalar of each value first."""
    return column.to_numpy(zero_copy_only=False).tolist()


def gather(flat: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs of ``flat``, of ``size`` each, at ``index``, one after the other."""
    start, size = (np.cumsum(size) - size)[index], size[index]
    shift = np.repeat(start - np.cumsum(size) + size, size)
    return flat[shift + np.arange(len(shift))]


@lru_cache(maxsize=1)
def encoder(path: str | None) -> BatchEncoder:
    return BatchEncoder(path)


def write_segment(out, ids: list[np.ndarray], doc_ids: list[int | None]) -> int:
    """Append a segment; the number of ids in it."""
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    words, starts = simple8b.pack(flat)
    out.write(np.array([len(flat), len(words), len(starts), len(ids)], "<i8").tobytes())
    out.write(words.astype("<u8").tobytes())
    out.write(starts.astype("<i8").tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.write(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(np.array([len(i) for i in ids], "<i8").tobytes())
    return len(flat)


def read_segments(f) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(document ids, ids of each, all ids) of every segment of an open file."""
    def take(kind: str, n: int) -> np.ndarray:
        data = f.read(np.dtype(kind).itemsize * n)
        if len(data) < np.dtype(kind).itemsize * n:
            raise ValueError("the file ends within a segment")
        return np.frombuffer(data, kind)
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    while head := f.read(32):
        if len(head) < 32:
            raise ValueError("the file ends within a segment")
        n, words, blocks, docs = np.frombuffer(head, "<i8").tolist()
        words, starts = take("<u8", words), take("<i8", blocks)
        doc_ids, null, sizes = take("<i8", docs), take("u1", docs), take("<i8", docs)
        yield [None if z else d for d, z in zip(doc_ids.tolist(), null, strict=True)], sizes, simple8b.unpack(words, starts, n)


def write_tokens(docs: DataFrame, folder: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None) -> DataFrame:
    """Write the ids of all texts to ``folder`` in ascending order of ``id_col``
    (an integer; null first, equal ids by a hash of the text), each document's
    with ``end_id`` behind them. Returns the files: part, file, n_docs, n_ids,
    and ``start``, the ids in the files before.

    A null or empty text has only the end id. Other columns are not read. No
    documents give no file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def run(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part, n_docs, n_ids = TaskContext.get().partitionId(), 0, 0
        end = np.array([] if end_id is None else [end_id], np.int32)
        with new_file(folder, f"part-{part:05}.ts8b") as (out, name):
            out.write(MAGIC)
            for batch in slices(_chain(first, batches), most=SEGMENT):
                ids = [np.concatenate([i, end]) for i in encoder(path).encode(batch["text"])]
                n_ids += write_segment(out, ids, batch["id"].to_pylist())
                n_docs += batch.num_rows
        yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "n_docs": n_docs, "n_ids": n_ids}],
                                         schema=pa.schema([("part", pa.int32()), ("file", pa.string()),
                                                           ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
    files = stored(rows.mapInArrow(run, MANIFEST), "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _chain(first, rest):
    yield first
    yield from rest


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the files that ``write_tokens`` returned: ``doc_id``,
    ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``
    and, ``with_ids``, the ``ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for file, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
                folder, _, name = file.rpartition("/")
                system, path = shared_files(folder)
                with system.open_input_stream(f"{path}/{name}") as f:
                    for doc_ids, sizes, ids in read_segments(f):
                        at = np.concatenate([[0], np.cumsum(sizes)])
                        raw = ids.astype("<u4")
                        view, byte = memoryview(raw).cast("B"), (4 * at).tolist()
                        crc = [zlib.crc32(view[a:b]) for a, b in zip(byte[:-1], byte[1:], strict=True)]
                        columns = [pa.array(doc_ids, pa.int64()), pa.array(start + at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64))))
                            names.append("ids")
                        start += int(at[-1])
                        yield pa.RecordBatch.from_arrays(columns, names=names)
    n = max(1, files.count())
    return files.select("file", "start").repartition(n).mapInArrow(run, schema)


def tokenize_to_files(docs: DataFrame, end_id: int | None, **kw) -> DataFrame:
    """Write the ids into a new folder under ``spark.checkpoint.dir`` and read the documents back from it."""
    return read_tokens(write_tokens(docs, scratch(docs.sparkSession, "tokens"), end_id, **kw))
