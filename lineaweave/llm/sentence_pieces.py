"""SentencePiece models run by the tokenizers library.

The model file is parsed and rebuilt: normaliser, marker for spaces, unigram
scores or merges in score order, byte fallback and decoder. Texts are encoded
in multithreaded batches of distinct chunks: if no piece has the marker after
another character, no token crosses from a word into the next marker, so a
text's ids are those of its chunks (a run of markers and what follows it).
Every chunk's ids are held against the sentencepiece library's own, and the
decoded text against the given one.

A piece has the marker at its start only, so merges or best paths of a whole
text never cross from one chunk into the next: chunks that agree make texts that
agree. The library's threads are as many as Spark gives a task
(``spark.task.cpus``)."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import ChunkTable, ragged, slices

MARK = "▁"
#: Distinct chunks that a task keeps at a time.
KEEP = 60_000
# kinds of model and of piece, fixed by the format
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path(path: str | None) -> str:
    """``path``, or the public model by default; resolved where it is read."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at
    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, kind), kind of model, byte fallback, unknown id and the normaliser's settings."""
    out = {"pieces": [], "kind": _UNIGRAM, "byte_fallback": False, "unk_id": 0, "charsmap": b"",
           "dummy_prefix": True, "extra_spaces": True, "escape": True}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
            out["pieces"].append((own.get(1, b"").decode(), score, own.get(3, _NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            out |= {"kind": own.get(3, _UNIGRAM), "byte_fallback": bool(own.get(35, 0)), "unk_id": own.get(40, 0)}
        elif number == 3:
            own = dict(_fields(value))
            out |= {"charsmap": own.get(2, b""), "dummy_prefix": bool(own.get(3, 1)),
                    "extra_spaces": bool(own.get(4, 1)), "escape": bool(own.get(5, 1))}
    return out


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best piece first."""
    ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (_NORMAL, _USER)}
    found = [(-pieces[k][1], k, ids[p[:cut]], ids[p[cut:]], p[:cut], p[cut:])
             for p, k in ids.items() for cut in range(1, len(p)) if p[:cut] in ids and p[cut:] in ids]
    return [x[4:] for x in sorted(found)]


def rebuild(data: bytes, whole: bool = True):
    """A ``tokenizers.Tokenizer`` of a model file's bytes. With ``whole`` it takes texts, else normalised chunks."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    m = parse_model(data)
    pieces, unknown = m["pieces"], m["pieces"][m["unk_id"]][0]
    if m["kind"] == _UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in pieces], m["unk_id"], m["byte_fallback"])
    elif m["kind"] == _BPE:
        model = models.BPE({p: k for k, (p, _, _) in enumerate(pieces)}, merges_of(pieces), unk_token=unknown,
                           fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        raise ValueError(f"model kind {m['kind']} is neither unigram nor BPE")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["extra_spaces"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    if whole:
        t.normalizer = normalizers.Sequence(steps)
        if splits_at_marker(m):
            t.pre_tokenizer = pre_tokenizers.Split(Regex(_CHUNK.pattern), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
                                   *([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else [])])
    return t


def splits_at_marker(m: dict) -> bool:
    """Whether no piece has the marker after another character, so that chunks can be encoded one by one."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in m["pieces"] if kind in (_NORMAL, _USER))


def task_threads() -> int:
    """Cores that Spark gives each task; one outside of a task."""
    context = TaskContext.get()
    return max(1, context.cpus()) if context is not None else 1


class PieceEncoder:
    """Encodes and decodes texts through a bounded table of chunks.

    ``encode`` gives, for each text, ids, whether the sentencepiece library
    agrees on every chunk, and the text decoded again."""

    def __init__(self, path: str | None = None, threads: int | None = None, keep: int = KEEP):
        threads = threads or task_threads()
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        with open(model_path(path), "rb") as f:
            data = f.read()
        self.parsed, self.threads, self.keep = parse_model(data), threads, keep
        self.by_chunk = (splits_at_marker(self.parsed) and self.parsed["dummy_prefix"]
                         and not self.parsed["charsmap"] and not self.parsed["extra_spaces"])
        self.tokenizer = rebuild(data, not self.by_chunk)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.clear()

    def clear(self) -> None:
        self.at = ChunkTable()
        self.text: list[str] = []
        self.same = np.zeros(0, bool)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; a model that cannot be split has the text as its one chunk."""
        if not text:
            return []
        return _CHUNK.findall(MARK + text.replace(" ", MARK)) if self.by_chunk else [text]

    def learn(self) -> None:
        """Encode, check and decode the chunks that the table has just met."""
        new = self.at.new
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        plain = [c[1:].replace(MARK, " ") for c in new] if self.by_chunk else new
        theirs = self.own.encode(plain, num_threads=self.threads)
        if self.by_chunk and MARK in new:  # its plain text is empty, for which the library adds no marker
            theirs[new.index(MARK)] = [self.own.piece_to_id(MARK)]
        back = self.tokenizer.decode_batch(got, skip_special_tokens=False)
        self.same = np.concatenate([self.same, np.array([a == b for a, b in zip(got, theirs, strict=True)], bool)])
        # the decoder takes the prefix off; inside a text it is a space
        self.text += [" " + t for t in back] if self.by_chunk else back
        self.at.add(got)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, str]]:
        if len(self.at) > self.keep:
            self.clear()
        index = [np.array([self.at[c] for c in self.chunks(t or "")], np.int64) for t in texts]
        if self.at.new:
            self.learn()
        out = []
        for k in index:
            text = "".join([self.text[i] for i in k.tolist()])
            out.append((self.at.gather(k), bool(self.same[k].all()), text[1:] if self.by_chunk else text))
        return out


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                     threads: int | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_tokens``, ``ids_crc32``
    (of the ids as little-endian unsigned 32-bit integers), ``parity`` (the
    sentencepiece library gives the same ids), ``round_trip`` (the ids decode
    to the text) and, ``with_ids``, the ``ids``.

    A null or empty text has no ids. Rows are independent of each other;
    other columns are not read."""
    given = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = (f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_crc32 long, parity boolean, "
              "round_trip boolean" + (", ids array<int>" if with_ids else ""))

    def run(batches):
        encoder = PieceEncoder(path, threads)
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            got = encoder.encode(texts)
            columns = [batch["id"], pa.array([len(g[0]) for g in got], pa.int64()),
                       pa.array([zlib.crc32(g[0].astype("<u4").tobytes()) for g in got], pa.int64()),
                       pa.array([g[1] for g in got]),
                       pa.array([g[2] == (t or "") for g, t in zip(got, texts, strict=True)])]
            names = ["id", "n_tokens", "ids_crc32", "parity", "round_trip"]
            if with_ids:
                columns, names = [*columns, ragged([g[0] for g in got], pa.int32())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None,
                     threads: int | None = None) -> DataFrame:
    """``id_col`` and the ``text`` of each row's ids; null ids give an empty text."""
    given = tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids"))

    def run(batches):
        encoder = PieceEncoder(path, threads)
        for batch in batches:
            back = encoder.tokenizer.decode_batch([x or [] for x in batch["ids"].to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(back, pa.string())], names=["id", "text"])
    schema = f"id {tokens.schema[id_col].dataType.simpleString()}, text string"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
