"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here (no generated classes); its normaliser, dummy prefix and metaspace marker, its
unigram scores or BPE merges, and its byte fallback are rebuilt as a `tokenizers.Tokenizer`, which encodes batches on
several threads. BPE merges are not in the file: they are every split of a piece into two pieces, ordered by the piece's
score. No piece of a supported model has another character before the marker, so texts are cut before each run of
markers, which changes no segmentation and lets the library cache words.

Words repeat, so a task keeps the ids of the distinct words it has met (bounded: the table is emptied when it is full)
and only new words go through the library. This is for models with a dummy prefix and without a character map in which no
piece has a marker after another character: no merge crosses a word's start, so a text's ids are its words' ids. Others
are encoded text by text.

Parity: every text is also encoded, whole, with the sentencepiece library, and `parity_ok` says whether the ids agree. Every
text's ids are decoded again, as the join of their pieces, and `decoded_ok` says whether that is the text.

Defined results: null and empty texts have no ids and decode to the empty text; a marker character in a text decodes to
a space, as in the model's own library, and `decoded_ok` compares with that; repeated rows are encoded each; a text that
the libraries disagree on keeps its row; an empty table gives no rows; other columns are not read. Models with
user-defined symbols raise ValueError.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints for varints, floats for 32-bit values, bytes otherwise."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            at += size
            yield tag >> 3, data[at - size : at]
        elif kind == 5:
            at += 4
            yield tag >> 3, struct.unpack("<f", data[at - 4 : at])[0]
        elif kind == 1:
            at += 8
            yield tag >> 3, struct.unpack("<d", data[at - 8 : at])[0]
        else:
            raise ValueError(f"protobuf wire type {kind}")


@dataclass
class Model:
    """What a model file holds: pieces (text, score, type), the kind of segmentation and the normaliser's settings."""

    pieces: list[tuple[str, float, int]]
    unigram: bool
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim: bool
    escape: bool

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        kind = trainer.get(3, 1)
        if kind not in (1, 2) or any(t == USER for _, _, t in pieces):
            raise ValueError("only unigram and BPE models without user-defined symbols are supported")
        return cls(pieces, kind == 1, bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))

    def merges(self) -> list[tuple[str, str]]:
        rank = {p: s for p, s, t in self.pieces if t == NORMAL}
        found = []
        for order, (piece, score, kind) in enumerate(self.pieces):
            if kind == NORMAL and len(piece) > 1:
                splits = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
                found += [(-score, order, -max(rank[a], rank[b]), k, (a, b)) for k, (a, b) in enumerate(splits)]
        return [x[-1] for x in sorted(found)]

    def surfaces(self) -> list[bytes]:
        """The bytes that each id stands for in a text, so a decoding is a join and the removal of the dummy prefix."""
        made = {CONTROL: lambda p: b"", UNKNOWN: lambda p: " \u2047 ".encode(), BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        return [made.get(kind, lambda p: p.replace(MARK, " ").encode())(piece) for piece, _, kind in self.pieces]

    def by_words(self) -> bool:
        """Whether a text's ids are those of its words, each with the markers before it, one after the other."""
        cut = not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL)
        return cut and self.dummy_prefix and self.escape and not self.charsmap and not self.trim

    def tokenizer(self, prefix: bool = True):
        """The rebuilt tokenizers.Tokenizer; without prefix, one that adds no dummy prefix."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        if self.unigram:
            made = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unknown, self.byte_fallback))
        else:
            name = None if unknown is None else self.pieces[unknown][0]
            made = Tokenizer(models.BPE({p: k for k, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=name, fuse_unk=True, byte_fallback=self.byte_fallback))
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and prefix:
            steps.append(normalizers.Prepend(MARK if self.escape else " "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        made.normalizer = normalizers.Sequence(steps)
        if not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL):
            made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
        back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        made.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if self.dummy_prefix and prefix else back)
        made.encode_special_tokens = True
        return made


def _expected(model: Model, text: str) -> bytes | None:
    """The text that decoding has to give back, where the normaliser leaves texts as they are."""
    return None if model.charsmap or model.trim else text.replace(MARK, " ").encode()


_SPACED = re.compile(" *[^ ]+| +")


def words_of(text: str) -> list[str]:
    """The words of a text under a dummy prefix, each without one space of the run before it; joined by spaces they are the text."""
    text = text.replace(MARK, " ")
    if "  " in text or text.startswith(" ") or text.endswith(" "):
        return [w[1:] for w in _SPACED.findall(" " + text)]
    return text.split(" ") if text else []


def _flat(lists: list[list[int]], sizes: np.ndarray) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(sizes.sum()))


class _Words(dict):
    """Numbers of words, with the ids of each as a slice of one array; a word that is missing gets a number and waits."""

    def __init__(self, codec, most: int = 500_000, most_chars: int = 1 << 23):
        super().__init__()
        self.codec, self.most, self.most_chars = codec, most, most_chars
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.waiting, self.chars, self.filled = [], 0, 0
        self.ids, self.starts, self.sizes = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.waiting.append(word)
        self.chars += len(word)
        return number

    def _learn(self) -> None:
        found = [e.ids for e in self.codec.encode_batch_fast([" " + w for w in self.waiting], add_special_tokens=False)]
        new = np.fromiter(map(len, found), np.int64, len(found))
        size, first, full = len(self), len(self) - len(found), self.filled + int(new.sum())
        for name, least in (("starts", size), ("sizes", size), ("ids", full)):
            array = getattr(self, name)
            if least > len(array):
                setattr(self, name, np.concatenate((array, np.zeros(max(least - len(array), len(array)), array.dtype))))
        self.starts[first:size], self.sizes[first:size] = self.filled + np.cumsum(new) - new, new
        self.ids[self.filled : full] = _flat(found, new)
        self.filled, self.waiting = full, []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and the number of each text's ids."""
        if len(self) > self.most or self.chars > self.most_chars:
            self.reset()
        cut = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        number = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if self.waiting:
            self._learn()
        sizes = self.sizes[number]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.ids[np.repeat(self.starts[number] - upto[:-1], sizes) + np.arange(upto[-1])]
        last = np.cumsum(counts)
        return flat, upto[last] - upto[last - counts]


class _Texts:
    """The same for models that have to see a text as a whole."""

    def __init__(self, codec):
        self.codec = codec

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.codec.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return _flat(found, sizes), sizes


def _parts(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each (one text at least), which bounds the encodings held."""
    ends, first = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
    while first < batch.num_rows:
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield batch.slice(first, stop - first)
        first = stop


@functools.lru_cache(maxsize=1)
def _load(path: str, threads: int) -> tuple:
    """Model, codec, surfaces and own library of a model file, kept by a Python worker for its later tasks."""
    import sentencepiece

    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    with open(path, "rb") as file:
        data = file.read()
    model = Model.parse(data)
    own = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = _Words(model.tokenizer(prefix=False)) if model.by_words() else _Texts(model.tokenizer())
    return model, codec, model.surfaces(), own


def _codec(path: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codec, surfaces, own = _load(path, threads)
        for whole in batches:
            for batch in _parts(whole):
                texts = batch.column(1).to_pylist()
                flat, sizes = codec.encode(texts)
                ends = np.cumsum(sizes)
                each = [flat[a:b].tolist() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                same = [a == b for a, b in zip(each, own.encode(texts, num_threads=1), strict=True)]
                back = (b"".join([surfaces[i] for i in ids])[model.dummy_prefix :] for ids in each)
                good = [(want := _expected(model, t)) is None or want == b for t, b in zip(texts, back, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), ids, pa.array(good, pa.bool_()), pa.array(same, pa.bool_())], names=["id", "n_tokens", "ids", "decoded_ok", "parity_ok"])

    return run


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2) -> DataFrame:
    """Rows (id, n_tokens, ids, decoded_ok, parity_ok) of every row of df. model_path is a local file on every machine.

    threads: of the library's own pool in a Python worker.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_codec(model_path, threads), f"id {kind}, n_tokens long, ids array<int>, decoded_ok boolean, parity_ok boolean").withColumnRenamed("id", id_col)
