"""LM scoring with a weighted backoff automaton.

Model: words and one end token per text; n-grams up to `order`. Root: add-one unigrams p(w) = (c(w) + 1) / (N + V + 1).
Above it, hierarchical Dirichlet smoothing (MacKay and Peto 1995): p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k) with
k = `prior` and h' the context without its first word; a text's first context is the end token. Compiled to an automaton:
a state per context, an arc per n-gram seen in training weighing log10 p(w | h), and a failure arc to the state of h'
weighing log10(k / (c(h) + k)). A word without an arc follows failure arcs until there is one, which gives the same
formula with c(hw) = 0, so every state is a proper distribution. A text is traversed once from left to right, carrying
the state: after a word it is the n-gram that ends there.

Distribution: counts cover all training texts and are never cut, so the model grows with the input and is never sent
whole to the driver or a task. Texts are dealt to blocks of about `block_bytes` by a hash. (1) Each block sends its
distinct words to buckets; a bucket adds their counts, numbers its words by frequency, and answers each block in the
order in which the block sent them. (2) A block sends its distinct n-grams of each higher order as columns of word
numbers (exact keys; the hash of a key only names its bucket and sorts), and is answered with the totals in that order,
so keys travel once. N-grams with a word that training has not are not sent; their count is 0. (3) A block joins the
answers with its texts, builds the automaton of the n-grams that occur in it, and scores. A frequent n-gram is one entry
per block, so buckets are even.
Sizes: a bucket takes what about two blocks of text send. Up to sqrt(50 x input) bytes a block has `block_bytes`; beyond
(1.4 TB for 8 MB) blocks grow with the square root of the input, 71 MB at 100 TB, so that there are never more buckets than a
hundredth of a block's bytes: a message holds a dozen keys or more on average, the rows shuffled grow in proportion to the
input, and blocks and buckets alike stay small beside a task's memory.

Defined results: a null or empty text is one end token; rows with a null id are in training or held out by the crc of
the empty text; repeated rows each count, and are spread over blocks; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, crc_of_id

END = b""  # no word is empty


@dataclass(frozen=True)
class BackoffAutomaton:
    """States, arcs and failure arcs of the n-grams in a block of texts, as arrays by order (index 0: order 1, the root).

    arcs: weight of the arc that reads each n-gram's last word, NaN where training has no such n-gram; the root has an arc
    for every word. failures: weight of the failure arc of the state that each n-gram is. contexts: the state (n-gram of
    one order less) that each n-gram's arc leaves from.
    """

    arcs: list[np.ndarray]
    failures: list[np.ndarray]
    contexts: list[np.ndarray]

    def score(self, steps: list[np.ndarray], firsts: np.ndarray) -> np.ndarray:
        """Sums of log10 weights of texts laid end to end; firsts: where each text starts.

        steps: by order, the n-gram that ends at each word, -1 where the text is too short before it. A step takes the
        arc of the longest n-gram, or else the failure arc of that n-gram's state and the next shorter one.
        """
        total, open_steps = np.zeros(len(steps[0])), np.arange(len(steps[0]))
        for arcs, failures, contexts, at in zip(self.arcs[:0:-1], self.failures[-2::-1], self.contexts[:0:-1], steps[:0:-1], strict=True):
            gram = at[open_steps]
            there = gram >= 0
            weight = np.where(there, arcs[gram], np.nan) if len(arcs) else np.full(len(gram), np.nan)
            missed = np.isnan(weight)
            back = open_steps[missed & there]
            total[back] += failures[contexts[gram[missed & there]]]
            total[open_steps[~missed]] += weight[~missed]
            open_steps = open_steps[missed]
        total[open_steps] += self.arcs[0][steps[0][open_steps]]
        return np.add.reduceat(total, firsts)


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest needs, byte by byte of all of them, compressed."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    full = np.zeros((size, 8), np.uint8)
    if size:
        full[:, :width] = np.frombuffer(pa.decompress(data[9:], decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8).reshape(width, size).T
    return full.view("<i8").ravel()


def _pack_columns(columns: list[np.ndarray]) -> bytes:
    """Columns of sorted keys: differences of the first, the others as they are."""
    parts = [pack(np.diff(columns[0], prepend=0)), *map(pack, columns[1:])]
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _unpack_columns(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        out.append(unpack(data[at + 4 : at + 4 + size]))
        at += 4 + size
    return [np.cumsum(out[0]), *out[1:]]


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            x = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            out = x ^ (x >> np.uint64(29))
    return out


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """The words of a block of texts: numbers, counts and bucket of each distinct word, and the texts as numbers."""

    def __init__(self, texts: list, training: np.ndarray, buckets: int):
        import xxhash

        ids = _Numbers()
        ids[END]
        cut = [[*(t or b"").lower().split(), END] for t in texts]
        self.sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        self.flat = np.fromiter(map(ids.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(self.sizes.sum()))
        self.firsts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.words = list(ids)
        self.use = np.repeat(training, self.sizes)
        self.counts = np.bincount(self.flat[self.use], minlength=len(ids))
        of = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(ids)) % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        self.of_bucket = np.split(order, np.searchsorted(of[order], np.arange(1, buckets, dtype=np.uint64)))


class _Grams:
    """The distinct n-grams of a block, by order, in the order of their words' global numbers.

    steps, arcs' counts, contexts and suffixes (n-gram without its first word) are lists by order; keys: columns of global
    numbers, -1 for a word that training has not.
    """

    def __init__(self, block: _Block, number: np.ndarray, order: int):
        rank = np.empty(len(number), np.int64)
        self.by_rank = np.argsort(number, kind="stable")
        rank[self.by_rank] = np.arange(len(number))
        word, kinds, here = rank[block.flat], len(number), np.arange(len(block.flat))
        place = here - np.repeat(block.firsts, block.sizes)
        before = np.concatenate(([0], word[:-1]))
        before[block.firsts] = rank[0]  # the end token before a text is its start
        self.steps, self.keys, self.counts = [word], [[number[self.by_rank]]], [block.counts[self.by_rank]]
        self.contexts, self.suffixes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, order + 1):
            fits = place >= n - 2
            context = before if n == 2 else np.concatenate(([0], self.steps[-1][:-1]))
            keys, inverse = np.unique(context[fits] * kinds + word[fits], return_inverse=True)
            step = np.full(len(word), -1, np.int64)
            step[fits] = inverse
            suffix = np.empty(len(keys), np.int64)
            suffix[inverse] = self.steps[-1][fits]
            self.contexts.append(keys // kinds)
            self.suffixes.append(suffix)
            self.counts.append(np.bincount(inverse, weights=block.use[fits], minlength=len(keys)).astype(np.int64))
            self.keys.append([c[keys // kinds] for c in self.keys[-1]] + [self.keys[0][0][keys % kinds]])
            self.steps.append(step)

    def slots(self, n: int, buckets: int) -> list[np.ndarray]:
        """The n-grams of an order to send to each bucket: those whose words are all known."""
        columns = self.keys[n - 1]
        known = np.flatnonzero(np.logical_and.reduce([c >= 0 for c in columns]))
        of = _mix([c[known] for c in columns]) % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        return np.split(known[order], np.searchsorted(of[order], np.arange(1, buckets, dtype=np.uint64)))


_SENT = "block int, slot int, keys binary, counts binary"
_ANSWER = "block int, slot int, totals binary, numbers binary, tokens long, kinds long"


def _block_of(pdf: pd.DataFrame, buckets: int) -> tuple[pd.DataFrame, _Block]:
    pdf = pdf.sort_values(["crc", "size", "text_hash"], kind="stable").reset_index(drop=True)
    return pdf, _Block(pdf["text"].tolist(), ~pdf["held_out"].to_numpy(bool), buckets)


def _send_words(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["block"].iloc[0])
        _, block = _block_of(pdf, buckets)
        rows = [(number, k, b"%d " % len(ids) + b" ".join([block.words[i] for i in ids.tolist()]), pack(block.counts[ids])) for k, ids in enumerate(block.of_bucket)]
        return pd.DataFrame(rows, columns=["block", "slot", "keys", "counts"])

    return run


def _split_words(data: bytes) -> list[bytes]:
    n, _, rest = data.partition(b" ")
    return rest.split(b" ") if int(n) else []


def _add_words(buckets: int):
    """Totals of a bucket's words, and their numbers from the most frequent one on, -1 for words not in training."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, sent = int(pdf["slot"].iloc[0]), [_split_words(x) for x in pdf["keys"]]
        at = _Numbers()
        local = [np.fromiter(map(at.__getitem__, words), np.int64, len(words)) for words in sent]
        flat = np.concatenate(local)
        totals = np.bincount(flat, weights=np.concatenate([unpack(x) for x in pdf["counts"]]), minlength=len(at)).astype(np.int64)
        number = np.empty(len(at), np.int64)
        number[np.argsort(-totals, kind="stable")] = np.arange(len(at)) * buckets + bucket
        number[totals == 0] = -1
        tokens, kinds = int(totals.sum()), int((totals > 0).sum())
        rows = [(block, bucket, pack(totals[x]), pack(number[x] + 1), tokens, kinds) for block, x in zip(pdf["block"], local, strict=True)]
        return pd.DataFrame(rows, columns=["block", "slot", "totals", "numbers", "tokens", "kinds"])

    return run


def _known(block: _Block, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Totals and global numbers of a block's words, and tokens and kinds of the training texts, from its word answers."""
    totals, number = np.zeros(len(block.words), np.int64), np.full(len(block.words), -1, np.int64)
    for slot, of_totals, of_numbers in zip(answers["slot"], answers["totals"], answers["numbers"], strict=True):
        ids = block.of_bucket[slot]
        totals[ids], number[ids] = unpack(of_totals), unpack(of_numbers) - 1
    return totals, number, int(answers["tokens"].sum()), int(answers["kinds"].sum())


def _send_grams(buckets: int, order: int):
    """Slot of bucket b for order n: (n - 1) * buckets + b; the slots below `buckets` are those of the words."""

    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(texts):
            name = int(texts["block"].iloc[0])
            _, block = _block_of(texts, buckets)
            grams = _Grams(block, _known(block, answers)[1], order)
            for n in range(2, order + 1):
                for b, ids in enumerate(grams.slots(n, buckets)):
                    if len(ids):
                        rows.append((name, (n - 1) * buckets + b, _pack_columns([c[ids] for c in grams.keys[n - 1]]), pack(grams.counts[n - 1][ids])))
        return pd.DataFrame(rows, columns=["block", "slot", "keys", "counts"])

    return run


def add_up(columns: list[np.ndarray], counts: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """The sum of the counts of all rows with equal columns, for each row."""
    hashes = _mix(columns) if hashes is None else hashes
    order = np.argsort(hashes, kind="stable")

    def cuts() -> np.ndarray:
        return np.concatenate(([True], np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns])))

    new = cuts()
    if (new[1:] & (np.diff(hashes[order]) == 0)).any():  # different keys with one hash: sort by the keys themselves
        order = np.lexsort(columns[::-1])
        new = cuts()
    starts = np.flatnonzero(new)
    out = np.empty(len(counts), np.int64)
    out[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(starts, append=len(counts)))
    return out


def _add_grams(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's n-grams, answered to each block in the order of its own keys."""
    sent = [_unpack_columns(x) for x in pdf["keys"]]
    totals = add_up([np.concatenate(c) for c in zip(*sent, strict=True)], np.concatenate([unpack(x) for x in pdf["counts"]]))
    ends = np.cumsum([len(x[0]) for x in sent])
    rows = [(block, slot, pack(totals[b - len(x[0]) : b]), None, None, None) for block, slot, x, b in zip(pdf["block"], pdf["slot"], sent, ends, strict=True)]
    return pd.DataFrame(rows, columns=["block", "slot", "totals", "numbers", "tokens", "kinds"]).astype({"tokens": "Int64", "kinds": "Int64"})


def build(grams: _Grams, totals: list[np.ndarray], tokens: int, kinds: int, prior: float) -> BackoffAutomaton:
    """The automaton of the n-grams in a block from their training totals, by order."""
    p = (totals[0] + 1) / (tokens + kinds + 1)
    arcs, failures = [np.log10(p)], [np.log10(prior / (totals[0] + prior))]
    for n in range(1, len(totals)):
        p = (totals[n] + prior * p[grams.suffixes[n]]) / (totals[n - 1][grams.contexts[n]] + prior)
        arcs.append(np.where(totals[n] > 0, np.log10(p), np.nan))
        failures.append(np.log10(prior / (totals[n] + prior)))
    return BackoffAutomaton(arcs, failures, grams.contexts)


_COLUMNS = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _score(prior: float, buckets: int, order: int):
    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame(columns=_COLUMNS)
        texts, block = _block_of(texts, buckets)
        of_words, of_grams = answers[answers["slot"] < buckets], answers[answers["slot"] >= buckets]
        word_totals, number, tokens, kinds = _known(block, of_words)
        grams = _Grams(block, number, order)
        totals = [word_totals[grams.by_rank]] + [np.zeros(len(c), np.int64) for c in grams.counts[1:]]
        slots = {n: grams.slots(n, buckets) for n in range(2, order + 1)}
        for slot, found in zip(of_grams["slot"], of_grams["totals"], strict=True):
            n, b = slot // buckets + 1, slot % buckets
            totals[n - 1][slots[n][b]] = unpack(found)
        machine = build(grams, totals, tokens, kinds, prior)
        sums = lambda x: np.add.reduceat(x[grams.steps[0]], block.firsts)
        out = {"n_tokens": block.sizes, "n_known": sums((totals[0] > 0).astype(np.int64)), "train_tokens": tokens, "base_score": sums(machine.arcs[0]), "score": machine.score(grams.steps, block.firsts)}
        return texts[["id", "held_out"]].assign(**out)[_COLUMNS]

    return run


def sizes_of(total: int, block_bytes: int) -> tuple[int, int]:
    """Numbers of blocks and of buckets for so many bytes of text."""
    block = max(block_bytes, math.isqrt(50 * total))
    return max(1, -(-total // block)), max(1, -(-total // (2 * block)))


def _stages(df: DataFrame, id_col: str, text_col: str, folds: int, held_out: int, prior: float, order: int, block_bytes: int, partitions: int) -> dict[str, DataFrame]:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), text.alias("text"), crc_of_id(F.col(id_col)).alias("crc"))
    blocks, buckets = sizes_of(blocks_of(df, text_col, block_bytes) * block_bytes, block_bytes)
    # Rows that repeat id and text are dealt by the partition they are read in too.
    rows = rows.select(
        "id", "text", "crc", (F.pmod(F.col("crc"), F.lit(folds)) == held_out).alias("held_out"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("text_hash")
    ).withColumn("block", F.pmod(F.xxhash64("crc", "size", "text_hash", F.spark_partition_id()), F.lit(blocks)).cast("int"))
    by_block, by_slot = min(blocks, partitions), min(buckets, partitions)
    rows = rows.repartition(by_block, "block")
    words = rows.groupBy("block").applyInPandas(_send_words(buckets), _SENT).repartition(by_slot, "slot")
    known = words.groupBy("slot").applyInPandas(_add_words(buckets), _ANSWER).repartition(by_block, "block")
    sent = {"words": words}
    answers = known
    if order > 1:
        sent["grams"] = rows.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_send_grams(buckets, order), _SENT).repartition(min(by_slot * (order - 1), partitions), "slot")
        answers = known.unionByName(sent["grams"].groupBy("slot").applyInPandas(_add_grams, _ANSWER))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sent | {"scores": rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(prior, buckets, order), schema).withColumnRenamed("id", id_col)}


def score_texts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, prior: float = 3.0, order: int = 3, block_bytes: int = 8 << 20, partitions: int = 20_000
) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of df.

    Training texts are those whose crc32(id as text) mod `folds` is not `held_out`. score: log10 probability of the
    text with its end; base_score: the same under the root alone. partitions: of a shuffle, at most; a partition may hold
    several blocks, which are taken one after the other.
    """
    return _stages(df, id_col, text_col, folds, held_out, prior, order, block_bytes, partitions)["scores"]
