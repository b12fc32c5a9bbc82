"""Two tokenizers' segmentations of the same bytes, aligned by a dangling-suffix transducer.

The transducer reads one token at a time, always from the side that lags. Its
state is the side that leads and the bytes by which it leads; when none are
left a group closes. Transitions are memoised by residual and token, so bytes are
compared once for each of them, and whole closed runs between blanks are kept as well.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialise, only, table
from .packing import _BEYOND, _ODD_SPACE, VOCABULARY, _byte_letters

PIECES = "piece_bpe_32k.model"
BLANK = "▁"
B_BITS = 16  # of a link's number: the A id, then the B id
HOT_PAIRS = 500_000  # id pairs that are broadcast at most, 24 bytes each
KEPT = 250_000  # memoised transitions of one worker, and closed runs in each of its two stores
TOGETHER = 2_000_000  # characters of texts that are tokenized at once, or one text


class _State(dict):
    """Token of the lagging side -> next state; ``a_leads`` is None where nothing dangles. A token that contradicts the residual leads to None."""

    __slots__ = ("a_leads", "rest", "machine")

    def __init__(self, machine: Transducer, a_leads: bool | None, rest: bytes):
        self.machine, self.a_leads, self.rest = machine, a_leads, rest

    def __missing__(self, token: int) -> _State | None:
        self[token] = found = self.machine.after(self, token)
        return found


class Transducer:
    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], limit: int = KEPT):
        self.a_bytes, self.b_bytes, self.limit = a_bytes, b_bytes, limit
        self.names_a, self.names_b = [str(i) for i in range(len(a_bytes))], [str(i) for i in range(len(b_bytes))]
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple[bool, bytes], _State] = {}
        self.start, self.known = _State(self, None, b""), 0

    def _state(self, a_leads: bool, rest: bytes) -> _State:
        if not rest:
            return self.start
        return self.states.setdefault((a_leads, rest), _State(self, a_leads, rest))

    def after(self, state: _State, token: int) -> _State | None:
        self.known += 1
        if state.a_leads is None:
            return self._state(True, self.a_bytes[token])
        new, rest = (self.b_bytes if state.a_leads else self.a_bytes)[token], state.rest
        if rest.startswith(new):
            return self._state(state.a_leads, rest[len(new) :])
        return self._state(not state.a_leads, new[len(rest) :]) if new.startswith(rest) else None

    def run(self, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """Groups as ``a1,a2|b1;a3|b2`` and the number of every link; None where the bytes of both differ."""
        if self.known > self.limit:
            self._forget()
        start = state = self.start
        i = j = i0 = j0 = 0
        links, groups, names_a, names_b = [], [], self.names_a, self.names_b
        try:
            while True:
                if state.a_leads:
                    token = b[j]
                    j += 1
                    links.append(a[i - 1] << B_BITS | token)
                elif state is start:
                    if i == len(a):
                        return (";".join(groups), links) if j == len(b) else None
                    token = a[i]
                    i += 1
                else:
                    token = a[i]
                    i += 1
                    links.append(token << B_BITS | b[j - 1])
                state = state[token]
                if state is start:
                    if i - i0 == j - j0 == 1:
                        groups.append(names_a[a[i0]] + "|" + names_b[token])
                    else:
                        groups.append(",".join([names_a[x] for x in a[i0:i]]) + "|" + ",".join([names_b[x] for x in b[j0:j]]))
                    i0, j0 = i, j
                elif state is None:
                    return None
        except IndexError:  # one side ended while the other leads
            return None


class Aligner:
    """Aligns texts; A by ``tokenizers`` with a blank before the text, B by ``sentencepiece``, which adds it.

    Pieces of B reach neither from another character into a blank nor over a line feed, words of A neither; so what stands between blanks,
    with the blank before it, or from a line feed on, is segmented alike wherever it stands. The closed run of such a field is kept:
    of two stores of ``limit`` fields the older goes when the newer is full, and a field met again moves to the newer.
    """

    def __init__(self, a_path: str | None = None, b_path: str | None = None, limit: int = KEPT):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words = Tokenizer.from_file(a_path or public_tokenizers.path(VOCABULARY))
        self.words.encode_special_tokens = True  # their strings are plain text
        self.pieces = own = SentencePieceProcessor(model_file=b_path or public_tokenizers.path(PIECES), num_threads=1)
        letters = {c: b for b, c in enumerate(_byte_letters())}
        special = set(self.words.get_added_tokens_decoder())
        a_bytes = [(self.words.id_to_token(i) or "") for i in range(self.words.get_vocab_size())]
        a_bytes = [t.encode() if i in special else bytes(letters[c] for c in t) for i, t in enumerate(a_bytes)]
        names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        b_bytes = [bytes([int(t[3:5], 16)]) if own.is_byte(i) else t.replace(BLANK, " ").encode() for i, t in enumerate(names)]
        self.machine, self.limit = Transducer(a_bytes, b_bytes), limit
        self.newer: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.by_fields = not any("\n" in t or BLANK in t.lstrip(BLANK) for t in names) and own.encode("\n")[:1] == [own.piece_to_id(BLANK)]

    def _aligned(self, text: str, a: list[int], b: list[int]) -> tuple[int, int, int, bytes, tuple[int, ...]] | None:
        """n_a, n_b, n_groups, the groups and the links' numbers; None where the joined bytes of A or B are not the text."""
        own = self.machine.a_bytes
        if b"".join([own[i] for i in a]) != text.encode():
            return None
        found = self.machine.run(a, b)
        return found and (len(a), len(b), found[0].count(";") + 1, found[0].encode(), tuple(found[1]))

    def _fields(self, text: str) -> list[str] | None:
        if not self.by_fields or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD_SPACE) or _BEYOND.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def _learn(self, fields: set[str]) -> None:
        newer, older, new = self.newer, self.older, []
        for f in fields:
            if f not in newer:
                if f in older:
                    newer[f] = older[f]
                else:
                    new.append(f)
        if new:
            whole = [f if f[0] == "\n" else " " + f for f in new]
            for f, text, a, b in zip(new, whole, self.words.encode_batch_fast(whole, add_special_tokens=False), self.pieces.encode(new, num_threads=1), strict=True):
                newer[f] = self._aligned(text, a.ids, b[1:] if f[0] == "\n" else b)

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, int, bytes, Counter] | None]:
        """Of each text n_a, n_b, n_groups, the groups and each link's number with its occurrences; None where it has no tokens."""
        if len(self.newer) > self.limit:
            self.newer, self.older = {}, self.newer
        split = [self._fields(t) if t else None for t in texts]
        self._learn(set().union(*[f for f in split if f]))
        runs, out = self.newer, []
        for text, fields in zip(texts, split, strict=True):
            if fields is None:
                found = self._aligned(" " + text, self.words.encode(" " + text, add_special_tokens=False).ids, self.pieces.encode(text)) if text else None
                out.append(found and (*found[:4], Counter(found[4])))
                continue
            own = [runs[f] for f in fields]
            if None in own:
                out.append(None)
                continue
            a, b, n, groups, links = zip(*own, strict=True)
            out.append((sum(a), sum(b), sum(n), b";".join(groups), Counter(chain.from_iterable(links))))
        return out


def _worker(a_path: str | None, b_path: str | None) -> Aligner:
    """One for all tasks of a worker process: what it has learnt does not change its answers."""
    kept = sys.modules.setdefault("harrow_kept", ModuleType("harrow_kept")).__dict__
    if (a_path, b_path) not in kept:
        kept[a_path, b_path] = Aligner(a_path, b_path)
    return kept[a_path, b_path]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row for each row of docs: row, key, n_a, n_b, n_groups, n_links, groups_sha256, and its different links as pairs (numbers a * 65536 + b) with their times; materialised.

    Null and empty texts, and those whose joined bytes of A or B are not the blank
    and the text, have zeros, an empty groups_sha256 and no pairs. Null or repeated keys are
    documents of their own, further columns stay out, an empty table gives none. A task holds one batch of
    texts, the tokens of one of them and a bounded store of transitions and runs.
    """
    kind = docs.schema[key].dataType
    fields = [("key", to_arrow_type(kind)), *[(n, pa.int64()) for n in NUMBERS], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
    schema = StructType([StructField("key", kind)]).simpleString()[7:-1].replace("key:", "key ", 1)
    schema = f"{schema}, {', '.join(f'{n} long' for n in NUMBERS)}, groups_sha256 string, pairs array<long>, times array<int>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _worker(a_path, b_path)

        def out(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            found = aligner(texts)
            numbers = np.array([(x[0], x[1], x[2], x[0] + x[1] - x[2]) if x else (0, 0, 0, 0) for x in found], np.int64)
            ends = np.cumsum([0, *[len(x[4]) if x else 0 for x in found]]).astype(np.int32)
            pairs = np.fromiter((k for x in found if x for k in x[4]), np.int64, ends[-1])
            times = np.fromiter((n for x in found if x for n in x[4].values()), np.int32, ends[-1])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (pairs, times)]
            digests = pa.array([hashlib.sha256(x[3]).hexdigest() if x else "" for x in found])
            return pa.record_batch([keys.cast(fields[0][1]), *map(pa.array, numbers.T), digests, *lists], names=[n for n, _ in fields])

        for batch in batches:
            texts: list[str | None] = []
            done = weight = 0
            for text in batch.column(1):
                texts.append(text.as_py())
                weight += len(texts[-1] or "") + 16
                if weight > TOGETHER:
                    yield out(batch.column(0)[done : done + len(texts)], texts)
                    done, weight, texts = done + len(texts), 0, []
            if texts:
                yield out(batch.column(0)[done:], texts)

    linked = docs.select(docs[key].alias("key"), docs[text].alias("body")).mapInArrow(rows, schema)
    return materialise(linked.select(F.monotonically_increasing_id().alias("row"), "*"))


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, a, b, n (documents that hold the pair linked) and best (no pair of the same A id has a higher n); materialised."""
    counts = materialise(linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.shiftright("pair", B_BITS)
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("a", a).join(highest, "a")
    return materialise(joined.select("pair", "a", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b"), "n", (F.col("n") == F.col("most")).alias("best")))


def scored(linked: DataFrame, counts: DataFrame, most: int = HOT_PAIRS) -> DataFrame:
    """The rows of ``linked`` without their pairs, with n_best and count_sum.

    The pairs that most documents hold, at most ``most`` of them, are broadcast. Any
    other pair then has a share of the links that cannot make a task of a shuffle hot.
    """
    size = F.floor(F.log2("n"))
    sizes = sorted(((r["size"], r["count"]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)  # at most 64 rows
    total, least = 0, 63
    for power, count in sizes:
        total += count
        if total > most:
            break
        least = power
    known = counts.select("pair", "n", F.when(F.col("best"), 1).otherwise(0).alias("is_best"))
    hot, cold = known.where(size >= least), known.where(size < least)
    kept = [c for c in linked.columns if c not in ("pairs", "times")]
    links = linked.select(*kept, F.explode_outer(F.arrays_zip("pairs", "times")).alias("link")).select(*kept, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    sums = links.join(F.broadcast(hot), "pair", "left")
    if total > most:
        sums = sums.where("n is not null or pair is null").unionByName(links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").where("pair is not null").join(cold, "pair"))

    def total_of(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast(LongType())

    return sums.groupBy(*kept).agg(total_of(F.col("times") * F.col("is_best")).alias("n_best"), total_of(F.col("times") * F.col("n")).alias("count_sum"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = align(only(table(spark, sf_dir, "documents"), "doc_id", "text"))
    out = scored(linked, pair_counts(linked))
    return out.select(F.col("key").alias("doc_id"), *NUMBERS, "n_best", "count_sum", "groups_sha256")
