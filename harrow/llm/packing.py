"""Bounded-space online packing of token pieces into windows.

A fixed number of open windows per partition; a piece goes where it fits best;
when it fits nowhere the fullest window is emitted. The windows left open at
the end of the partitions are merged, a bounded number of them in one task.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table, tidy

VOCABULARY = "byte_bpe_50k.json"
# The split of the byte-level vocabulary, written out for U+0000 to U+024F: contractions, letters, numbers, other signs, white space.
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_BEYOND = re.compile("[^\x00-\x1b\x20-ɏ]")  # beyond that range, or a separator that only Python takes as white space
_ODD_SPACE = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0")  # runs of white space, or others than blank and line feed


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return [chr(256 + other.index(b)) if b in other else chr(b) for b in range(256)]


class _Words(dict):
    """Ids of the vocabulary's words, as bytes; merged by the tokenizer's model, which spares its offsets."""

    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, dict(enumerate(_byte_letters()))

    def merge(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self.merge(word)
        return found


class _Fields(dict):
    """Ids of what stands between blanks, with the blank before it, or from a line feed on."""

    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, field: str) -> bytes:
        if field.isalpha():
            found = self.words.merge(" " + field)
        elif field[:-1].isalpha():  # letters and one other sign
            found = self[field[:-1]] + self.words[field[-1]]
        else:
            found = b"".join(map(self.words.__getitem__, _SPLIT.findall(field if field[0] == "\n" else " " + field)))
        self[field] = found
        return found


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, by ``tokenizers`` with add_special_tokens=False.

    The vocabulary splits a text into words before it merges bytes, and no word
    reaches from a sign into the white space after it, so the ids of words and
    of what stands between blanks can be kept and joined; ``limit`` bounds how many of each
    are kept. Texts with characters whose class is not written out above, or with the
    content of an added token such as an end mark, go to the tokenizer whole.
    """

    def __init__(self, path: str | None = None, limit: int = 600_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(self.tokenizer.model)
        self.fields = _Fields(self.words)
        self.limit = limit

    def _whole(self, text: str) -> bytes:
        ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> bytes:
        for kept in (self.words, self.fields):
            if len(kept) > self.limit:
                kept.clear()
        if _BEYOND.search(text) or any(x in text for x in self.added):
            return self._whole(text)
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _ODD_SPACE):
            return b"".join(map(self.words.__getitem__, _SPLIT.findall(text)))
        first, *more = text.replace("\n", " \n").split(" ")
        return b"".join([*map(self.words.__getitem__, _SPLIT.findall(first)), *map(self.fields.__getitem__, more)])


class OpenWindows:
    """At most ``limit`` open windows of ``width`` tokens; items are (size, content)."""

    def __init__(self, width: int, limit: int):
        self.width, self.limit = width, limit
        self.by_free: dict[int, list[list]] = {}
        self.mask, self.count = 0, 0  # bit n of mask: a window with n free tokens is open

    def _put(self, free: int, window: list) -> None:
        self.by_free.setdefault(free, []).append(window)
        self.mask |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        windows = self.by_free[free]
        window = windows.pop(0)
        if not windows:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        self.count -= 1
        return window

    def add(self, size: int, content: list) -> list | None:
        """Place an item; gives the contents of a window that this closes."""
        closed = None
        fits = self.mask >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            window = self._take(free)
        else:
            if self.count >= self.limit:
                closed = self._take((self.mask & -self.mask).bit_length() - 1)
            free, window = self.width, []
        window += content
        if free == size:
            return window if closed is None else closed + [None] + window
        self._put(free - size, window)
        return closed

    def rest(self) -> list[list]:
        return [w for free in sorted(self.by_free) for w in self.by_free[free]]


_NAMES = ["row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "part", "ids"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
_SCHEMA = "row_key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part int, ids binary"


def pack(docs: DataFrame, width: int = 1024, open_windows: int = 256, vocabulary: str | None = None, end_id: int = 0, text: str = "text", key: str = "doc_id", keep_ids: bool = True, fan_in: int = 8) -> DataFrame:
    """A row for each piece of a document's ids: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids are those of its text and ``end_id``; whole windows are
    cut off first, the rest is placed best-fit. Null text counts as empty: one
    piece with the end id. Null or repeated keys (of any type that a string can hold) are documents of their own; an
    empty table gives no piece. A task holds one batch, its open windows and a bounded store of word ids.
    ``fan_in`` partitions' leftovers, that is at most fan_in * open_windows
    windows, are merged in one task at a time, in as many rounds as it takes.
    """

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, part, number = Encoder(vocabulary), OpenWindows(width, open_windows), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def close(window: list, still_open: bool) -> None:
            nonlocal number
            offset = 0
            for piece in window:
                if piece is None:  # two windows closed at once
                    number, offset = number + 1, 0
                    continue
                rows.append((*piece[:5], part << 32 | number, offset, still_open, part, piece[5] if keep_ids or still_open else None))
                offset += piece[2]
            number += 1

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            rows.clear()
            return out

        weight = 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                k, ids = k.as_py(), encode.one(t.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, width):
                    own = ids[4 * start : 4 * (start + width)]
                    n = len(own) // 4
                    piece = (k, start, n, zlib.crc32(own), total, own)
                    if n == width:
                        close([piece], False)
                    elif closed := windows.add(n, [piece]):
                        close(closed, False)
                weight += total
                if weight > 1 << 20 and rows:
                    yield flush()
                    weight = 0
        for window in windows.rest():
            close(window, True)
        if rows:
            yield flush()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        """Windows of one group of partitions, the fullest first, into as few as fit; in the last round what is left
        of the emptiest windows is cut to fill the others."""
        last = bool(frame["last"].iloc[0])
        frame = frame.sort_values(["sequence_id", "offset"], kind="stable")
        own = {k: list(g.itertuples(index=False, name=None)) for k, g in frame[_NAMES].groupby("sequence_id", sort=True)}
        size = sorted(((sum(p[2] for p in w), k) for k, w in own.items()), key=lambda x: (-x[0], x[1]))
        windows = OpenWindows(width, len(size) + 1)
        closed = [full for n, k in size if (full := windows.add(n, [k]))]
        rest = sorted(([sum(p[2] for k in w for p in own[k]), w] for w in windows.rest()), key=lambda x: -x[0])
        groups = [([p for k in w for p in own[k]], False) for w in closed]
        if last:
            contents = [[p for k in w for p in own[k]] for _, w in rest]
            room = [width - n for n, _ in rest]
            j = len(contents) - 1
            for i in range(len(contents)):
                while room[i] and i < j:
                    key_, start, n, crc, total, *more, ids = contents[j].pop()
                    take = min(n, room[i])
                    if take < n:
                        head = ids[: 4 * (n - take)]
                        contents[j].append((key_, start, n - take, zlib.crc32(head), total, *more, head))
                        ids = ids[4 * (n - take) :]
                    contents[i].append((key_, start + n - take, take, zlib.crc32(ids), total, *more, ids))
                    room[i] -= take
                    room[j] += take
                    j -= not contents[j]
            groups += [(w, False) for w in contents if w]
        else:
            emptiest = max(0, len(rest) - open_windows)
            groups += [([p for k in w for p in own[k]], i >= emptiest) for i, (_, w) in enumerate(rest)]
        rows = []
        for window, still in groups:
            offset = 0
            for p in window:
                rows.append((*p[:5], window[0][5], offset, still, p[8], p[9]))
                offset += p[2]
        return pd.DataFrame(rows, columns=_NAMES)

    pieces = materialise(docs.select(docs[key].cast("string").alias("row_key"), docs[text].alias("body")).mapInArrow(place, _SCHEMA))
    done = [pieces.where("not open")]
    left = pieces.where("open")
    parts = (left.agg(F.max("part").alias("n")).first().n or 0) + 1
    while True:
        last = parts <= fan_in
        merged = left.withColumn("part", F.expr(f"part div {fan_in}").cast("int")).withColumn("last", F.lit(last))
        merged = merged.groupBy("part").applyInPandas(merge, _SCHEMA)
        if last:
            done.append(merged)
            break
        merged = materialise(merged)
        done.append(merged.where("not open"))
        left, parts = merged.where("open"), -(-parts // fan_in)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("row_key", F.col("row_key").cast(docs.schema[key].dataType)).withColumnRenamed("row_key", key).drop("open", "part", *([] if keep_ids else ["ids"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keep_ids=False)
