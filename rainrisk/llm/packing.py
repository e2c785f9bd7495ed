"""Shortest-pack-first packing over the length histogram.

Documents become token pieces of at most one sequence. Only the histogram of piece lengths, with one entry per possible
length, goes to the driver. There, lengths are placed longest first into the packs with the most room, as
pattern counts: how many packs hold which lengths. Each pattern covers a range of ranks of its lengths, so pieces find their pack by
(length, rank). Pieces move through one shuffle; token ids never do unless asked for.

Defined cases: null and empty texts are one piece, the end id alone. Repeated rows are packed like any others. Equal pieces may swap
places between runs over differently ordered repeats. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainrisk.llm.common import ROW, ranked, stored

LENGTH, END = 2048, 1
#: Words whose ids a Python worker remembers, in two generations, the longest of them in bytes, words of letters per call, bytes of
#: texts whose new words are learned together. Ids do not depend on the memory.
REMEMBERED, LONGEST, JOINED, PORTION = 350_000, 64, 2000, 1 << 20
#: Words of printable Latin letters and signs: composed already, and lower case is letter by letter.
PLAIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f]+")
PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Ids of white-space separated words as little-endian bytes. The tokenizer never joins characters over white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # lower case is all that the normalizer would do to plain words
        self.plain.normalizer = normalizers.Sequence([])
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known, self.older = {}, {}

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of the texts in order. New words are learned for ``PORTION`` bytes of texts at once, as calls cost more than words."""
        portion, size = [], 0
        for text in texts:
            data = text.encode()
            portion.append(data.split())
            size += len(data)
            if size >= PORTION:
                yield from self.encoded(portion)
                portion, size = [], 0
        yield from self.encoded(portion)

    def encoded(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        fresh = set().union(*texts).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > REMEMBERED:
                self.older, self.known = self.known, {}
                fresh = set().union(*texts)
            self.known.update((w, self.older[w]) for w in fresh if w in self.older)
            self.learn([w.decode() for w in fresh if w not in self.known])
        yield from [b"".join(map(self.known.__getitem__, words)) for words in texts]
        for w in fresh:
            if len(w) > LONGEST:
                del self.known[w]

    def learn(self, words: list[str]) -> None:
        letters, plain, other = [], [], []
        for w in words:
            (other if PLAIN.fullmatch(w) is None or "<|" in w else letters if w.isalpha() else plain).append(w)
        for tokenizer, own in ((self.plain, plain), (self.tokenizer, other)):
            found = tokenizer.encode_batch_fast([w.lower() for w in own] if tokenizer is self.plain else own, add_special_tokens=False)
            self.known.update((w.encode(), array("I", e.ids).tobytes()) for w, e in zip(own, found))
        # a word of letters ends with its only word-end token, so many can share one call
        for a in range(0, len(letters), JOINED):
            own = letters[a:a + JOINED]
            ids = np.array(self.plain.encode_batch_fast([" ".join(own).lower()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.known.update((w.encode(), data[i:j]) for w, i, j in zip(own, [0, *cuts], cuts, strict=False))


#: One per worker and tokenizer, kept between tasks.
_CODERS: dict[str, WordIds] = {}


def coder_of(path: str) -> WordIds:
    """The worker's own coder; a function of the module finds it, a closure would carry a copy."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, on request ids; full pieces first, the rest last.

    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col("text").alias("_text"))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, {PIECE}" + (", ids array<int>" if with_ids else "")
    stop = np.array([end], dtype="<u4").tobytes()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(tokenizer)
        for part in parts:
            at, start, size, crc, total, ids = [], [], [], [], [], []
            for i, data in enumerate(coder.encode_all(text.as_py() or "" for text in part.column(1))):
                data += stop
                n = len(data) // 4
                for a in range(0, n, length):
                    piece = data[4 * a:4 * (a + length)]
                    at.append(i), start.append(a), size.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<i4"))
            columns = [part.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return rows.mapInArrow(cut, schema)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packs that hold the histogram: longest lengths first, each into the packs with the most room.

    Where no pack has room, new ones open, filled with the same length as far as it goes.
    """
    room: dict[int, list[list]] = {}
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            gap = max(room, default=0)
            if gap >= size:
                count, held = room[gap].pop()
                if not room[gap]:
                    del room[gap]
                # as many of this length as leave the pack at least as full as the next candidate
                many = max(1, min(gap // size, (gap - max(room, default=0)) // size, n // count))
                used = min(count, n // many)
                if used < count:
                    room.setdefault(gap, []).append([count - used, held])
                room.setdefault(gap - many * size, []).append([used, held + (size,) * many])
                n -= used * many
            else:
                many = min(length // size, n)
                used = n // many
                room.setdefault(length - many * size, []).append([used, (size,) * many])
                n -= used * many
    return [(count, held) for packs in room.values() for count, held in packs]


def places(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece length, first rank, ranks, first sequence, offset) for every slot of every pattern; ranks of a length never overlap."""
    rows, at, first = [], dict.fromkeys(histogram, 0), 0
    for count, held in patterns(histogram, length):
        offset = 0
        for size in held:
            rows.append((size, at[size], count, first, offset))
            at[size] += count
            offset += size
        first += count
    return rows


def packed(docs: DataFrame, tokenizer: str, key: str = "doc_id", length: int = LENGTH, end: int = END, seed: int = 23, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, key, length, end, with_ids)
    rows = stored(cut.withColumns({ROW: F.monotonically_increasing_id(), "_h": F.xxhash64(F.lit(seed), "_key", "start", "ids_crc32")}))
    # one entry per possible length: ``length`` rows at most
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # slots are bounded by the sequence length alone, not by the documents
    slots = spark.createDataFrame(places(histogram, length), "_length long, _from long, _ranks long, _first long, offset long")
    placed = ranked(rows, ["length"], "_h", "_rank").join(
        F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_ranks")))
    return placed.select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens",
                         (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset", *["ids"] * with_ids)


def sequences(packs: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces with ids: one row of at most one sequence length each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packs.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
