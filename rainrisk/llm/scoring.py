"""Language-model scores by logistic mixing of hashed-context bit predictors along the texts.

A text is its lower-cased words, each with one space, and one end. It is spelled in bits: bytes through a prefix code, so that common bytes take few
decisions. Every decision has one predictor per context length: how often either bit came in the training texts after the last one to five bytes of the
text, whatever words they belong to, looked up in a hashed table of fixed size. Predictors meet in the logistic domain under weights chosen by a
gate (depth in the token and in the code), learned in steps; an adaptive table corrects the result, and the product over the bits is the
spelled probability of the token where it stands. Three experts know whole tokens: how often a token came after the token before it, in such a
class (language of the latest telling word, start, end of sentence) and overall. Their shares and that of spelling start even in every text
and follow what explained the text so far. Nothing looks at the token itself before it is coded, so the scores are probabilities.

How it runs: documents are coded in blocks. Bits depend on six bytes, so the texts are counted as distinct six-byte grams, a block's order of words
as distinct pairs of neighbours (known by 32 bits of hash in a bucket), its tokens as a vocabulary. Only these move: their training counts add up over
the corpus, those of tokens and pairs return to the blocks, which then read their texts in order and spell each distinct gram once. All counts cover all training documents.
What is sent to every task has a fixed size: ``SLOTS`` counters for each context length, weights and small tables.

Defined cases: a null text is empty, its only token is the end. A null doc_id counts as empty text for the split. Repeated rows count as often as they
occur. Without training documents every token is unknown and the spelled expert knows nothing: all bits cost one. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rainrisk.llm.common import stored
from rainrisk.llm.quality import COMMON_WORDS
from rainrisk.llm.simhash import LOWER

END = b"\n"
SPACE = 0x20
#: Tokens per block; counters per context length; context lengths in bytes.
BLOCK_TOKENS, SLOTS, ORDERS = 2_500_000, 1 << 20, (1, 2, 3, 4, 5)
#: Distinct grams that a task holds before it passes their counts on.
HELD_GRAMS = 1 << 21
CHUNK = 1 << 14
#: Words that belong to one of the languages only tell which one a text is in.
_ALL = [w for ws in COMMON_WORDS.values() for w in ws]
LANGUAGE_OF = {w.encode(): i + 1 for i, ws in enumerate(COMMON_WORDS.values()) for w in ws if _ALL.count(w) == 1}
PLACES = 3
CLASSES = (len(COMMON_WORDS) + 1) * PLACES
GATES = 12
BUCKETS = 33
RATE, BATCH = 0.3, 20_000
#: Marks before a text, as many as the longest context looks back.
START = b"\x01" * max(ORDERS)
#: Kinds of rows; tokens read at once.
DOCS, TOKENS, PAIRS, GRAMS = range(4)
PORTION = 1 << 16
#: Taken off the count of a pair, as pairs seen once mostly do not come again; tokens that an even start weighs; rounds in which shares follow.
LESS, EVEN, ROUNDS = 0.75, 4.0, 2


# coding documents in blocks


def encode_blocks(docs: DataFrame, key: str, buckets: int) -> DataFrame:
    """Per block of documents: a row of ``part`` DOCS with its texts as numbers, and rows by part and bucket of its vocabulary and pairs; rows of grams stand for several blocks.

    A text is a list of numbers of (token, class), by how usual they are; ``counts`` of its row turns them into places in the order of the vocabulary's buckets. In other rows ``values`` holds what is counted,
    ``counts`` its training counts, both in the same order; vocabulary rows hold ``classes`` too.
    """
    rows = docs.select(F.col(key).alias("_key"), F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(7)).cast("int").alias("fold"), F.col("text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, block, grams = TaskContext.get().partitionId() << 32, _Block(buckets), _Grams(buckets)
        for part in parts:
            for i in range(part.num_rows):
                block.add(part.column(0).slice(i, 1), part.column(1)[i].as_py() == 2, part.column(2)[i].as_py())
                if block.tokens >= BLOCK_TOKENS:
                    yield from block.batches(turn, grams)
                    if len(grams.values) > HELD_GRAMS:
                        yield from grams.batches(turn)
                    turn, block = turn + 1, _Block(buckets)
        if block.held:
            yield from block.batches(turn, grams)
        yield from grams.batches(turn)

    return rows.mapInArrow(encode, "block long, part int, bucket int, values binary, classes binary, counts binary, "
                                   f"keys array<{kind}>, held array<boolean>, sizes array<int>, bytes array<long>, numbers binary")


def packed(values: np.ndarray | bytes) -> bytes:
    """Compressed; equal bytes of numbers side by side."""
    return zlib.compress(values if isinstance(values, bytes) else np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def grams_of(data: bytes) -> np.ndarray:
    """Each byte from the sixth on with the five before it, the byte itself lowest."""
    flat = np.frombuffer(data, dtype=np.uint8)
    two = flat[:-1].astype(np.uint64) << np.uint64(8) | flat[1:]
    return two[:-4] << np.uint64(32) | two[2:-2] << np.uint64(16) | two[4:]


def lengths(bodies: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))


def text_grams(tokens: np.ndarray, starts: np.ndarray, bodies: list[bytes], size: int = 1 << 17, length: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Portions of the texts ``tokens`` that begin at ``starts``: which tokens, their lengths, the grams of their bytes. ``length`` of the bodies, if known."""
    length = lengths(bodies) if length is None else length
    begins = np.zeros(len(tokens), dtype=bool)
    begins[starts] = True
    tail = START
    for a in range(0, len(tokens), size):
        own, first = tokens[a:a + size].tolist(), np.flatnonzero(begins[a:a + size])
        # marks stand before each text, their own grams are left out
        pieces, at = [tail], 0
        for i in first.tolist():
            pieces += [*map(bodies.__getitem__, own[at:i]), START]
            at = i
        pieces += map(bodies.__getitem__, own[at:])
        data = b"".join(pieces)
        n = length[tokens[a:a + size]]
        marks = np.zeros(len(n), dtype=np.int64)
        marks[first] = len(START)
        ends = np.cumsum(n + marks)
        grams = grams_of(data)
        real = np.ones(len(grams), dtype=bool)
        real[((ends - n)[first][:, None] - np.arange(1, len(START) + 1)).ravel()] = False
        yield slice(a, a + len(n)), n, grams[real]
        tail = data[-len(START):]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order and how often their lowest bit is set; that bit is taken off."""
    keys = np.sort(keys)
    values = keys >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat((keys & np.uint64(1)).astype(np.int64), first)


def added(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and their summed counts; each list of ``values`` is distinct and in order."""
    known = np.sort(np.concatenate(values))
    known = known[np.concatenate([[True], known[1:] != known[:-1]])[:len(known)]]
    sums = np.zeros(len(known), np.int64)
    for v, n in zip(values, counts):
        sums[np.searchsorted(known, v)] += n
    return known, sums


def pair_keys(before: np.ndarray, tokens: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of hash of each token with the one before it."""
    out = np.empty(len(tokens), dtype=np.uint64)
    # in portions, as a block has millions
    for a in range(0, len(tokens), PORTION):
        own = slice(a, a + PORTION)
        mixed = (hashes[before[own]] * np.uint64(0x9E3779B97F4A7C15) + hashes[tokens[own]]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        out[own] = (mixed >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32) | mixed & np.uint64(0xFFFFFFFF)
    return out


def token_hashes(vocabulary: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))


def tokens_before(tokens: np.ndarray) -> np.ndarray:
    """The token before each of some whole texts: as every text has one end, the end of another stands before each."""
    return np.concatenate([tokens[-1:], tokens[:-1]])


def _row(key: pa.DataType, block: int, part: int, bucket: int, values: bytes, classes: bytes | None = None, counts: bytes | None = None, lists: tuple = (None,) * 4, numbers: bytes | None = None) -> pa.RecordBatch:
    kinds = (key, pa.bool_(), pa.int32(), pa.int64())
    columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if x is not None else pa.array([None], pa.list_(t)) for x, t in zip(lists, kinds)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([bucket], pa.int32()),
                                       *(pa.array([x], pa.binary()) for x in (values, classes, counts)), *columns, pa.array([numbers], pa.binary())],
                                      names=["block", "part", "bucket", "values", "classes", "counts", "keys", "held", "sizes", "bytes", "numbers"])


class _Grams:
    """Distinct grams of blocks with their training counts."""

    def __init__(self, buckets: int) -> None:
        self.values, self.counts, self.buckets, self.key = np.zeros(0, np.uint64), np.zeros(0, np.int64), buckets, None

    def add(self, values: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.values, self.counts = added([self.values, *values], [self.counts, *counts])

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        of = (self.values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(self.buckets)
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.buckets + 1, dtype=np.uint64))
        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                yield _row(self.key, block, GRAMS, bucket, packed(self.values[order[a:b]]), counts=packed(self.counts[order[a:b]]))
        self.values, self.counts = self.values[:0], self.counts[:0]


class _Block:
    def __init__(self, buckets: int) -> None:
        self.ids, self.buckets = defaultdict(count().__next__), buckets
        self.keys, self.held, self.sizes, self.bytes, self.coded, self.tokens = [], [], [], [], [], 0

    def add(self, key: pa.Array, held: bool, text: str | None) -> None:
        words = (text or "").encode().translate(LOWER).split()
        self.bytes.append(sum(map(len, words)) + len(words) + 1)
        words.append(END)
        coded = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int32, count=len(words))
        self.keys.append(key), self.held.append(held), self.sizes.append(len(words)), self.coded.append(coded)
        self.tokens += len(words)

    def batches(self, block: int, grams: _Grams) -> Iterator[pa.RecordBatch]:
        """Rows of the block; its grams are added to ``grams``."""
        found = list(self.ids)
        hashes = token_hashes(found)
        of = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.array(sorted(range(len(found)), key=found.__getitem__), dtype=np.int64)
        order = order[np.argsort(of[order], kind="stable")]
        vocabulary, of, hashes = [found[i] for i in order.tolist()], of[order], hashes[order]
        rank = np.empty(len(order), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ids = rank[np.concatenate(self.coded)]
        language = np.zeros(len(vocabulary), dtype=np.int32)
        for w in LANGUAGE_OF.keys() & self.ids.keys():
            language[rank[self.ids[w]]] = LANGUAGE_OF[w]
        self.coded, self.ids = [], {}
        stop = np.fromiter((w[-1] in b".!?" for w in vocabulary), dtype=bool, count=len(vocabulary))
        sizes = np.array(self.sizes)
        starts = np.cumsum(sizes) - sizes
        place = np.where(np.concatenate([[False], stop[ids[:-1]]]), 1, 2).astype(np.int32)
        place[starts] = 0
        # the latest telling word before each token, inside its document
        at = np.where(language[ids] > 0, np.arange(len(ids), dtype=np.int32), np.int32(-1))
        before = np.concatenate([np.array([-1], np.int32), np.maximum.accumulate(at)[:-1]])
        tongue = np.where(before >= np.repeat(starts, sizes), language[ids[np.maximum(before, 0)]], 0)
        coded = ids * np.int32(CLASSES) + tongue * PLACES + place
        often = np.bincount(coded, minlength=len(vocabulary) * CLASSES)
        distinct = np.flatnonzero(often)
        often = often[distinct]
        among = np.zeros(len(vocabulary) * CLASSES, np.int32)
        among[distinct] = np.arange(len(distinct), dtype=np.int32)
        coded = among[coded]
        learn = np.repeat(~np.array(self.held), sizes)
        train = np.bincount(coded, weights=learn, minlength=len(distinct)).astype("<i4")
        token = distinct // CLASSES
        del at, before, tongue, place, among
        # frequent numbers are small in the stored texts
        usual = np.argsort(-often, kind="stable").astype("<i4")
        rank = np.empty(len(usual), dtype="<i4")
        rank[usual] = np.arange(len(usual))
        numbers = packed(rank[coded])
        del coded

        lists = (pa.concat_arrays(self.keys), pa.array(self.held), pa.array(sizes, pa.int32()), pa.array(self.bytes, pa.int64()))
        key = grams.key = lists[0].type
        yield _row(key, block, DOCS, -1, packed(b" ".join(vocabulary)), packed(distinct.astype("<i4")), packed(usual), lists, numbers)
        del lists, numbers
        cuts = np.searchsorted(of[token], np.arange(self.buckets + 1))
        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                yield _row(key, block, TOKENS, bucket, packed(b" ".join(map(vocabulary.__getitem__, token[a:b].tolist()))), packed((distinct[a:b] % CLASSES).astype(np.uint8)), packed(train[a:b]))
        pairs, n = counted(pair_keys(tokens_before(ids), ids, hashes, self.buckets) << np.uint64(1) | learn)
        cuts = np.searchsorted(pairs >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))
        for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                yield _row(key, block, PAIRS, bucket, packed(np.diff(pairs[a:b] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype("<u4")), counts=packed(n[a:b].astype("<i4")))
        del pairs, n
        some, often = [], []
        for part, size, six in text_grams(ids, starts, spelled_out(vocabulary)):
            values, n = counted(six << np.uint64(1) | np.repeat(learn[part], size))
            some.append(values), often.append(n)
            # before their number grows with the texts
            if sum(map(len, some)) > HELD_GRAMS:
                grams.add(some, often)
                some, often = [], []
        grams.add(some, often)


def spelled_out(vocabulary: list[bytes]) -> list[bytes]:
    return [w if w == END else w + b" " for w in vocabulary]


# adding up the blocks: every bucket is one group; ``buckets`` bounds its size


TOLD = "block long, part int, bucket int, counts binary, others binary"


def _told(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["block", "part", "bucket", "counts", "others"])


def tokens_told(blocks: DataFrame) -> DataFrame:
    """Training counts of the numbers of every (block, bucket), by token and by token and class; a row of block -1 per bucket has its known tokens and its sums by class."""
    def merge(rows: pa.Table) -> pa.Table:
        index, keys, weights = defaultdict(count().__next__), [], []
        for tokens, classes, counts in zip(*(rows.column(c).to_pylist() for c in ("values", "classes", "counts"))):
            words = zlib.decompress(tokens).split(b" ")
            keys.append(np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)) * CLASSES + unpacked(classes, "u1"))
            weights.append(unpacked(counts, "<i4"))
        by_class = np.bincount(np.concatenate(keys), weights=np.concatenate(weights), minlength=len(index) * CLASSES).astype(np.int64)
        total, bucket = by_class.reshape(-1, CLASSES).sum(axis=1), rows.column("bucket")[0].as_py()
        out = [(b, TOKENS, bucket, packed(total[k // CLASSES]), packed(by_class[k])) for b, k in zip(rows.column("block").to_pylist(), keys)]
        sums = by_class.reshape(-1, CLASSES).sum(axis=0)
        return _told([*out, (-1, TOKENS, bucket, packed(np.array([np.count_nonzero(total)])), packed(sums))])

    return blocks.where(F.col("part") == TOKENS).select("block", "bucket", "values", "classes", "counts").groupBy("bucket").applyInArrow(merge, TOLD)


def pairs_told(blocks: DataFrame) -> DataFrame:
    """Training counts of the pairs of every (block, bucket), in their order."""
    def merge(rows: pa.Table) -> pa.Table:
        values = [np.cumsum(unpacked(v, "<u4"), dtype=np.uint64) for v in rows.column("values").to_pylist()]
        counts = np.concatenate([unpacked(n, "<i4") for n in rows.column("counts").to_pylist()])
        cuts = np.cumsum([0, *map(len, values)])
        # equal pairs side by side, each with its place
        keys = np.concatenate(values) << np.uint64(32) | np.arange(cuts[-1], dtype=np.uint64)
        del values
        keys.sort()
        place = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        keys >>= np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.empty(len(place), np.int64)
        sums[place] = np.repeat(np.add.reduceat(counts[place].astype(np.int64), first), np.diff(first, append=len(place)))
        bucket = rows.column("bucket")[0].as_py()
        return _told([(block, PAIRS, bucket, packed(sums[a:b]), None) for block, a, b in zip(rows.column("block").to_pylist(), cuts, cuts[1:])])

    return blocks.where(F.col("part") == PAIRS).select("block", "bucket", "values", "counts").groupBy("bucket").applyInArrow(merge, TOLD)


def gram_counts(blocks: DataFrame) -> DataFrame:
    """A row per distinct gram: bucket, gram and training count."""
    def merge(rows: pa.Table) -> pa.Table:
        grams, total = added([unpacked(v, "<u8") for v in rows.column("values").to_pylist()], [unpacked(n, "<i8") for n in rows.column("counts").to_pylist()])
        return pa.table({"gram": pa.array(grams.astype(np.int64)), "total": pa.array(total)})

    return blocks.where(F.col("part") == GRAMS).select("bucket", "values", "counts").groupBy("bucket").applyInArrow(merge, "gram long, total long")


# spelling tokens in bits


def prefix_code(weights: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """Nodes passed and bits taken for each of the 256 bytes in a Huffman tree; bytes never seen weigh least."""
    heap = [(float(w) + 1e-3, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children, fresh = {}, 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    nodes, bits = [[] for _ in range(256)], [[] for _ in range(256)]
    todo = [(heap[0][2], [], [])]
    while todo:
        node, path, taken = todo.pop()
        if node < 256:
            nodes[node], bits[node] = path, taken
        else:
            todo += [(child, path + [node - 256], taken + [bit]) for bit, child in enumerate(children[node])]
    return nodes, bits


class Speller:
    """Bit decisions of tokens as flat arrays."""

    def __init__(self, weights: np.ndarray):
        nodes, bits = prefix_code(weights)
        self.length = np.array([len(b) for b in bits])
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.nodes, self.bits = np.concatenate(nodes).astype(np.uint64), np.concatenate(bits).astype(bool)

    def decisions(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Like ``of_grams`` for texts of one token each."""
        owner, grams = [], []
        for i, t in enumerate(tokens):
            grams.append(grams_of(START + spelled_out([t])[0]))
            owner.append(np.full(len(grams[-1]), i))
        byte, bit, slots, gate = self.of_grams(np.concatenate(grams))
        return np.concatenate(owner)[byte], bit, slots, gate

    def of_grams(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gram of each decision, its bit, its slots (one row per context length), its gate."""
        back = [(grams >> np.uint64(8 * j) & np.uint64(255)).astype(np.int64) for j in range(max(ORDERS) + 1)]
        symbol = back[0]
        # bytes since the last space or mark, three at most
        blank = [(b == SPACE) | (b == START[0]) for b in back[1:4]]
        deep = np.where(blank[0], 0, np.where(blank[1], 1, np.where(blank[2], 2, 3)))
        steps = self.length[symbol]
        byte = np.repeat(np.arange(len(symbol)), steps)
        depth = np.arange(len(byte)) - np.repeat(np.cumsum(steps) - steps, steps)
        place = self.first[symbol[byte]] + depth
        node = self.nodes[place] * np.uint64(0x9E3779B97F4A7C15)
        slots = np.empty((len(ORDERS), len(byte)), dtype=np.int32)
        context = np.zeros(len(symbol), dtype=np.uint64)
        for i, order in enumerate(ORDERS):
            context = (context ^ back[order].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(order)
            mixed = (context[byte] ^ node) * np.uint64(0xC4CEB9FE1A85EC53)
            slots[i] = (mixed >> np.uint64(64 - 20)).astype(np.int32)
        gate = deep[byte] * 3 + np.minimum(depth, 2)
        return byte, self.bits[place], slots, gate.astype(np.int32)


def stretched(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Log odds of a one, drawn to even odds where little was seen."""
    return np.log((ones + 0.4) / (all_ - ones + 0.4), dtype=np.float32)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """Gated weights over the predictors, learned online, and the adaptive table behind them."""

    def __init__(self) -> None:
        # two inputs per predictor: its log odds, and the same if the context was seen often
        self.weights = np.full((GATES, 2 * len(ORDERS)), 0.15, dtype=np.float64)
        self.hits, self.seen = np.zeros((GATES, BUCKETS)), np.zeros((GATES, BUCKETS))

    @staticmethod
    def inputs(ones: np.ndarray, all_: np.ndarray) -> np.ndarray:
        odds = stretched(ones, all_)
        return np.concatenate([odds, odds * (all_ > 30)])

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ji->i", self.weights[gate], x)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch: the gradient of the coding cost, each gate by its own mean."""
        p = squash(self.mixed(x, gate))
        slope = (bit - p) * weight
        mass = np.bincount(gate, weights=weight, minlength=GATES)
        for i in range(x.shape[0]):
            self.weights[:, i] += RATE * np.bincount(gate, weights=slope * x[i], minlength=GATES) / np.maximum(mass, 1e-9)
        flat = gate * BUCKETS + self.bucket(p)
        self.hits += np.bincount(flat, weights=weight * bit, minlength=GATES * BUCKETS).reshape(GATES, BUCKETS)
        self.seen += np.bincount(flat, weights=weight, minlength=GATES * BUCKETS).reshape(GATES, BUCKETS)

    @staticmethod
    def bucket(p: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(np.log(p / (1 - p)) * 2 + BUCKETS // 2), 0, BUCKETS - 1).astype(np.int64)

    def refined(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Probability of a one: the mean of the mix and of what came true at such a mix."""
        p = np.clip(squash(self.mixed(x, gate)), 1e-6, 1 - 1e-6)
        b = self.bucket(p)
        true = (self.hits[gate, b] + 4 * p) / (self.seen[gate, b] + 4)
        return np.clip((p + true) / 2, 1e-6, 1 - 1e-6)


# passes over the grams: one row per distinct gram with its training count, which stand for all bytes of the training texts


def byte_weights(grams: DataFrame) -> np.ndarray:
    """How often each byte is coded in training: 256 numbers."""
    out = np.zeros(256)
    for r in grams.groupBy((F.col("gram") % 256).alias("byte")).agg(F.sum("total").alias("n")).collect():
        out[r["byte"]] = r["n"]
    return out


def bit_counts(grams: DataFrame, speller: Speller) -> np.ndarray:
    """Counters [context length, slot, bit] over all bits of the training texts, each after the bytes before it, added up by Spark; their size is fixed."""
    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ORDERS), 2, SLOTS), dtype=np.float64)
        for own, weight in _batches(parts):
            owner, bit, slots, _ = speller.of_grams(own)
            for i in range(len(ORDERS)):
                for b in (0, 1):
                    some = bit == b
                    total[i, b] += np.bincount(slots[i][some], weights=weight[owner[some]], minlength=SLOTS)
        chunks = total.reshape(len(ORDERS), 2, -1, CHUNK)
        for i in range(len(ORDERS) * SLOTS // CHUNK):
            own = chunks[i // (SLOTS // CHUNK), :, i % (SLOTS // CHUNK)]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([packed(own.astype("<i8").ravel())], pa.binary())], names=["chunk", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        part = sum(unpacked(d, "<i8") for d in pdf.data).astype("<f4")
        return pd.DataFrame({"chunk": [pdf.chunk.iloc[0]], "data": [packed(part)]})

    sums = grams.select("gram", "total").where("total > 0").mapInArrow(tally, "chunk long, data binary").groupBy("chunk").applyInPandas(add, "chunk long, data binary")
    out = np.zeros((len(ORDERS) * SLOTS // CHUNK, 2, CHUNK), dtype=np.float32)
    for r in sums.collect():
        out[r["chunk"]] = unpacked(r["data"], "<f4").reshape(2, CHUNK)
    return out.transpose(1, 0, 2).reshape(2, len(ORDERS), SLOTS)


def _batches(parts: Iterator[pa.RecordBatch], size: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts in portions of bounded size."""
    for part in parts:
        grams, weight = part.column(0).to_numpy().astype(np.uint64), part.column(1).to_numpy().astype(np.float64)
        for a in range(0, len(grams), size):
            yield grams[a:a + size], weight[a:a + size]


def _looked_up(tables: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    zeros = np.stack([tables[0, i][s] for i, s in enumerate(slots)])
    ones = np.stack([tables[1, i][s] for i, s in enumerate(slots)])
    return ones, zeros + ones


def learned(grams: DataFrame, speller: Speller, tables) -> Mixer:
    """Weights and adaptive table: each task learns in steps over its grams, the mean by coded bits is taken.

    A gram is predicted from the counts without one of its own occurrences, so that weights are fit to unseen text.
    """
    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, mass = Mixer(), 0.0
        for own, weight in _batches(parts):
            owner, bit, slots, gate = speller.of_grams(own)
            w = weight[owner]
            ones, all_ = _looked_up(tables.value, slots)
            x = mixer.inputs(np.maximum(ones - bit, 0), np.maximum(all_ - 1, 0))
            for a in range(0, len(bit), BATCH):
                s = slice(a, a + BATCH)
                mixer.learn(x[:, s], gate[s], bit[s].astype(np.float64), w[s])
            mass += w.sum()
        if mass:
            values = np.concatenate([mixer.weights.ravel() * mass, mixer.hits.ravel(), mixer.seen.ravel(), [mass]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

    rows = grams.select("gram", "total").where("total > 0").mapInArrow(fit, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    mixer = Mixer()
    if rows:
        values = np.array([v for _, v in sorted((r["i"], r["v"]) for r in rows)])
        n, m = mixer.weights.size, mixer.hits.size
        mixer.weights = values[:n].reshape(mixer.weights.shape) / values[-1]
        mixer.hits, mixer.seen = values[n:n + m].reshape(mixer.hits.shape), values[n + m:n + 2 * m].reshape(mixer.hits.shape)
    return mixer


# reading the texts in order


class Finder:
    """Places of numbers in a list of distinct ones that holds them all."""

    def __init__(self, known: np.ndarray):
        self.order = None if (known[1:] > known[:-1]).all() else np.argsort(known, kind="stable")
        self.known = known if self.order is None else known[self.order]
        self.shift = np.uint64(64 - max(4, (2 * len(known)).bit_length()))
        self.table = np.zeros(1 << int(64 - self.shift), dtype=np.int32)
        self.table[self.slot(self.known)] = np.arange(len(known), dtype=np.int32)

    def slot(self, values: np.ndarray) -> np.ndarray:
        return (values * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        at = self.table[self.slot(values)]
        # those that share a slot with another are searched for
        other = np.flatnonzero(self.known[at] != values)
        at[other] = np.searchsorted(self.known, values[other])
        return at if self.order is None else self.order[at]


class Spells:
    """Natural logarithms of the probabilities of the last bytes of grams after the others. Each distinct gram is spelled once and kept in a hashed table."""

    def __init__(self, speller: Speller, tables: np.ndarray, mixer: Mixer):
        self.speller, self.tables, self.mixer = speller, tables, mixer
        self.grams, self.logs, self.n = np.zeros(0, np.uint64), np.zeros(0, np.float32), 0
        self.table = np.full(1 << 4, -1, dtype=np.int32)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def spelled(self, grams: np.ndarray, size: int = 1 << 14) -> np.ndarray:
        out = np.empty(len(grams), np.float32)
        for a in range(0, len(grams), size):
            owner, bit, slots, gate = self.speller.of_grams(grams[a:a + size])
            p = self.mixer.refined(self.mixer.inputs(*_looked_up(self.tables, slots)), gate)
            out[a:a + size] = np.bincount(owner, weights=np.log(np.where(bit, p, 1 - p)), minlength=len(out[a:a + size]))
        return out

    def settled(self, first: int) -> None:
        """Give the grams from ``first`` on their slots, the next free ones where others hold them."""
        place = np.arange(first, self.n, dtype=np.int32)
        slot = self.slot(self.grams[first:self.n])
        while len(place):
            free = self.table[slot] < 0
            self.table[slot[free]] = place[free]
            left = self.table[slot] != place
            place, slot = place[left], (slot[left] + 1) & (len(self.table) - 1)

    def keep(self, new: np.ndarray) -> None:
        first, self.n = self.n, self.n + len(new)
        if self.n > len(self.grams):
            more = max(self.n, len(self.grams) * 3 // 2) - first
            self.grams = np.concatenate([self.grams[:first], np.zeros(more, np.uint64)])
            self.logs = np.concatenate([self.logs[:first], np.zeros(more, np.float32)])
        self.grams[first:self.n], self.logs[first:self.n] = new, self.spelled(new)
        if 2 * self.n > len(self.table):
            self.table, first = np.full(1 << (2 * self.n).bit_length(), -1, dtype=np.int32), 0
        self.settled(first)

    def of(self, grams: np.ndarray) -> np.ndarray:
        slot = self.slot(grams)
        at = self.table[slot]
        if self.n:
            other = np.flatnonzero(self.grams[at] != grams)
            other = other[at[other] >= 0]
            slot = slot[other]
            while len(other):
                slot = (slot + 1) & (len(self.table) - 1)
                at[other] = here = self.table[slot]
                on = (here >= 0) & (self.grams[here] != grams[other])
                other, slot = other[on], slot[on]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, back = np.unique(grams[missing], return_inverse=True)
            at[missing] = self.n + back
            self.keep(new)
        return self.logs[at]


def followed(logs: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probabilities of tokens from those of the experts (a row each): shares start even in each text and follow how much each expert explained before the token."""
    most = logs.max(axis=0)
    likely = np.exp(logs - most)
    n, index = len(logs), np.arange(logs.shape[1]) - np.repeat(starts, sizes)
    shares = np.full(logs.shape, 1 / n)
    for _ in range(ROUNDS):
        part = shares * likely
        part /= part.sum(axis=0)
        past = np.cumsum(part, axis=1) - part
        shares = (EVEN / n + past - np.repeat(past[:, starts], sizes, axis=1)) / (EVEN + index)
        # rounding may leave less than nothing
        np.maximum(shares, EVEN / n / (EVEN + index) / 2, out=shares)
        shares /= shares.sum(axis=0)
    return most + np.log((shares * likely).sum(axis=0))


def scored(docs: DataFrame, key: str = "doc_id", buckets: int = 128) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row.

    ``buckets`` splits vocabulary, pairs and grams: one of them must fit a task, so a corpus with more distinct tokens takes more.
    """
    spark = docs.sparkSession
    blocks = stored(encode_blocks(docs, key, buckets))
    tokens = stored(tokens_told(blocks))
    known = [(unpacked(r["counts"], "<i8"), unpacked(r["others"], "<i8")) for r in tokens.where("block = -1").select("counts", "others").collect()]
    n_distinct, class_sums = int(sum(n[0] for n, _ in known)), sum((s for _, s in known), np.zeros(CLASSES, np.int64))
    n_train = int(class_sums.sum())
    grams = stored(gram_counts(blocks))
    speller = Speller(byte_weights(grams))
    # SLOTS counters per context length, whatever the corpus
    tables = spark.sparkContext.broadcast(bit_counts(grams, speller))
    mixer = learned(grams, speller, tables)
    told = tokens.where("block >= 0").union(pairs_told(blocks))
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    base, spelled = log10(n_train + n_distinct + 1), []

    def sum_up(block: pa.Table, parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("bucket")
        part = np.array(parts.column("part").to_pylist())

        def joined(name: str, which: int) -> np.ndarray:
            column = parts.column(name)
            return np.concatenate([unpacked(column[int(i)].as_py(), "<i8") for i in np.flatnonzero(part == which)])

        totals, by_class, follows = joined("counts", TOKENS), joined("others", TOKENS), joined("counts", PAIRS)
        # the next block of a task mostly has the same grams
        if not spelled or spelled[0].n > HELD_GRAMS:
            spelled[:] = [Spells(speller, tables.value, mixer)]
        spells = spelled[0]
        keys, held, sizes, n_bytes = (block.column(c).combine_chunks().flatten() for c in ("keys", "held", "sizes", "bytes"))
        sizes = sizes.to_numpy().astype(np.int64)
        numbers, distinct, usual = (unpacked(block.column(c)[0].as_py(), "<i4") for c in ("numbers", "classes", "counts"))
        numbers = usual[numbers]
        vocabulary = zlib.decompress(block.column("values")[0].as_py()).split(b" ")
        bodies, hashes = spelled_out(vocabulary), token_hashes(vocabulary)
        length = lengths(bodies)
        token = distinct // CLASSES
        of_token = np.zeros(len(hashes), np.int64)
        of_token[token] = totals
        starts = np.cumsum(sizes) - sizes
        del vocabulary
        ids = token[numbers]
        pair = pair_keys(tokens_before(ids), ids, hashes, buckets)
        pair.sort()
        pairs = Finder(pair[np.concatenate([[True], pair[1:] != pair[:-1]])])
        del pair
        with np.errstate(divide="ignore"):
            in_class = np.log(by_class / np.maximum(class_sums[distinct % CLASSES], 1))
            overall = np.log(totals / max(n_train, 1))
        of_base, seen = np.log10(totals + 1.0) - base, (totals > 0).astype(np.int64)
        del by_class, totals
        n_known, base_score, log_p = (np.zeros(len(sizes)) for _ in range(3))
        # whole texts, a portion of bounded size where texts are no longer
        group = starts // PORTION
        cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            own = slice(starts[a], starts[b - 1] + sizes[b - 1])
            some, first, size = numbers[own], starts[a:b] - starts[a], sizes[a:b]
            logs = np.empty((4, len(some)))
            for piece, n, six in text_grams(ids[own], first, bodies, 1 << 14, length):
                logs[3, piece] = np.add.reduceat(spells.of(six), np.cumsum(n) - n, dtype=np.float64)
            last = tokens_before(ids[own])
            logs[0], logs[1] = in_class[some], overall[some]
            with np.errstate(divide="ignore"):
                logs[2] = np.log(np.maximum(follows[pairs.find(pair_keys(last, ids[own], hashes, buckets))] - LESS, 0) / np.maximum(of_token[last], 1))
            n_known[a:b] = np.add.reduceat(seen[some], first)
            base_score[a:b] = np.add.reduceat(of_base[some], first)
            log_p[a:b] = np.add.reduceat(followed(logs, first, size), first) / np.log(10)
        return pa.table([keys, held, pa.array(sizes), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(sizes), n_train, np.int64)), pa.array(base_score), pa.array(log_p), n_bytes,
                         pa.array(-log_p / log10(2) / n_bytes.to_numpy())],
                        names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    documents = blocks.where(F.col("part") == DOCS).select("block", "keys", "held", "sizes", "bytes", "numbers", "values", "classes", "counts")
    return documents.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        sum_up, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
