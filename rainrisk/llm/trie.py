"""Conversation prefix trie by bursting containers.

A node stands for a sequence of first turns. Equal conversations are one sequence with a count. All sequences start as one container of suffixes
under the root's head. A container with more turns than ``limit`` bursts: its head swallows the turns that all its suffixes share, and the suffixes move to a new
head for each next turn. Containers within the limit are dealt to shards by head, sorted, and swept into nodes one
after the other, so a task holds one small container at a time. A single sequence longer than the limit is all swallowed by its head. Sums over subtrees
go back up from the heads of each round to those that burst into them.

Turns are known by 128 bits of their hash, sequences by 128 bits over the hashes of turns and places.

Defined cases: turns sort by ``turn`` (null first), ties by role and text; a null role or text is an empty one. Rows without ``conv_id``
belong to no conversation. Repeated rows are turns of their own. Other columns are not read. An empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainrisk.llm.common import stored
from rainrisk.operators.scale import OrderedBlocks, attach, numbered

#: Turns that a container may hold when it is swept.
LIMIT = 50_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, tid, size): turns in order, each by the hash of its role and text, with the text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tid = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    known = (rows.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
             .withColumns({"tid": tid, "size": F.octet_length("text").cast("long"), "at": F.coalesce(F.col("turn").cast("string"), F.lit("-"))}))
    slim = stored(known.drop("text"))
    tied = stored(slim.groupBy("conv_id", "at").agg(F.count_distinct("tid").alias("n")).where("n > 1"))
    if tied.isEmpty():
        slim = slim.withColumn("tie", F.lit(""))
    else:
        # only turns that share their number need the text itself for their order
        texts = attach(known.select("conv_id", "at", "tid", "text"), tied.select("conv_id", "at"), ["conv_id", "at"], "inner")
        tie = texts.select("conv_id", "at", "tid", F.col("text").alias("tie")).dropDuplicates(["conv_id", "at", "tid"])
        slim = stored(slim.join(tie, ["conv_id", "at", "tid"], "left"))
    return stored(numbered(slim, ["conv_id"], ["turn", "role", "tie"], "pos").select("conv_id", "pos", "tid", "size"))


def rebuilt(own: DataFrame, family: int = 5, span: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of the eldest of their family: their turns (conv_id, pos, tid, size), and (conv_id, len) of all, turnless too."""
    lens = stored(own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    ids = lens.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % span, "base": F.expr(f"conv_id - conv_id % {family}")})
    known = lens.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = stored(ids.join(known, "base", "left").select("conv_id", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head")))
    # a family has few members, each takes less than ``span`` turns
    first = own.where(f"pos < {span}").withColumnRenamed("conv_id", "base").join(plan.where("head > 0").select("conv_id", "base", "head"), "base").where("pos <= head")
    rest = attach(own, plan.select("conv_id", "h", "head"), ["conv_id"], "inner").where("pos > h").withColumn("pos", F.expr("pos - h + head"))
    cols = ["conv_id", "pos", "tid", "size"]
    return stored(first.select(*cols).union(rest.select(*cols))), plan.select("conv_id", F.expr("head + greatest(n - h, 0)").alias("len"))


def ends(members: DataFrame) -> DataFrame:
    """(sa, sb, len, ends): hash over the comma-joined ids of each sequence with several members; ids are joined in ordered blocks, then streamed."""
    keys = ["sa", "sb", "len"]
    blocks = OrderedBlocks.of(members, keys, ["conv_id"]).rows
    ids = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")))
    parts = stored(blocks.groupBy(*keys, "_block").agg(ids.alias("ids")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key == at:
                    state.update(b"," + ids.encode())
                    continue
                if at:
                    done.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            if done:
                yield out(done)
                done = []
        if at:
            yield out([(*at, state.hexdigest())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*keys, "ends"])

    ordered = parts.repartition(*keys).sortWithinPartitions(*keys, "_block").select(*keys, "ids")
    return ordered.mapInArrow(stream, "sa long, sb long, len long, ends string")


def sequences(steps: DataFrame, lens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (conv: smallest member, n members, len, ends) and their turns (conv, pos from 0, tid, size); place 0 is the textless root's."""
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), "pos", "tid")).alias(name) for k, name in enumerate(("sa", "sb"))]
    known = steps.groupBy("conv_id").agg(*lanes)
    every = stored(lens.join(known, "conv_id", "left").select("conv_id", "len", F.coalesce("sa", F.lit(0)).alias("sa"), F.coalesce("sb", F.lit(0)).alias("sb")))
    counted = stored(every.groupBy("sa", "sb", "len").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n")))
    several = counted.where("n > 1")
    shared = stored(ends(attach(every, several.select("sa", "sb", "len"), ["sa", "sb", "len"], "inner")))
    found = stored(counted.where("n = 1").withColumn("ends", F.sha2(F.col("conv").cast("string"), 256)).unionByName(several.join(shared, ["sa", "sb", "len"])).drop("sa", "sb"))
    own = attach(steps.withColumnRenamed("conv_id", "conv"), found.select("conv"), ["conv"], "inner").select("conv", "pos", "tid", "size")
    roots = found.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("tid"), F.lit(0).cast("long").alias("size"))
    return found, stored(own.union(roots))


@dataclass
class Round:
    """Heads that burst in one round, and the chains of turns that they swallowed."""

    heads: DataFrame
    chains: DataFrame


def child(head: str, tid: str):
    return F.unhex(F.substring(F.sha2(F.concat(F.col(head), F.col(tid)), 256), 1, 32))


def burst(found: DataFrame, steps: DataFrame, limit: int) -> tuple[DataFrame, list[Round]]:
    """Suffixes (conv, n, len, ends, head, depth, up, upconv) of containers within the limit, and the rounds of those beyond it.

    A suffix starts after ``depth`` turns; ``up`` is the head that burst into its own, ``upconv`` the conversation that names that one.
    """
    root = {"head": F.lit(b"\x00" * 16), "depth": F.lit(0).cast("long"), "up": F.lit(None).cast("binary"), "upconv": F.lit(None).cast("long")}
    todo, small, rounds = stored(found.withColumns(root)), [], []
    while True:
        sums = stored(todo.groupBy("head").agg(F.count(F.lit(1)).alias("seqs"), F.sum(F.col("len") - F.col("depth") + 1).alias("turns"), F.min("conv").alias("name"), F.sum("n").alias("n_convs")))
        marked = stored(attach(todo, sums.select("head", (F.col("turns") > limit).alias("big"), "seqs", "name", "n_convs"), ["head"], "inner"))
        small.append(marked.where("NOT big").drop("big", "seqs", "name", "n_convs"))
        big = marked.where("big")
        if big.isEmpty():
            break
        # how many turns do all suffixes of a head share?
        where = attach(steps, big.select("conv", "head", "depth", "seqs"), ["conv"], "inner").where("pos >= depth")
        places = stored(where.groupBy("head", "pos").agg((F.count(F.lit(1)) < F.first("seqs")).alias("short"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.min("size").alias("size")))
        stops = places.groupBy("head").agg(F.coalesce(F.min(F.when(F.col("short") | (F.col("lo") != F.col("hi")), F.col("pos"))) - 1, F.max("pos")).alias("stop"))
        chains = stored(attach(places.select("head", "pos", "size"), stored(stops), ["head"], "inner").where("pos <= stop"))
        total = chains.groupBy("head").agg(F.sum("size").alias("chain"), F.max("stop").alias("stop"))
        heads = big.groupBy("head").agg(*[F.first(c).alias(c) for c in ("depth", "up", "upconv", "name", "n_convs")])
        heads = stored(heads.join(total, "head"))
        moved = stored(attach(big.drop("up", "upconv", "depth", "big", "seqs", "n_convs"), heads.select("head", "stop"), ["head"], "inner"))
        enders = moved.where("len = stop").select("head", "ends")
        heads = stored(heads.join(enders, "head", "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))))
        rounds.append(Round(heads, chains))
        following = attach(steps, moved.where("len > stop"), ["conv"], "inner").where("pos = stop + 1")
        todo = stored(following.select("conv", "n", "len", "ends", child("head", "tid").alias("head"), F.col("pos").alias("depth"), F.col("head").alias("up"), F.col("name").alias("upconv")))
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    return out, rounds


def sweep(rows: list[tuple], depth: int, upconv: int | None) -> list[tuple]:
    """Nodes of one container, its head first. Rows are (conv, n, ends, tids, sizes) of its suffixes; the first turn of each is the head's own."""
    rows.sort(key=lambda r: r[3])
    out: list[list] = []
    path: list[int] = []  # open nodes from the head down
    before: list[bytes] = []
    # fields: conv, depth, parent's place, members, children, leaves, saved, ends, bytes

    def close(to: int) -> None:
        while len(path) > to:
            node = out[path.pop()]
            node[5] += node[4] == 0
            node[6] += (node[3] - 1) * node[8]
            if path:
                up = out[path[-1]]
                up[0], up[3], up[4], up[5], up[6] = min(up[0], node[0]), up[3] + node[3], up[4] + 1, up[5] + node[5], up[6] + node[6]

    for conv, n, ends, tids, sizes in rows:
        same = 0
        while same < min(len(before), len(tids)) and before[same] == tids[same]:
            same += 1
        close(same)
        for k in range(same, len(tids)):
            out.append([conv, depth + k, path[-1] if path else None, 0, 0, 0, 0, EMPTY, sizes[k]])
            path.append(len(out) - 1)
        # a sequence that starts another one sorts before it
        last = out[path[-1]]
        last[0], last[3], last[7], before = min(last[0], conv), last[3] + n, ends, tids
    close(0)
    return [(c, d, upconv if up is None else out[up][0], n, kids, leaves, saved, ends) for c, d, up, n, kids, leaves, saved, ends, _ in out]


def swept(small: DataFrame, steps: DataFrame) -> DataFrame:
    """Nodes of all containers within the limit, with the ``head`` and ``up`` of those that are heads themselves."""
    last = F.col("pos") == F.col("len")
    rows = (attach(steps, small, ["conv"], "inner").where("pos >= depth")
            .select("head", "conv", "pos", "tid", "size", "depth", "up", "upconv", F.when(last, F.col("n")).alias("n"), F.when(last, F.col("ends")).alias("ends")))
    shards = rows.repartition("head").sortWithinPartitions("head", "conv", "pos")
    kinds = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
             ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("head", pa.binary()), ("up", pa.binary())]

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, info, own, done = None, None, [], []

        def finish() -> None:
            depth, up, upconv = info
            nodes = sweep(own, depth, upconv)
            done.extend([(*nodes[0], at, up), *((*x, None, None) for x in nodes[1:])])

        for batch in batches:
            p = batch.to_pydict()
            for head, conv, tid, size, depth, up, upconv, n, ends in zip(*(p[c] for c in ("head", "conv", "tid", "size", "depth", "up", "upconv", "n", "ends"))):
                if head != at:
                    if at is not None:
                        finish()
                    at, info, own, current = head, (depth, up, upconv), [], None
                if conv != current:
                    current, tids, sizes = conv, [], []
                tids.append(tid)
                sizes.append(size)
                if n is not None:
                    own.append((conv, n, ends, tids, sizes))
            if len(done) >= 10_000:
                yield table(done)
                done = []
        if at is not None:
            finish()
        if done:
            yield table(done)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])

    return shards.mapInArrow(containers, NODE + ", head binary, up binary")


def trie(rows: DataFrame, limit: int = LIMIT, family: int = 5, span: int = 9) -> DataFrame:
    """Nodes of the trie over the rebuilt conversations of ``rows`` (conv_id, turn, role, text)."""
    found, steps = sequences(*rebuilt(turns(rows), family, span))
    small, rounds = burst(found, steps, limit)
    nodes = stored(swept(small, steps))
    names = [c.strip().split()[0] for c in NODE.split(",")]
    out, below = nodes.select(*names), nodes.where("head IS NOT NULL").select("head", "up", "n_leaves", "saved_tokens")
    for turn in reversed(rounds):
        sums = below.where("up IS NOT NULL").groupBy(F.col("up").alias("head")).agg(
            F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        heads = stored(turn.heads.join(sums, "head", "left").withColumns({
            "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))}))
        below = stored(below.union(heads.select("head", "up", "n_leaves", F.expr("saved + (n_convs - 1) * chain"))))
        upto = OrderedBlocks.of(turn.chains.select("head", "pos", "size"), ["head"], ["pos"]).cumulative({"before": ("sum", F.col("size"), False)})
        places = attach(upto, heads, ["head"], "inner")
        last = F.col("pos") == F.col("stop")
        out = out.union(stored(places.select(
            F.col("name").alias("conv_id"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("upconv")).otherwise(F.col("name")).alias("parent_conv_id"),
            "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
            F.expr("saved + (n_convs - 1) * (chain - before)").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"))))
    return out
