"""Trie of conversation prefixes, built by van Emde Boas recursion over the depth.

Sequences of turns lie in a forest; at first all of them in one, under the root. A step halves the
height: every sequence longer than half of it is cut there. The cut prefix gets a name, made of its
forest and its turns, and is merged with equal ones (upper trie); what comes after it is a sequence
of the forest below that name (lower forest). Upper and lower sequences are half as high and go
through the next step together, in one table. When sequences have one turn, each is a node, and its
forest is its parent. A depth is cut in exactly one step, so each node has one name.

The steps leave pointers: ``hop`` from a name to the forest its cut prefix lay in (as many turns up
as the prefix was high), and ``mid`` from a name to the cut in the middle of its prefix. Totals are
grafted upward along them. Going through heights 1, 2, 4, ... names hand their sums to their hops;
then, from the greatest height down, a sum that is due to all turns of a prefix is split between the
name and its mid, until it is due to single nodes. Every step is a group-by or a join on names; the
work is in proportion to the trie times the logarithm of its depth. Each step is written to the
shared folder.

One conversation is one row: 32 digits for each turn, never its text.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.sources.stages import cut

ROOT = ""
CHUNK_IDS = 8_192  # conversation numbers in a row of text
SUMS = ("leaves", "saved")


def _digest(text: Column) -> Column:
    """128 bits of a SHA-256, as digits."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of each conversation: digest of role and text, and number of words, of each turn.

    Turns come by number, NULL first; equal numbers by role, then digest. NULL role or text counts as
    empty. Rows without a conv_id belong to no conversation. Texts are read once and never shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").alias("turn"), role.alias("role"),
            _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("d"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(
        F.sort_array(F.collect_list("t")), lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("turns"))


def _add(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _cut_in_half(rows: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """One step: the table of upper and lower sequences, and the pointers it leaves."""
    prefix = F.slice("turns", 1, half)
    named = rows.withColumns({
        "prefix": prefix, "whole": F.size("turns") <= half,
        "key": _digest(F.concat_ws("|", "base", "forest", F.array_join(F.transform(prefix, lambda t: t["d"]), "")))})
    upper = named.groupBy("base", "forest", "key").agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.first("prefix").alias("turns"),
        F.max(F.when(F.col("whole"), F.col("ending"))).alias("ending"))
    upper = upper.withColumn("name", F.when(F.size("turns") == half, F.col("key"))).drop("key")
    lower = named.filter(~F.col("whole")).select(
        (F.col("base") + half).alias("base"), F.col("key").alias("forest"), "conv", "n",
        F.slice("turns", half + 1, F.size("turns")).alias("turns"), "ending", "name")
    table = cut(_add(upper, lower))
    hops = table.filter(F.col("name").isNotNull() & (F.col("base") % (2 * half) == 0)).select(
        "name", F.col("forest").alias("hop"))
    mids = table.filter(F.col("name").isNotNull() & (F.col("base") % (2 * half) == half)).select(
        "name", F.col("forest").alias("mid"))
    return table, (hops, mids)


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(*[F.sum(c).alias(c) for c in SUMS])


def _grafted(own: DataFrame, pointers: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``name, leaves, saved``: sums of ``own`` over the subtree of each node.

    ``own`` has ``name, height`` (the step that named it, 0 for half height 1) and the values;
    ``pointers`` are those of the steps, by ascending height.
    """
    due, handed = [], own.filter("height < 0").select("name", *SUMS)
    for height, (hops, _) in enumerate(pointers):
        # What was handed up is joined with the names of this height; the rest waits for its own.
        here = _add(own.filter(F.col("height") == height).select("name", *SUMS), handed.join(hops, "name", "left_semi"))
        due.append(cut(_sums(here)))
        up = due[-1].join(hops, "name").filter(F.col("hop") != ROOT).select(F.col("hop").alias("name"), *SUMS)
        handed = cut(_sums(_add(handed.join(hops, "name", "left_anti"), up)))
    split = due[-1]
    for height in reversed(range(len(pointers) - 1)):
        middle = split.join(pointers[height][1], "name").select(F.col("mid").alias("name"), *SUMS)
        split = cut(_sums(_add(split, middle, due[height])))
    return split


# --- members that end in a node ------------------------------------------------------------

def _joined(batches):
    """Runs of conversation numbers of one sequence in a sorted partition, as bounded texts."""
    key, first, ids = None, None, []

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))])],
            ["ending", "first", "ids"])

    held = []
    for batch in batches:
        for ending, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (ending != key or len(ids) == CHUNK_IDS):
                held.append(row())
                ids = []
            if not ids:
                key, first = ending, conv_id
            ids.append(conv_id)
            if len(held) == 1000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
    if ids:
        held.append(row())
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _hashed(batches):
    """SHA-256 over the texts of each key of a sorted partition, one text at a time."""
    key, state = None, None
    for batch in batches:
        keys, shas = [], []
        for ending, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if ending == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                keys.append(key)
                shas.append(state.hexdigest())
            key, state = ending, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], ["ending", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["ending", "sha"])


def _members(rows: DataFrame) -> DataFrame:
    """``ending, sha``: digest of the ascending conversation numbers of each sequence.

    Numbers are sorted over ranges, which divide a sequence that very many share, and joined to texts of
    up to ``CHUNK_IDS`` numbers; only those texts of a sequence come to one task, which holds one at a time.
    """
    parts = rows.sparkSession.sparkContext.defaultParallelism
    texts = (rows.select("ending", "conv_id").repartitionByRange(parts, "ending", "conv_id")
             .sortWithinPartitions("ending", "conv_id").mapInArrow(_joined, "ending string, first long, ids string"))
    return (texts.repartition("ending").sortWithinPartitions("ending", "first")
            .mapInArrow(_hashed, "ending string, sha string"))


# --- the trie ------------------------------------------------------------------------------

def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences in ``convs`` (conv_id unique, turns).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (NULL for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (words that members need not repeat, over the
    subtree), ``ends_sha256`` (of the members that end there). Conversations without turns end in the
    root. An empty table has no node.
    """
    rows = cut(convs.select("conv_id", "turns", _digest(F.concat(
        F.lit("s"), F.array_join(F.transform("turns", lambda t: t["d"]), ""))).alias("ending")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.max(F.size("turns")).alias("depth"),
                     F.max(F.when(F.size("turns") == 0, F.col("ending"))).alias("ending")).first()
    table = rows.filter(F.size("turns") > 0).groupBy("ending").agg(
        F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("turns").alias("turns")).select(
        F.lit(0).alias("base"), F.lit(ROOT).alias("forest"), "conv", "n", "turns", "ending",
        F.lit(None).cast("string").alias("name"))
    pointers = []
    height = 1
    while height <= (total["depth"] or 0):
        height *= 2
    while height > 1:
        height //= 2
        table, pointer = _cut_in_half(table, height)
        pointers.append(pointer)
    pointers.reverse()
    counts = table.groupBy("forest").agg(F.count(F.lit(1)).alias("n_children"))
    depth = F.col("base") + 1
    nodes = cut(table.withColumn("depth", depth).join(
        counts.withColumnRenamed("forest", "name"), "name", "left").select(
        "name", "depth", F.col("forest").alias("parent"), "conv", "n", "ending",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.get("turns", F.lit(0))["w"]).alias("saved"),
        F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1).alias("height")))
    whole = nodes.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                      F.count_if(F.col("depth") == 1).alias("children")).first()
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    members = _members(rows)
    root = rows.sparkSession.range(1 if total["n"] else 0).select(*[
        F.lit(v).cast(k).alias(c) for c, v, k in (
            ("conv", total["conv"], "long"), ("depth", 0, "int"), ("parent_conv_id", None, "long"),
            ("n", total["n"], "long"), ("n_children", whole["children"], "long"),
            ("leaves", whole["leaves"] or 1, "long"), ("saved", whole["saved"] or 0, "long"),
            ("ending", total["ending"], "string"))])
    if pointers:
        totals = _grafted(nodes.select("name", "height", *SUMS), pointers)
        parents = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
        found = nodes.drop(*SUMS).join(totals, "name").join(parents, "parent", "left").withColumn(
            "parent_conv_id", F.when(F.col("parent") == ROOT, F.lit(total["conv"])).otherwise(F.col("parent_conv")))
        root = root.unionByName(found.select(*root.columns))
    return root.join(members, "ending", "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id",
        F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("sha", empty).alias("ends_sha256"))


# --- the registered query --------------------------------------------------------------------

def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations of the query's contract: the first turns, 0 to 3 of them, come from the first
    conversation of each twenty. ``convs`` as of :func:`sequences`, read twice: pass a stored table."""
    leader = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(20))
    first = convs.filter(F.pmod(F.col("conv_id"), F.lit(20)) == 0).select(
        F.col("conv_id").alias("leader"), F.slice("turns", 1, 3).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    return convs.withColumn("leader", leader).join(first, "leader", "left").select("conv_id", F.concat(
        F.coalesce(F.slice("lead", F.lit(1), h), F.slice("turns", 1, 0)),
        F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
