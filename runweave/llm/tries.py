"""A trie of conversations that share prefixes, from fingerprints that compose.

A conversation is rebuilt from the first turns of its base conversation (its *head*) and its own turns after as many (its
*suffix*). Nothing rebuilt is ever put together: fingerprints of parts are.

**Fingerprints.** A sequence of turns t_0 .. t_(n-1) has the fingerprint sum of t_k R^k, in two prime fields of 31 bits. Sequences
form a monoid under joining, and fingerprints follow: of head and suffix it is head + R^(length of the head) * suffix, and
a suffix that begins at turn h is (prefix(j) - prefix(h)) / R^h. So each depth of a rebuilt conversation has its fingerprint
from two prefix sums of stored conversations and, where the base is shorter than the head asked for, one of a few constant powers
of R. Word counts compose in the same way.

**Nodes.** Rows (conversation, depth, fingerprint, reference to the stored turn) are grouped by depth and fingerprint. Equality is
verified, not assumed: all stored turns of one hash must have one SHA-256 of role and text, and all members of a node must agree
in their parent's fingerprint and in the hash of the turn they refer to; by induction their sequences are equal. If anything
differs, hashes are taken again with another seed.

**Subtrees** need no walk. A node's least member is also the least one of its nodes further down, until that member ends; so each
conversation owns the nodes of one run of depths. A member's contribution to a node is what of its own path from there on it
shares with a lesser conversation (saved tokens), whether it owns a leaf, and whether it owns a child: one sum per node.

**Scale.** Prefix sums run in pieces of `PIECE` turns, so one conversation may be of any length; per-conversation columns go to its
turns by (conversation, piece). Nodes are aggregated map-side, so a first turn that a third of all conversations share is a few rows
in the shuffle. Parents with very many children are looked up by broadcast: at most `HOT_PARENTS` of them, by their count. Ids that
end at a node are packed into sorted pieces before they meet, and hashed as a stream.

**Cases.** A null role or text is empty; rows without conv_id take no part. Turns of equal number are in order of their SHA-256;
repeated rows are turns of their own. An absent base gives no head. A rebuilt conversation without turns is a member of the
root. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.storage import written

FIELDS = (2147483647, 2147483629)  # primes below 2^31
RADICES = (1_073_807_359, 1_431_699_961)
FAMILY = 20  # conversations from one multiple of this to the next have that one as base
HEADS = 4    # head lengths are below this
PIECE = 1 << 16  # turns of one conversation that are ordered in one task
HOT_PARENTS = 100_000
PACK = 1_024  # ids in one packed piece
SEED = 97
NODE = ("depth", "f0", "f1")


def _power(exponent: Column, field: int) -> Column:
    """RADICES[field] to the exponent, by squares."""
    p, squares, value = FIELDS[field], [], RADICES[field]
    for bit in range(40):
        squares.append(F.struct(F.lit(1 << bit).cast("bigint").alias("bit"), F.lit(value).cast("bigint").alias("value")))
        value = value * value % p
    return F.aggregate(F.array(*squares), F.lit(1).cast("bigint"), lambda power, x: F.when(
        exponent.bitwiseAND(x["bit"]) != 0, power * x["value"] % p).otherwise(power))


def stored_turns(conversations: DataFrame, seed: int = SEED, piece: int = PIECE) -> DataFrame:
    """Each turn at its place `i` of its conversation, and what the conversation comes to up to it.

    conv_id, i, digest, h0, h1 (its hash), words, e0, e1 and f0, f1 (fingerprints without and with it), all_words.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.expr(f"turn DIV {piece}"), F.lit(-(1 << 62))).alias("part"),
        F.unhex(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    for k, p in enumerate(FIELDS):
        rows = rows.withColumn(f"h{k}", F.pmod(F.xxhash64(F.lit(seed + k), "digest"), F.lit(p)))
    along = Window.partitionBy("conv_id", "part").orderBy("turn", "digest")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("j", F.row_number().over(along).cast("bigint") - 1)
    rows = rows.withColumns({f"t{k}": F.col(f"h{k}") * _power(F.col("j"), k) % p for k, p in enumerate(FIELDS)})
    rows = rows.withColumns({"v0": F.sum("t0").over(so_far) % FIELDS[0], "v1": F.sum("t1").over(so_far) % FIELDS[1], "w": F.sum("words").over(so_far)})
    # what each part comes to, and all parts before it
    parts = rows.groupBy("conv_id", "part").agg(
        F.count("*").alias("n"), F.max_by("v0", "j").alias("v0"), F.max_by("v1", "j").alias("v1"), F.sum("words").alias("w"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    parts = parts.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), none))
    for k, p in enumerate(FIELDS):
        parts = parts.withColumn(f"r{k}", _power(F.col("n_before"), k))
        parts = parts.withColumn(f"v{k}", F.coalesce(F.sum(F.col(f"r{k}") * F.col(f"v{k}") % p).over(earlier), none) % p)
    parts = parts.select("conv_id", "part", "n_before", "r0", "r1", F.col("v0").alias("b0"), F.col("v1").alias("b1"), F.coalesce(F.sum("w").over(earlier), none).alias("bw"))
    out = rows.join(parts, ["conv_id", "part"])
    made = {"i": F.col("n_before") + F.col("j"), "all_words": F.col("bw") + F.col("w")}
    for k, p in enumerate(FIELDS):
        made[f"f{k}"] = (F.col(f"b{k}") + F.col(f"r{k}") * F.col(f"v{k}") % p) % p
        made[f"e{k}"] = (F.col(f"b{k}") + F.col(f"r{k}") * F.pmod(F.col(f"v{k}") - F.col(f"t{k}"), F.lit(p)) % p) % p
    return out.select("conv_id", "digest", "h0", "h1", "words", *(c.cast("bigint").alias(n) for n, c in made.items()))


def rebuilding(turns: DataFrame) -> DataFrame:
    """One row per conversation: how it is rebuilt, in numbers.

    conv_id, n (stored turns), h (head asked for), taken (turns of the base's head), head0, head1, head_words, own0, own1,
    own_words (its own first h turns), length and total_words of what is rebuilt, and turns (array: the base's first ones).
    """
    kept = ("f0", "f1", "e0", "e1", "h0", "h1", "words", "all_words")
    # columns of the first turns, as longs: such an aggregate is combined map-side in hash tables
    firsts = {f"{c}_{k}": F.max(F.when(F.col("i") == k, F.col(c))) for k in range(HEADS - 1) for c in kept}
    convs = turns.groupBy("conv_id").agg(
        F.count("*").alias("n"), F.max("all_words").alias("stored_words"), *(c.alias(name) for name, c in firsts.items()))
    first = F.array(*(F.struct(*(F.col(f"{c}_{k}").alias(c) for c in kept)) for k in range(HEADS - 1)))
    convs = convs.select("conv_id", "n", "stored_words", first.alias("turns"))
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = convs.select("conv_id", "n", "stored_words", F.col("turns").alias("own"), asked.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = convs.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), "turns")
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint")))

    def upto(turns: str, count: str, field: str) -> Column:
        return F.when(F.col(count) == 0, F.lit(0).cast("bigint")).otherwise(F.get(turns, (F.col(count) - 1).cast("int"))[field])

    out = own.join(bases, "base", "left").withColumns({"taken": taken, "skipped": F.least("h", "n")})
    out = out.withColumns({
        "head0": upto("turns", "taken", "f0"), "head1": upto("turns", "taken", "f1"), "head_words": upto("turns", "taken", "all_words"),
        "own0": upto("own", "skipped", "f0"), "own1": upto("own", "skipped", "f1"), "own_words": upto("own", "skipped", "all_words"),
    })
    return out.select(
        "conv_id", "n", "h", "taken", "head0", "head1", "head_words", "own0", "own1", "own_words", "turns",
        (F.col("taken") + F.col("n") - F.col("skipped")).alias("length"),
        (F.col("head_words") + F.col("stored_words") - F.col("own_words")).alias("total_words"))


def _dealt(rows: DataFrame, last: Column, piece: int) -> DataFrame:
    """Rows of conversations once for each piece (`part`) of their turns, so that a long one is no single join key."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / piece).cast("bigint"))))


def steps(turns: DataFrame, plan: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per depth of each rebuilt conversation, the root's included.

    conv_id, depth, f0, f1, p0, p1 (the parent's), h0, h1, words (of the last turn), all_words (up to it), ends.
    """
    none = F.lit(0).cast("bigint")
    ends = (F.col("depth") == F.col("length")).cast("bigint").alias("ends")
    own = turns.withColumn("part", F.expr(f"i DIV {piece}")).join(
        _dealt(plan.filter("n > h").drop("turns", "total_words"), F.col("n") - 1, piece), ["conv_id", "part"]).filter("i >= h")
    composed = {"depth": F.col("i") - F.col("h") + F.col("taken") + 1, "all_words": F.col("head_words") + F.col("all_words") - F.col("own_words")}
    for k, p in enumerate(FIELDS):
        shifts = F.array(*(F.lit(pow(RADICES[k], -less, p)).cast("bigint") for less in range(HEADS)))
        shift = F.get(shifts, (F.col("h") - F.col("taken")).cast("int"))
        for out, prefix in ((f"f{k}", f"f{k}"), (f"p{k}", f"e{k}")):
            composed[out] = (F.col(f"head{k}") + F.pmod(F.col(prefix) - F.col(f"own{k}"), F.lit(p)) * shift % p) % p
    own = own.select("conv_id", "h0", "h1", "words", "length", *(c.alias(n) for n, c in composed.items()))
    heads = plan.filter("taken > 0").select("conv_id", "length", "taken", F.posexplode("turns").alias("k", "t")).filter("k < taken").select(
        "conv_id", "t.h0", "t.h1", "t.words", "length", (F.col("k") + 1).cast("bigint").alias("depth"), "t.all_words",
        "t.f0", "t.e0", "t.f1", "t.e1").withColumnsRenamed({"e0": "p0", "e1": "p1"})
    zeros = ("h0", "h1", "words", "depth", "all_words", "f0", "p0", "f1", "p1")
    roots = plan.select("conv_id", "length", *(none.alias(c) for c in zeros))
    every = own.unionByName(heads).unionByName(roots)
    return every.select("conv_id", "depth", "f0", "f1", "p0", "p1", "h0", "h1", "words", "all_words", ends)


def _verified(conversations: DataFrame, piece: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rebuilding plans, steps and nodes in which equal fingerprints are equal sequences."""
    for seed in range(SEED, SEED + 2 * 16, 2):
        turns = written(stored_turns(conversations, seed, piece))
        if turns.groupBy("h0", "h1").agg((F.min("digest") != F.max("digest")).alias("bad")).filter("bad").isEmpty():
            plan = written(rebuilding(turns))
            taken = written(steps(turns, plan, piece))
            agree = ("p0", "p1", "h0", "h1")
            nodes = written(taken.groupBy(*NODE).agg(
                F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("ends").alias("n_ends"), F.max("words").alias("words"),
                F.max("all_words").alias("all_words"), *(F.min(c).alias(c) for c in agree),
                sum((F.max(c) - F.min(c) for c in agree), F.lit(0)).alias("differs")))
            if nodes.filter("differs <> 0").isEmpty():
                return plan, taken, nodes.drop("differs")
    raise RuntimeError("hashes of turns collide with every seed")


def _ending(taken: DataFrame) -> DataFrame:
    """NODE, ends_sha256: the hash of the ids that end at each node, ascending, comma-joined."""
    names = [*NODE, "first", "ids"]

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # ids of the node that goes on
        node = None

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.string())], names)

        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            for at, conv in zip(zip(*columns[:3]), columns[3]):
                if held and (at != node or len(held) == PACK):
                    rows.append((*node, held[0], ",".join(map(str, held))))
                    held = []
                node = at
                held.append(conv)
            if rows:
                yield packed(rows)
        if held:
            yield packed([(*node, held[0], ",".join(map(str, held)))])

    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def told(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[0][k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[1] for r in rows], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            rows = []
            columns = [c.to_pylist() for c in batch.columns]
            for at, ids in zip(zip(*columns[:3]), columns[4]):
                if at == node:
                    state.update(b",")
                else:
                    if node is not None:
                        rows.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256()
                state.update(ids.encode())
            if rows:
                yield told(rows)
        if node is not None:
            yield told([(node, state.hexdigest())])

    schema = "depth bigint, f0 bigint, f1 bigint"
    ends = taken.filter("ends = 1").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = ends.mapInArrow(packing, f"{schema}, first bigint, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashing, f"{schema}, ends_sha256 string")


def trie(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_ends."""
    plan, taken, nodes = _verified(conversations, piece)
    # the run of depths whose nodes a conversation owns, what it shares with lesser ones, and whether it owns a leaf
    runs = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("since"), F.min(F.col("all_words") - F.col("words")).alias("shared"),
        F.max((F.col("n_convs") == F.col("n_ends")).cast("bigint")).alias("leaf"))
    owned = plan.select("conv_id", "length", "total_words").join(runs, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("since", F.col("length") + 1).alias("since"),
        F.coalesce("shared", "total_words").alias("shared"), F.coalesce("leaf", F.lit(0).cast("bigint")).alias("leaf"))
    paths = taken.withColumn("part", F.expr(f"depth DIV {piece}")).join(_dealt(owned, F.col("length"), piece), ["conv_id", "part"])
    below = F.col("shared") - (F.col("all_words") - F.col("words"))
    child = (F.col("since") <= F.col("depth") + 1) & (F.col("length") > F.col("depth"))
    sums = paths.groupBy(*NODE).agg(
        F.sum(F.greatest(below, F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"),
        F.sum(child.cast("bigint")).alias("n_children"), F.min_by("since", "conv_id").alias("since"))
    full = written(nodes.join(sums, list(NODE)))
    # a node further down a run has its own conversation as parent; the first of a run looks its parent up
    firsts = full.filter("depth > 0 and depth = since").select(*NODE, "p0", "p1")
    hot = max(1_000, firsts.count() // HOT_PARENTS)
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("f0").alias("p0"), F.col("f1").alias("p1"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    key = ["depth", "p0", "p1"]
    of_hot = F.broadcast(parents.filter(F.col("n_children") > hot).drop("n_children"))
    of_rest = parents.filter(F.col("n_children") <= hot).drop("n_children")
    found = firsts.join(of_hot, key).unionByName(firsts.join(of_hot, key, "left_anti").join(of_rest, key)).select(*NODE, "parent_conv_id")
    out = full.join(found, list(NODE), "left").join(_ending(taken), list(NODE), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "n_ends")


def digest(conversations: DataFrame) -> DataFrame:
    """The nodes as a query returns them."""
    return trie(conversations).drop("n_ends")
