"""Trie of conversation prefixes, with subtree totals by centroid decomposition.

A node is a distinct sequence of first turns (role, text); its name is (smallest conversation that starts with it,
depth). Prefixes are told apart by 128 bits: the exclusive or of a hash of every turn at its depth, carried along
a conversation by an ordered scan over ranges, so no conversation is gathered in one task.

Totals over subtrees come from the decomposition of the parent-edge forest. The weight of a node is the number of
conversations through it, so the weight of a whole subtree is known from the grouping that makes the nodes (turns left,
added over its members). Each component is cut at its centroid, the deepest node whose part of the component weighs
more than half. What lies below the centroid is added up and given to every node on the path from the centroid to the
component's top; the parts go on as components of at most half the weight, so rounds grow with the logarithm of the
weight, also for a chain as deep as the table is long. Components of at most ``LOCAL`` weight (hence nodes) are
finished in the tasks, many at once on arrays; heavier ones are cut by joins and written once per round.

Whether a node lies below a centroid is asked once per component and chain (nodes of the same smallest
conversation): that conversation has one node at the centroid's depth. The path upwards is that of the centroid's own
smallest conversation.

Defined results: rows without conversation id belong to none and are left out; NULL role or text counts as empty;
turns are ordered by turn (NULL first), equal ones by the MD5 of role and text, repeated rows are turns of their own;
a conversation that is rebuilt without turns is a member of the root only; an empty table has no nodes, not even a
root; very long texts are hashed where they are read and never moved; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from underwrite.operators import scan
from underwrite.session import materialize

#: Components of at most this weight are finished inside a task.
LOCAL = 4096
#: Nodes a task works on at once; a component is never cut by it.
BATCH = 65_536
#: Conversation ids joined to one string before a node's digest.
ID_BLOCK = 4096

BLOCK, HEADS = 100, 6


def placed_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 1), n_own (turns of the conversation), a, b (MD5 of role and text as two numbers), chars of every turn."""
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    by = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.char_length(said).cast("long").alias("chars")
    )
    rows = rows.select(
        "conv", "turn", "chars", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("a"),
        F.conv(F.substring("digest", 16, 15), 16, 10).cast("long").alias("b"),
    )
    rows = scan.row_numbers(materialize(rows, "trie-turns"), ["conv"], ["turn", "a"], "pos", "n_own")
    return rows.select("conv", "pos", "n_own", "a", "b", "chars")


def rebuild(placed: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after the shared starts: conversation c begins with the first h turns of c - c % block,
    h = crc32(c) % heads, then come its own turns after its first h.

    Returns turns (conv, depth, length, a, b, chars) and conversations (conv, length).
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    base = (F.col("conv") - F.col("conv") % block).alias("base")
    starts = placed.where((F.col("conv") % block == 0) & (F.col("pos") < heads))
    counts = starts.where("pos = 1").select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    length = F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))

    def with_start(rows: DataFrame) -> DataFrame:
        joined = rows.select("*", h, base).join(counts, "base", "left")
        joined = joined.withColumn("taken", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))))
        return joined.withColumn("length", length)

    convs = materialize(with_start(placed.where("pos = 1").select("conv", "n_own")).select("conv", "base", "h", "length"), "trie-convs")
    shared = starts.select(F.col("conv").alias("base"), "pos", "a", "b", "chars")
    first = convs.join(shared, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "length", "a", "b", "chars")
    own = with_start(placed).where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "length", "a", "b", "chars")
    return first.unionByName(own), convs.select("conv", "length")


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (m, d, pm, n, s, leaf, saved, n_children) and steps (conv, depth, length, owner, parent)."""
    own = [F.xxhash64(F.lit(i), F.col("depth"), F.col("a"), F.col("b")).alias(f"v{i}") for i in (1, 2)]
    hashed = materialize(turns.select("conv", "depth", "length", "chars", *own), "trie-rebuilt")
    ran = scan.running_xor(scan.with_range(hashed, ["depth", "v1"]), ["conv"], ["depth"], {"p1": F.col("v1"), "p2": F.col("v2")})
    before = [F.col(f"p{i}").bitwiseXOR(F.col(f"v{i}")).alias(f"q{i}") for i in (1, 2)]
    rows = materialize(ran.select("conv", "depth", "length", "chars", "p1", "p2", *before), "trie-prefixes")
    weigh = F.sum(F.col("length") - F.col("depth") + 1).alias("s")
    found = rows.groupBy(F.col("depth").alias("d"), "p1", "p2").agg(
        F.min("conv").alias("m"), F.count(F.lit(1)).alias("n"), weigh, F.min("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2")
    )
    top = convs.agg(F.min("conv").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") + 1).alias("s")).where("n > 0")
    zero = F.lit(0).cast("long")
    root = top.select(zero.alias("d"), zero.alias("p1"), zero.alias("p2"), "m", "n", "s", zero.alias("chars"), zero.alias("q1"), zero.alias("q2"))
    bare = materialize(found.unionByName(root), "trie-bare")
    above = bare.select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("m").alias("pm"))
    linked = materialize(bare.join(above, ["d", "q1", "q2"], "left"), "trie-linked")
    children = linked.where("d > 0").groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = linked.join(children, ["m", "d"], "left").select(
        "m", "d", "pm", "n", "s", F.coalesce("n_children", zero).alias("n_children"), F.isnull("n_children").cast("long").alias("leaf"),
        ((F.col("n") - 1) * F.col("chars")).alias("saved"),
    )
    steps = rows.select("conv", F.col("depth").alias("d"), "length", "p1", "p2").join(linked.select("d", "p1", "p2", "m", "pm"), ["d", "p1", "p2"])
    return materialize(nodes, "trie-nodes"), materialize(steps.select("conv", F.col("d").alias("depth"), "length", F.col("m").alias("owner"), F.col("pm").alias("parent")), "trie-steps")


def _forest(parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every node in a walk that visits a node before what lies below it, and the nodes of its subtree."""
    n = len(parent)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    levels = np.split(by_depth, cuts)
    count = np.ones(n, dtype=np.int64)
    for level in reversed(levels):
        held = level[parent[level] >= 0]
        np.add.at(count, parent[held], count[held])
    siblings = np.argsort(parent, kind="stable")
    upto = np.cumsum(count[siblings]) - count[siblings]
    first = np.ones(n, dtype=bool)
    first[1:] = parent[siblings][1:] != parent[siblings][:-1]
    offset = np.empty(n, dtype=np.int64)
    offset[siblings] = upto - np.repeat(upto[first], np.diff(np.append(np.flatnonzero(first), n)))
    enter = offset.copy()
    for level in levels:
        held = level[parent[level] >= 0]
        enter[held] = enter[parent[held]] + 1 + offset[held]
    return enter, count


def roll_up(component: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of each row of ``values`` over the subtree of every node, by centroids, for many components at once.

    ``parent`` is the position of the parent, -1 for the top of a component; ``weight`` the weight of the subtree.
    """
    enter, count = _forest(parent, depth)
    total = np.zeros_like(values)
    at, component, weight = np.arange(len(parent)), component.copy(), weight.copy()
    while len(at):
        k = int(component.max()) + 1
        heaviest = np.zeros(k, dtype=np.int64)
        np.maximum.at(heaviest, component, weight)
        over = np.flatnonzero(2 * weight > heaviest[component])
        least = np.full(k, np.iinfo(np.int64).max)
        np.minimum.at(least, component[over], weight[over])
        chosen = over[weight[over] == least[component[over]]]
        centre = np.empty(k, dtype=np.int64)
        centre[component[chosen]] = chosen
        c = centre[component]
        inside = (enter[at] >= enter[at][c]) & (enter[at] < enter[at][c] + count[at][c])
        on_path = (enter[at] <= enter[at][c]) & (enter[at][c] < enter[at] + count[at])
        itself = inside & on_path
        below = np.zeros((len(values), k), dtype=values.dtype)
        for row, sums in zip(values, below):
            np.add.at(sums, component[inside], row[at[inside]])
        total[:, at[on_path]] += below[:, component[on_path]]
        weight = weight - np.where(on_path, weight[c], 0)
        # Below the centroid a part is named by its top, the child whose visit came last; the rest keeps its name.
        tops = np.flatnonzero((parent[at] == at[c]) & inside & ~itself)
        span = len(parent) + 1
        tops = tops[np.argsort(component[tops] * span + enter[at[tops]])]
        under = np.flatnonzero(inside & ~itself)
        last = np.searchsorted(component[tops] * span + enter[at[tops]], component[under] * span + enter[at[under]], side="right") - 1
        name = component.copy()
        name[under] = k + last
        rest = ~itself
        _, component = np.unique(name[rest], return_inverse=True)
        at, weight = at[rest], weight[rest]
    return total


def _finish(parts: DataFrame) -> DataFrame:
    """m, d, leaf, saved: totals of every node inside its component."""

    def work(t: pa.Table) -> pa.RecordBatch:
        m, d, pm, s, tm, td = (t[c].to_numpy() for c in ("m", "d", "pm", "s", "tm", "td"))
        component = np.cumsum(np.append(True, (tm[1:] != tm[:-1]) | (td[1:] != td[:-1]))) - 1
        chains, code = np.unique(np.concatenate([m, pm]), return_inverse=True)
        width = int(d.max()) + 2
        name, above = code[: len(m)] * width + d + 1, code[len(m) :] * width + d
        order = np.argsort(name)
        where = np.searchsorted(name[order], above)
        parent = order[np.minimum(where, len(m) - 1)]
        parent = np.where((name[parent] == above) & (component[parent] == component), parent, -1)
        total = roll_up(component, parent, d, s, np.stack([t["leaf"].to_numpy(), t["saved"].to_numpy()]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (m, d, *total)], names=["m", "d", "leaf", "saved"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                t = pa.Table.from_batches(held).combine_chunks()
                tm, td = t["tm"].to_numpy(), t["td"].to_numpy()
                other = np.flatnonzero((tm != tm[-1]) | (td != td[-1]))
                cut = int(other[-1]) + 1 if len(other) else 0  # the last component may go on in the next batch
                if cut:
                    yield work(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield work(pa.Table.from_batches(held))

    names = ["m", "d", "pm", "s", "tm", "td", "leaf", "saved"]
    dealt = parts.select(*names).withColumn("pm", F.coalesce("pm", "m")).repartition("tm", "td").sortWithinPartitions("tm", "td")
    return dealt.mapInArrow(run, "m long, d long, leaf long, saved long")


def subtree_totals(nodes: DataFrame, steps: DataFrame, local: int = LOCAL) -> DataFrame:
    """m, d, leaf, saved: sums over every node's subtree."""
    names = ["m", "d", "pm", "s", "tm", "td", "leaf", "saved"]
    first = nodes.where("d = 0").first()["m"]
    state = nodes.select("m", "d", "pm", "s", F.lit(first).cast("long").alias("tm"), F.lit(0).cast("long").alias("td"), "leaf", "saved")
    small, gains = [], []
    while True:
        weights = state.groupBy("tm", "td").agg(F.max("s").alias("w"))
        sized = materialize(state.join(weights, ["tm", "td"]), "trie-sized")
        small.append(sized.where(F.col("w") <= local).select(*names))
        heavy = sized.where(F.col("w") > local)
        if heavy.isEmpty():
            break
        marked = materialize(_cut(heavy, steps, first), "trie-cut")
        inside = marked.where("itself or below").groupBy("tm", "td").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        gains.append(marked.where("itself or above").select("tm", "td", "m", "d").join(inside, ["tm", "td"]).select("m", "d", "leaf", "saved"))
        state = marked.where("not itself").select(
            "m", "d", "pm", F.when(F.col("above"), F.col("s") - F.col("cs")).otherwise(F.col("s")).alias("s"),
            F.when(F.col("below"), F.col("om")).otherwise(F.col("tm")).alias("tm"),
            F.when(F.col("below"), F.col("cd") + 1).otherwise(F.col("td")).alias("td"), "leaf", "saved",
        )
    parts = small[0]
    for one in small[1:]:
        parts = parts.unionByName(one)
    out = _finish(parts)
    for one in gains:
        out = out.unionByName(one)
    return out.groupBy("m", "d").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))


def _cut(heavy: DataFrame, steps: DataFrame, first: int) -> DataFrame:
    """The nodes of heavy components with their centroid (cd, cs): itself, above (on the path to the top), below, and
    om, the smallest conversation of the part below it lies in."""
    over = heavy.where(F.col("s") * 2 > F.col("w")).groupBy("tm", "td").agg(F.min(F.struct("s", "m", "d")).alias("c"))
    centres = materialize(over.select("tm", "td", F.col("c.m").alias("cm"), F.col("c.d").alias("cd"), F.col("c.s").alias("cs")), "trie-centres")
    chains = heavy.groupBy("tm", "td", "m").agg(F.max("d").alias("last")).join(centres, ["tm", "td"]).where("last > cd")
    under = chains.select("tm", "td", "m", "cm", (F.col("cd") + 1).alias("depth")).join(steps.withColumnRenamed("conv", "m"), ["m", "depth"])
    under = under.where(F.col("parent") == F.col("cm")).select("tm", "td", "m", F.col("owner").alias("om"))
    path = centres.join(steps.withColumnRenamed("conv", "cm"), "cm").where("depth < cd and depth >= td").select(F.col("owner").alias("m"), F.col("depth").alias("d"))
    path = path.unionByName(centres.where("td = 0 and cd > 0").select(F.lit(first).alias("m"), F.col("td").alias("d")))
    marked = heavy.join(centres, ["tm", "td"]).join(under, ["tm", "td", "m"], "left").join(path.withColumn("above", F.lit(True)), ["m", "d"], "left")
    return marked.select(
        *heavy.columns, "cd", "cs", "om", ((F.col("m") == F.col("cm")) & (F.col("d") == F.col("cd"))).alias("itself"),
        F.coalesce("above", F.lit(False)).alias("above"), (F.col("om").isNotNull() & (F.col("d") > F.col("cd"))).alias("below"),
    )


def _ends_digest(ends: DataFrame) -> DataFrame:
    """m, d, ends_sha256: SHA-256 of the ids that end at a node, ascending, joined by commas.

    Ids are joined in blocks of neighbouring ids first; a node's blocks then pass one task in order, one string at a
    time, since SHA-256 has no other way.
    """
    block = F.floor(F.col("conv") / F.lit(ID_BLOCK)).cast("long")
    blocks = ends.groupBy("m", "d", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, sha256()
        for batch in batches:
            m, d, digests = [], [], []
            for key_m, key_d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if at == (key_m, key_d):
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    m.append(at[0])
                    d.append(at[1])
                    digests.append(digest.hexdigest())
                at, digest = (key_m, key_d), sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(d, pa.int64()), pa.array(digests, pa.string())], names=["m", "d", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_pydict({"m": [at[0]], "d": [at[1]], "ends_sha256": [digest.hexdigest()]})

    return blocks.repartition("m", "d").sortWithinPartitions("m", "d", "block").mapInArrow(run, "m long, d long, ends_sha256 string")


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(turns: DataFrame, convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """One row per node of the conversations' trie, with counts, subtree totals and the digest of those that end there.

    ``turns`` has conv, depth (from 1), length, a, b, chars; ``convs`` has conv, length, also of turnless ones.
    """
    spark = turns.sparkSession
    nodes, steps = _nodes(turns, convs)
    top = nodes.where("d = 0").first()
    if top is None:
        return spark.createDataFrame([], RESULT)
    totals = subtree_totals(nodes.select("m", "d", "pm", "s", "leaf", "saved"), steps, local)
    ends = steps.where("depth = length").select(F.col("owner").alias("m"), F.col("depth").alias("d"), "conv")
    ends = ends.unionByName(convs.where("length = 0").select(F.lit(top["m"]).alias("m"), F.lit(0).cast("long").alias("d"), "conv"))
    out = nodes.drop("leaf", "saved").join(totals, ["m", "d"]).join(_ends_digest(ends), ["m", "d"], "left")
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
