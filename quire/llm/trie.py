"""The prefix trie of conversations: distributed radix partitioning by turn, most significant first, and multikey quicksort.

Turns (role, text) are encoded as numbers by a dictionary of their distinct SHA-256 values, so texts are never shuffled.
Conversations are then sequences of numbers. A bucket is the set of conversations below one node. Each round takes the
buckets of more than LOCAL turns, finds how far all members of each agree (one aggregation by bucket and place), writes
the nodes on that path, and deals the members to child buckets by their next turn. Members that agree to the end, copies
for example, are done in one round however long they are, so rounds are as many as branching points above one another
whose buckets stay large. Buckets of at most LOCAL turns go to tasks in bins; there, multikey quicksort orders the
sequences and its recursion writes the nodes. Totals of subtrees are added up from the bins through the rounds' buckets.

Rows, not conversations, are what is shuffled: no task holds a long conversation or the members of a large bucket.
Positions and sums along paths are running totals over ranges of rows. A node is known by its smallest member and depth.
The digest of the ids that end at a node is sequential by definition: sorted blocks of them pass one task as a stream.

Edge cases: rows without conv_id belong to no conversation; null turns come first; rows of one turn number are ordered by
role and then by SHA-256 of the text, repeated rows are turns of their own; null role and text are empty; conversations
that end up without turns are members of the root; an empty table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, small_side, spread_join, staged

#: Turns below one node, and about those in one bin, that a task finishes by itself.
LOCAL = 20_000
#: Conversations of a hundred share the first turns of its first one, at most five.
FAMILY, SHARED = 100, 6
#: Ids of a block that is joined to a string by itself.
BLOCK = 4_096
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def running(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str, tag: str) -> DataFrame:
    """rows, staged, with the running total of value by key in the given order; a key's rows are dealt to ranges.

    Only keys that span ranges have totals to carry over: at most one row a range, which is broadcast.
    """
    by = [*key, *order]
    dealt = rows.withColumn("value", value).repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = staged(dealt.withColumn("at", F.monotonically_increasing_id()), tag).withColumn("part", F.shiftright("at", 33))
    upto = Window.partitionBy("part", *key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = dealt.groupBy(*key, "part").agg(F.sum("value").alias("total"))
    carried = carried.select(*key, "part", F.sum("total").over(before).alias("before")).filter("before is not null")
    out = dealt.withColumn(name, F.sum("value").over(upto)).join(F.broadcast(carried), [*key, "part"], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("before", F.lit(0))).drop("value", "at", "part", "before")


def _looked_up(rows: DataFrame, side: DataFrame, key: list[str], spread: str) -> DataFrame:
    """rows joined with side, one row a key, whether side can be broadcast or a key has very many rows."""
    small = small_side(side)
    if small is not side:
        return rows.join(small, key)
    of = F.struct(*key).alias("of")
    return spread_join(rows.withColumn("of", of), side.select(of, *(c for c in side.columns if c not in key)), "of", spread).drop("of")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, len, pos, tid, chars), staged: the rebuilt conversations, each from pos 0, the root, to its length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sha = lambda x: F.unhex(F.sha2(x, 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), sha(text).alias("text"), F.length(text).cast("long").alias("chars"))
    rows = running(rows, ["conv_id"], ["turn", "role", "text"], F.lit(1).cast("long"), "p", "turns")
    rows = rows.select("conv_id", "p", "chars", sha(F.concat(F.col("text"), F.encode("role", "utf-8"))).alias("turn_key"))
    words = staged(rows.select("turn_key").distinct().withColumn("tid", F.monotonically_increasing_id()), "dictionary")
    rows = staged(spread_join(rows, words, "turn_key", "conv_id").drop("turn_key"), "encoded")
    discard(words)

    convs = rows.groupBy("conv_id").agg(F.max("p").alias("own")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % SHARED)
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = rows.filter((F.col("p") < SHARED) & (F.col("conv_id") == first)).withColumnRenamed("conv_id", "first")  # at most five rows a first
    taken = convs.withColumn("first", first).join(heads, "first").filter("p <= h")
    convs = convs.join(taken.groupBy("conv_id").agg(F.count("*").alias("got")), "conv_id", "left").fillna(0, ["got"])
    convs = staged(convs.select("conv_id", "h", "got", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "lengths")
    own = spread_join(rows, convs, "conv_id", "p").filter("p > h").withColumn("p", F.col("p") - F.col("h") + F.col("got"))
    taken = taken.select("conv_id", "p", "tid", "chars").join(convs, "conv_id")
    roots = convs.withColumns({"p": F.lit(0).cast("long"), "tid": F.lit(-1).cast("long"), "chars": F.lit(0).cast("long")})
    columns = ["conv_id", "len", F.col("p").alias("pos"), "tid", "chars"]
    out = staged(own.select(*columns).union(taken.select(*columns)).union(roots.select(*columns)), "sequences")
    discard(rows, convs)
    return out


def finished(ids: list[int], turns: list[list[int]], chars: dict[int, int], depth: int, parent: int | None) -> list[list]:
    """The nodes below one node, by multikey quicksort of the turns that the members, in order of id, have left there."""
    nodes: list[list] = []
    above: list[int] = []
    last: list[int] = []
    stack = [(list(range(len(ids))), 0, -1)]
    while stack:
        group, k, over = stack.pop()
        if len(group) > 1:
            pivot = sorted(turns[group[i]][k] for i in (0, len(group) // 2, -1))[1]
            for rest in ([i for i in group if turns[i][k] < pivot], [i for i in group if turns[i][k] > pivot]):
                if rest:
                    stack.append((rest, k, over))
            group = [i for i in group if turns[i][k] == pivot]
        ends = [i for i in group if len(turns[i]) == k + 1]
        digest = hashlib.sha256(",".join(str(ids[i]) for i in ends).encode()).hexdigest()
        nodes.append([ids[group[0]], depth + k + 1, parent if over < 0 else nodes[over][0], len(group), 0, 0, 0, digest])
        above.append(over)
        last.append(chars[turns[group[0]][k]])
        if len(ends) < len(group):
            stack.append(([i for i in group if len(turns[i]) > k + 1], k + 1, len(nodes) - 1))
    for i in range(len(nodes) - 1, -1, -1):  # a node comes behind the one above it
        node, over = nodes[i], above[i]
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * last[i]
        if over >= 0:
            for c, n in ((4, 1), (5, node[5]), (6, node[6])):
                nodes[over][c] += n
    return nodes


def _finish(bin_):
    """The nodes of all buckets of a bin."""
    import pandas as pd

    bin_ = bin_.sort_values(["bucket", "d", "conv_id", "pos"])
    chars = dict(zip(bin_["tid"].tolist(), bin_["chars"].tolist(), strict=True))
    edge = lambda *columns: np.flatnonzero(np.r_[True, np.any([bin_[c].to_numpy()[1:] != bin_[c].to_numpy()[:-1] for c in columns], axis=0)])
    starts, buckets = edge("bucket", "d", "conv_id"), edge("bucket", "d")
    tid, conv, d, parent = (bin_[c].tolist() for c in ("tid", "conv_id", "d", "parent"))
    ends = [*starts[1:].tolist(), len(bin_)]
    turns = [tid[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
    of = np.searchsorted(starts, [*buckets.tolist(), len(bin_)])
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        at = int(starts[a])
        out += finished([conv[i] for i in starts[a:b]], turns[a:b], chars, d[at], parent[at])
    out = pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])
    return out.astype({"parent_conv_id": "Int64"})


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ends(conv_id, depth, ended): ids are joined by blocks, blocks hashed as a stream."""
    ranked = running(ends, ["conv_id", "depth"], ["ended"], F.lit(1).cast("long"), "rank", "ends")
    text = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("ended")), lambda x: x.cast("string")))
    blocks = ranked.groupBy("conv_id", "depth", F.floor((F.col("rank") - 1) / BLOCK).alias("block")).agg(text.alias("ids"))

    def run(frames):
        import pandas as pd

        key, sha = None, None
        for frame in frames:
            out = []
            for conv, depth, ids in zip(frame["conv_id"].tolist(), frame["depth"].tolist(), frame["ids"], strict=True):
                if (conv, depth) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["conv_id", "depth", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    dealt = blocks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block").select("conv_id", "depth", "ids")
    return dealt.mapInPandas(run, "conv_id long, depth long, ends_sha256 string")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def prefix_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of the trie
    of conversations(conv_id, turn, role, text), rebuilt from shared first turns."""
    t = sequences(conversations)
    n, least = t.filter("pos = 0").agg(F.count("*"), F.min("conv_id")).first()
    if not n:
        return t.sparkSession.createDataFrame([], NODES)
    below = t.withColumns({"bucket": F.lit(least).cast("long"), "d": F.lit(-1).cast("long"), "n": F.lit(n).cast("long"), "parent": F.lit(None).cast("long")})
    rounds, chains, ends, pools = [], [], [], []
    while True:
        places = below.groupBy("bucket", "d", "n", "parent", "pos").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.count("*").alias("c"), F.min("chars").alias("chars"))
        places = staged(places, "places")
        apart = F.when((F.col("lo") != F.col("hi")) | (F.col("c") < F.col("n")), F.col("pos"))
        saved = (F.col("n") - 1) * F.col("chars")
        paths = places.groupBy("bucket", "d", "n", "parent").agg(F.coalesce(F.min(apart) - 1, F.max("pos")).alias("l"))
        paths = staged(paths, "paths")
        chain = _looked_up(places, paths.select("bucket", "l"), ["bucket"], "pos").filter("pos <= l")
        chains.append(staged(chain.select("bucket", "d", "pos", "l", "n", "parent", saved.alias("saved")), "chain"))
        rounds.append(paths)
        discard(places)
        at = _looked_up(below.select("bucket", "conv_id", "len", "pos", "tid"), paths.select("bucket", "l"), ["bucket"], "conv_id")
        ends.append(staged(at.filter("pos = l and len = l").select(F.col("bucket").alias("conv_id"), F.col("l").alias("depth"), F.col("conv_id").alias("ended")), "ended"))
        at = staged(at.filter("pos = l + 1").select("bucket", "l", "conv_id", "len", "tid"), "members")
        children = staged(at.groupBy("bucket", "tid").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.sum(F.col("len") - F.col("l")).alias("turns")), "children")
        members = _looked_up(at, children, ["bucket", "tid"], "conv_id")
        members = staged(members.select("conv_id", F.col("child").alias("bucket"), F.col("l").alias("d"), "n", F.col("bucket").alias("parent"), "turns"), "dealt")
        discard(at, children)
        pools.append(members.filter(F.col("turns") <= local))
        large = members.filter(F.col("turns") > local).drop("turns")
        if large.isEmpty():
            break
        below = spread_join(t, large, "conv_id", "pos").filter("pos > d")

    pool = _union(pools)
    rest = spread_join(t, pool.select("conv_id", "bucket", "d", "parent"), "conv_id", "pos").filter("pos > d")
    bins = max(1, (pool.select("bucket", "d", "turns").distinct().agg(F.sum("turns")).first()[0] or 0) // local)
    rest = rest.select("bucket", "d", "parent", "conv_id", "pos", "tid", "chars", F.pmod(F.xxhash64("bucket", "d"), F.lit(bins)).alias("bin"))
    low = staged(rest.groupBy("bin").applyInPandas(_finish, NODES), "nodes")

    tops = pool.select("bucket", F.col("d").alias("over")).distinct().withColumn("depth", F.col("over") + 1)
    tops = low.join(tops, (low.conv_id == tops.bucket) & (low.depth == tops.depth)).select(F.col("parent_conv_id").alias("bucket"), F.col("over").alias("l"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    found = tops.groupBy("bucket", "l").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children"))
    local_tops, up = staged(found, "tops"), None
    sums: list[DataFrame] = []
    for paths, chain in zip(reversed(rounds), reversed(chains), strict=True):
        under = local_tops if up is None else local_tops.union(up).groupBy("bucket", "l").agg(*(F.sum(c).alias(c) for c in ("leaves", "saved", "children")))
        own = chain.groupBy("bucket", "d").agg(F.sum("saved").alias("own"))
        s = paths.join(under, ["bucket", "l"], "left").join(own, ["bucket", "d"])
        s = staged(s.select("bucket", "d", "parent", F.coalesce("leaves", F.lit(1)).alias("leaves"), (F.coalesce("saved", F.lit(0)) + F.col("own")).alias("total"), F.coalesce("children", F.lit(0)).alias("children")), "sums")
        up = s.groupBy(F.col("parent").alias("bucket"), F.col("d").alias("l")).agg(F.sum("leaves").alias("leaves"), F.sum("total").alias("saved"), F.count("*").alias("children"))
        sums.append(s)

    chain = running(_union(chains), ["bucket", "d"], ["pos"], F.col("saved"), "upto", "paths")
    high = _looked_up(chain, _union(sums).drop("parent"), ["bucket", "d"], "pos")
    digests = _ends_digest(_union(ends)).withColumnsRenamed({"conv_id": "bucket", "depth": "pos"})
    high = high.join(digests, ["bucket", "pos"], "left")
    high = high.select(
        F.col("bucket").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == F.col("d") + 1, F.col("parent")).otherwise(F.col("bucket")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("pos") < F.col("l"), F.lit(1)).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("upto") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return low.unionByName(high)
