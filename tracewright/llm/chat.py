"""Chat formatting of reply trees, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Put a backslash after every ``<`` that stands before ``|`` or a backslash: no control string
    is left, and ``unescape`` gives the text back."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(?=[|\\])", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\", "<")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line feed, which ends the role, becomes ``<``, backslash, ``n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def paths(nodes: DataFrame, work: Workspace, top: int) -> DataFrame:
    """(tree, leaf, place, branch, node, depth) for the ``top`` best leaves of each tree.

    ``nodes`` has (tree, node, parent, score). Iterative self-joins: in round k every node that has
    one learns its ancestor 2^k steps up, and the score and number of nodes on the way. The same
    jumps, from the longest down, then lead from each chosen leaf through every node of its path
    once. A path of n nodes takes about log2(n) joins either way, each round is a written table, and
    rows of one tree need not meet in one task."""
    ids = nodes.select(F.col("tree").alias("t"), F.col("node").alias("up"))
    rooted = nodes.join(ids, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("up")), "left")
    alive = work.save(rooted.select("tree", "node", "up", "score", F.lit(1).cast("long").alias("depth")), "jump-0")
    total = alive.count()
    jumps, done, k = [], [], 0
    while True:
        done.append(alive.where("up IS NULL").select("tree", "node", "score", "depth"))
        moving = alive.where("up IS NOT NULL")
        if moving.isEmpty():
            break
        jumps.append(moving.select("tree", "node", "up"))
        through = reduce(DataFrame.unionByName, done).withColumn("up", F.lit(None).cast(nodes.schema["node"].dataType))
        a, b = moving.alias("a"), through.unionByName(moving).alias("b")
        met = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
        k += 1
        if 1 << (k - 1) > total:
            raise ValueError("a reply chain leads back to itself")
        alive = work.save(
            met.select(
                "a.tree", "a.node", F.col("b.up").alias("up"),
                (F.col("a.score") + F.col("b.score")).alias("score"), (F.col("a.depth") + F.col("b.depth")).alias("depth"),
            ),
            f"jump-{k}",
        )
    full = work.save(reduce(DataFrame.unionByName, done), "depths")
    inner = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = full.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    best = leaves.groupBy("tree").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node"))), 1, top).alias("chosen")
        if top > 1
        else F.array(F.min(F.struct((-F.col("score")).alias("s"), "node"))).alias("chosen")
    )
    walk = work.save(
        best.select("tree", F.posexplode("chosen").alias("branch", "leaf")).select(
            "tree", "branch", F.col("leaf.node").alias("leaf"), F.col("leaf.node").alias("node")
        ),
        "walk",
    )
    for i, jump in reversed(list(enumerate(jumps))):
        j = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        up = walk.join(j, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        walk = work.save(walk.unionByName(up.select("tree", "branch", "leaf", F.col("up").alias("node"))), f"walk-{i}")
        work.drop("walk" if i == len(jumps) - 1 else f"walk-{i + 1}")
    d = full.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return walk.join(d, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).drop("t", "n")


def format_reply_trees(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, branch, leaf, formatted, loss_spans): the best ``top`` root-to-leaf paths of each reply
    tree, each formatted as one conversation.

    ``messages`` has tree, node (unique in its tree), parent (null, or missing: a root), role, text
    and score (null: 0). Paths rank by the sum of their scores, then by the smallest leaf; branch 0
    is the best. Each turn is ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line
    feed, with control strings inside role and text escaped reversibly. ``loss_spans`` has
    (turn, start, length) for every turn of ``loss_role``: its escaped text, in code points from the
    turn's start.

    Null roles and texts count as empty. Rows with a null node are left out; a null tree is a tree
    of its own. A chain that leads back to itself raises ValueError. An empty table gives an empty
    result; other columns are not read."""
    work = Workspace(messages.sparkSession, "chat")
    rows = messages.where("node IS NOT NULL")
    nodes = rows.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    chosen = paths(work.save(nodes, "nodes"), work, top)
    texts = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = chosen.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turn = F.struct(
        "depth",
        F.concat(head, body, F.lit(END + "\n")).alias("turn"),
        F.when(F.col("role") == loss_role, F.struct(F.length(head).alias("start"), F.length(body).alias("length"))).alias("loss"),
    )
    listed = turns.groupBy("tree", "branch", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(
        "turns", lambda t, i: F.struct(i.alias("turn"), t["loss"]["start"].alias("start"), t["loss"]["length"].alias("length"))
    )
    return listed.select(
        "tree", "branch", "leaf", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """formatted with ``turns`` (role, text: as they were) and ``loss_texts``, read back from the
    text and its spans."""
    raw = formatted.withColumn("__turns", F.split("formatted", r"<\|im_end\|>\n"))
    raw = raw.withColumn("__turns", F.slice("__turns", 1, F.size("__turns") - 1))

    def turn(t: Column) -> Column:
        inner = F.substr(t, F.lit(len(START) + 1))
        at = F.locate("\n", t) - len(START)
        return F.struct(
            unescape_role(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescape(F.substr(inner, at + 1)).alias("text")
        )

    cut = F.transform("loss_spans", lambda s: unescape(F.substr(F.get("__turns", s["turn"]), s["start"] + 1, s["length"])))
    return raw.withColumn("turns", F.transform("__turns", turn)).withColumn("loss_texts", cut).drop("__turns")


def chains(conversations: DataFrame, width: int = 1024) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch: each row answers the one
    before it by turn (null first), role and text.

    Rows are numbered within stretches of ``width`` turns and the stretches' sizes summed, so one
    huge conversation does not meet in one task for it."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    parts = conversations.select(
        F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).withColumn("stretch", F.floor(F.col("turn") / width))
    inner = parts.withColumn("i", F.row_number().over(Window.partitionBy("tree", "stretch").orderBy(*order)))
    before = Window.partitionBy("t").orderBy(F.col("s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(F.col("tree").alias("t"), F.col("stretch").alias("s")).count()
    sizes = sizes.select("t", "s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    joined = inner.join(sizes, F.col("tree").eqNullSafe(F.col("t")) & F.col("stretch").eqNullSafe(F.col("s")))
    node = F.col("before") + F.col("i")
    return joined.select(
        "tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, as counts and digests."""
    spark = conversations.sparkSession
    probe = f"{END}{START}assistant ok"
    extra = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)],
        T.StructType.fromDDL("conv_id long, turn long, role string, text string"),
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    back = read_turns(format_reply_trees(chains(rows)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
