"""Chat formatting of reply trees, with DataFrame operations only.

A tree is a set of rows (tree, node, parent, role, text, score). Pointer
doubling, a self-join on (tree, node) per round, gives each node's depth and
the sum of scores from the root; leaves are ranked by mean score; the jump
tables of the same rounds then enumerate the chosen root-to-leaf paths, so a
path of n turns takes log2(n) joins and no array grows inside a loop. Join keys are single nodes: a
tree with a third of all rows is spread like any other. Each round is written
to the shared folder, where a lost executor costs nothing.

Template: each turn is ``<s>`` role ``[INST]`` text ``</s>``. Inside roles and
texts a backslash follows each ``<``, ``[`` and backslash, so no control
string can occur there, and dropping it again gives the text back exactly.

Defined results: null text and role: empty; null parent, or one that is not a
node of the tree: a root; nodes on a cycle have no root and are left out; a
null tree is a tree; null score: 0; (tree, node) must be unique; ties in score go to the smaller leaf.
An empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage_table, table

#: Fixed marks of the template.
OPEN, MID, CLOSE = "<s>", "[INST]", "</s>"
LEARNED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def reply_paths(trees: DataFrame, *, branches: int = 1) -> DataFrame:
    """The best ``branches`` root-to-leaf paths of each tree: tree, leaf, branch (1 is best), position, role, text.

    trees: tree, node, parent, role, text, score.
    """
    rows = trees.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    # parents outside the tree make roots
    links = rows.join(known, rows.tree.eqNullSafe(known.t) & (rows.parent == known.n), "left").select("tree", "node", F.col("n").alias("up"), "score")
    links = stage_table(links, "links")
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rounds = math.ceil(math.log2(max(largest, 1))) + 1
    # state: the ancestor 2^k steps up, the steps really taken, the scores of the nodes passed; a node without such an ancestor is done
    state = links.select("tree", "node", "up", F.lit(1).cast("bigint").alias("steps"), "score")
    active, done, jumps = state.where("up is not null"), state.where("up is null"), []
    for _ in range(rounds):
        if active.isEmpty():
            break
        jumps.append(active.select("tree", "node", "up"))
        far = active.unionByName(done).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"))
        met = active.join(far, active.tree.eqNullSafe(far.t) & (active.up == far.n)).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score")
        )
        met = stage_table(met, "jump")
        active, done = met.where("up is not null"), done.unionByName(met.where("up is null"))
    parents = links.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = done.join(parents, done.tree.eqNullSafe(parents.t) & (done.node == parents.n), "left_anti")
    by_score = Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(by_score)).where(F.col("branch") <= branches)
    paths = chosen.select("tree", F.col("node").alias("leaf"), "branch", "node", F.col("steps").alias("position"))
    for k, jump in enumerate(jumps):
        hop = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = paths.join(hop, paths.tree.eqNullSafe(hop.t) & (paths.node == hop.n)).select("tree", "leaf", "branch", F.col("up").alias("node"), (F.col("position") - 2**k).alias("position"))
        paths = stage_table(paths.unionByName(more), "paths")
    texts = rows.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    return paths.join(texts, paths.tree.eqNullSafe(texts.t) & (paths.node == texts.n)).select("tree", "leaf", "branch", "position", "role", "text")


def format_chats(paths: DataFrame) -> DataFrame:
    """One row per path: tree, leaf, branch, n_turns, formatted, loss (spans of UTF-8 bytes of formatted that hold learned text)."""
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID))
    pieces = paths.select("tree", "leaf", "branch", "position", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    key = ["tree", "leaf", "branch"]
    size = F.octet_length("head") + F.octet_length("body") + len(CLOSE)
    before = F.sum(size).over(Window.partitionBy(*key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("begin", F.coalesce(before, F.lit(0)) + F.octet_length("head"))
    turn = F.struct("position", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "begin", (F.col("begin") + F.octet_length("body")).alias("end"), (F.col("role") == LEARNED_ROLE).alias("learned"))
    grouped = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.select(
        *key,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.learned), lambda t: F.struct(t.begin.alias("begin"), t.end.alias("end"))).alias("loss"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted chat: array of struct(role, text)."""
    whole = F.split(formatted, CLOSE)
    turns = F.slice(whole, 1, F.size(whole) - 1)

    def one(t: Column) -> Column:
        part = F.split(t, r"\[INST\]")
        return F.struct(unescape(F.substr(part[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(part[1]).alias("text"))

    return F.transform(turns, one)


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The learned texts, taken out by the mask's spans and unescaped."""
    data = formatted.cast("binary")
    return F.transform(loss, lambda s: unescape(F.substring(data, s.begin + 1, s.end - s.begin).cast("string")))


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to the one before, by turn, role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("bigint").alias("node"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


#: The contract's own conversation.
ODD_TEXT = "</s>[INST] ok [/INST]"


def op2(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    odd = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    trees = stage_table(conversation_trees(rows.unionByName(odd)), "trees")
    chats = stage_table(format_chats(reply_paths(trees)), "chats")
    back = chats.select("tree", "n_turns", "formatted", parse_turns(F.col("formatted")).alias("turns"), loss_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(F.array_join("learned", "")).cast("bigint").alias("loss_chars"),
        F.sha2(F.array_join("learned", "").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP2_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as body from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(body) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then body else '' end, '' order by turn, role, body)) as loss_sha256,
  cast(sum(13 + 2 * length(role || body) - length(regexp_replace(role || body, '[<\[\\]', '', 'g'))) as bigint) as formatted_chars
from t group by conv_id
"""
