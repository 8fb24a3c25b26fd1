"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each formatted as one conversation with a loss mask.

DataFrame functions only. Structure (ids, parents, scores) is worked out on narrow rows; texts are joined once, to the
chosen paths. Paths come from self-joins whose jumps double, so a thread of n turns takes about log2(n) rounds, each cut
into the shared checkpoint folder; a path of a million turns is written by rows, and only its formatted text is one row.

Defined results: a message without a parent, or whose parent is not in its tree, is a root. A message that is its own
ancestor has no root and stands in no path, nor does what hangs on it. Null trees, ids and roles are values like others
(a null role is written as empty text); a null text is empty; a null score counts as 0. Rows of one id are one message:
the least parent, the greatest score and the least (role, text) stand, so repeated rows change nothing. Branches with
equal scores are ranked by the id of their leaf. Columns of the input other than the named ones are left out.

Template: a turn is `<turn>` role, a line feed, text, `</turn>` and a line feed. Within roles and texts a backslash is
written as `\\b` and `<` as `\\l`, in roles a line feed as `\\n`; so no marker can occur in them and `read_back` restores
each exactly. Positions of the loss mask are code points of the formatted text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

#: Code points in the blocks from which the text under the mask is read, so that reading stays linear in the text.
BLOCK = 4096


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the roles whose texts are learned. Marks must begin with `<` and have no other."""

    opening: str = "<turn>"
    closing: str = "</turn>\n"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if any(m[:1] != "<" or "<" in m[1:] for m in (self.opening, self.closing)):
            raise ValueError("marks begin with < and have no other")


TEMPLATE = Template()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text begins a pair, so the pairs can be put back one kind after the other."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chosen_paths(links: DataFrame, branches: int | None = 1) -> DataFrame:
    """(path, branch, node, pos) of the best `branches` paths of every tree (all if None), for links(tree, node, parent, score).

    node and path are structs (tree, node), path that of the leaf; pos counts from 1 at the root; branch is the path's rank
    in its tree by the mean score of its messages. A parent with very many replies is a skewed key of a sort-merge join,
    which adaptive execution splits; ranks keep `branches` leaves of a tree in each task before they shuffle.
    """
    at = F.struct(F.col("tree"), F.col("node"))
    above = F.when(F.col("parent").isNotNull() & ~F.col("parent").eqNullSafe(F.col("node")), F.struct(F.col("tree"), F.col("parent").alias("node")))
    nodes = cut(links.select(at.alias("node"), above.alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).groupBy("node").agg(F.min("up").alias("up"), F.max("score").alias("score")))
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    state = cut(nodes.join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")))
    leaves, jumps, most = state.join(state.select(F.col("up").alias("node")).distinct(), "node", "left_anti").select("node"), [], state.count().bit_length() + 1
    while len(jumps) < most and not state.filter("up IS NOT NULL").isEmpty():
        jump = state.filter("up IS NOT NULL")
        jumps.append(jump.select("node", F.col("up").alias("above")))
        ahead = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("n").alias("further"))
        moved = jump.join(ahead, "up").select("node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("further")).alias("n"))
        state = cut(state.filter("up IS NULL").unionByName(moved))
    rooted = state.filter("up IS NULL").join(leaves, "node").select("node", "n", (F.col("total") / F.col("n")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("node.tree").orderBy(F.desc("score"), "node.node"))
    best = rooted.withColumn("branch", rank)
    best = best if branches is None else best.filter(F.col("branch") <= branches)
    parts = [cut(best.select(F.col("node").alias("path"), "branch", "node", F.col("n").alias("pos")))]
    for k, jump in enumerate(jumps):
        so_far = reduce(DataFrame.unionByName, parts)
        parts.append(cut(so_far.filter(F.col("pos") > 2**k).join(jump, "node").select("path", "branch", F.col("above").alias("node"), (F.col("pos") - 2**k).alias("pos"))))
    return reduce(DataFrame.unionByName, parts)


def formatted(paths: DataFrame, messages: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(tree, leaf, branch, n_turns, formatted, loss_spans) for every path, from messages(tree, node, role, text).

    loss_spans is an array of (start, length) over the escaped texts of learned roles.
    """
    said = messages.select(F.struct("tree", "node").alias("node"), F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("said"))
    turns = paths.join(said.groupBy("node").agg(F.min("said").alias("said")), "node")
    head = F.concat(F.lit(template.opening), F.replace(escape(F.col("said.role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = turns.select("path", "branch", "pos", head.alias("head"), escape(F.col("said.text")).alias("body"), F.col("said.role").isin(*template.learned).alias("learned"))
    turns = turns.withColumn("length", F.char_length("head") + F.char_length("body") + len(template.closing))
    start = F.coalesce(F.sum("length").over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    span = F.when(F.col("learned"), F.struct((start + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length")))
    pieces = turns.select("path", "branch", F.struct("pos", F.concat("head", "body", F.lit(template.closing)).alias("piece"), span.alias("span")).alias("turn"))
    rows = pieces.groupBy("path").agg(F.min("branch").alias("branch"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return rows.select(
        F.col("path.tree").alias("tree"), F.col("path.node").alias("leaf"), "branch", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def format_trees(messages: DataFrame, tree: str = "tree_id", node: str = "message_id", parent: str = "parent_id", score: str = "score", branches: int | None = 1, template: Template = TEMPLATE) -> DataFrame:
    """The best `branches` root-to-leaf paths of every reply tree, each formatted as one conversation; see `formatted`."""
    kept = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(score).alias("score"), "role", "text")
    return formatted(chosen_paths(kept.select("tree", "node", "parent", "score"), branches), kept, template)


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Every conversation of turns(conv_id, turn, role, text), as a tree with one branch: each turn replies to the one before.

    Rows of one turn number stand in order of role, then of a hash of the text; null turns come first. A repeated row is one
    message. The result is that of `formatted`, with conv_id in place of tree and leaf.
    """
    at = F.struct("turn", F.col("role").alias("who"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("said"))
    messages = turns.select(F.col("conv_id").alias("tree"), at.alias("node"), "role", "text")
    ids = messages.select("tree", "node").distinct()
    links = ids.select("tree", "node", F.lag("node").over(Window.partitionBy("tree").orderBy("node")).alias("parent"), F.lit(0.0).alias("score"))
    return formatted(chosen_paths(links), messages, template).withColumnRenamed("tree", "conv_id").drop("leaf", "branch")


def read_back(text: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    width = len(template.opening)

    def turn(piece: Column) -> Column:
        return let(F.substring_index(piece, "\n", 1), lambda head: F.struct(unescape(F.replace(head.substr(F.lit(width + 1), F.char_length(head)), F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(piece.substr(F.char_length(head) + 2, F.char_length(piece))).alias("text")))

    return let(F.split(text, f"\\Q{template.closing}\\E", -1), lambda pieces: F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))


def learned_text(text: Column, spans: Column) -> Column:
    """What the mask covers, unescaped, in order and with nothing between."""

    def covered(blocks: Column) -> Column:
        def one(span: Column) -> Column:
            first = F.floor(span["start"] / BLOCK)
            last = F.floor((span["start"] + F.greatest(span["length"], F.lit(1)) - 1) / BLOCK)
            around = F.array_join(F.slice(blocks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return unescape(around.substr((span["start"] - first * BLOCK + 1).cast("int"), span["length"].cast("int")))

        return F.array_join(F.transform(spans, one), "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), covered)
