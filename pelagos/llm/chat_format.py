"""Chat formatting of reply trees: root-to-leaf paths by iterated self-joins, the best of them as conversations.

Messages are nodes of trees.  A table of jumps gives for every node its ancestor 1, 2, 4, ... steps up; a self-join of
the table with itself doubles the step, and carries the sum of scores and the number of messages on the way.  After as
many joins as the depth has binary digits every leaf knows the score of its whole path, so branches are ranked before
any path is written out.  Only chosen paths are expanded: a stretch of a path is split at its largest jump until each
row is one message, which takes the same number of joins and makes as many rows as the result has turns.

The template marks a turn as ``open role mid text close``.  In roles and texts the escape sign is doubled and put behind
the first sign of every control string, so no control string is left in them, and removing it gives the text back.

Scale
    Every join has the unique key (tree, node) on one side; a message with very many replies is a large group on the
    other side only, which Spark may split.  Written tables in the shared folder cut lineage after each join.  A formatted
    conversation is one row, so its turns meet in one task, like the text that they become.

Edge cases
    null text or role        empty
    null tree                one tree; a null node has no replies
    parent absent or null    the message is a root; a tree may have several
    replies in a circle      the smallest node of the circle counts as a root
    equal (tree, node)       one message: the highest score, then the smallest role and text
    ties of branches         the longer path, then the smaller leaf
    null score               0
    control strings in texts escaped, those of other templates too
    very long text           escaped whole
    empty table              empty result
    extra columns            ignored by name
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pelagos.scratch import written

#: Control strings of common chat formats.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_KEY = ["tree", "node"]


@dataclass(frozen=True)
class ChatTemplate:
    open: str = "<|im_start|>"
    mid: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    controls: tuple[str, ...] = CONTROLS
    escape: str = "\\"

    def __post_init__(self):
        if len(self.escape) != 1 or any(len(c) < 2 or self.escape in c for c in self.all_controls):
            raise ValueError("the escape is one sign; control strings have two or more and not the escape")
        marks = (self.open, self.mid, self.close)
        if any(a[i:] == b[: len(a) - i] for a in marks for b in marks for i in range(1, len(a))):
            raise ValueError("no mark may end as one begins")

    @property
    def all_controls(self) -> tuple[str, ...]:
        return (self.open, self.mid, self.close, *self.controls)

    def escaped(self, text: Column) -> Column:
        """``text`` without control strings."""
        after = {}
        for control in self.all_controls:
            after.setdefault(control[0], []).append(rf"\Q{control[1:]}\E")
        inside = "|".join(rf"(?<=\Q{sign}\E)(?={'|'.join(rest)})" for sign, rest in after.items())
        put = "\\" + self.escape if self.escape in "\\$" else self.escape  # both have a meaning in replacements
        return F.regexp_replace(F.replace(text, F.lit(self.escape), F.lit(2 * self.escape)), inside, put)

    def plain(self, text: str) -> str:
        """The text that was escaped."""
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted conversation."""
        found = []
        for turn in formatted.split(self.close)[:-1]:
            role, text = turn[len(self.open) :].split(self.mid)
            found.append((self.plain(role), self.plain(text)))
        return found


def _walked(links: DataFrame) -> list[DataFrame]:
    """For 1, 2, 4, ... steps a table of every node: up, the node so many steps up (null past the root), score and n, sum
    of scores and number of messages on the way, least, the smallest node among those reached.

    The last table has no ``up`` any more, unless replies go round in a circle.
    """
    first = links.select(*_KEY, "up", "score", F.lit(1).cast("long").alias("n"), F.col("up").alias("least"))
    tables = [written(first, "jumps")]
    most = tables[0].count()
    while 1 << (len(tables) - 1) <= most and not (going := tables[-1].where("up IS NOT NULL")).isEmpty():
        a, b = going.alias("a"), tables[-1].alias("b")
        met = a.join(b, F.expr("a.tree <=> b.tree AND a.up = b.node")).selectExpr(
            "a.tree", "a.node", "b.up", "a.score + b.score AS score", "a.n + b.n AS n", "least(a.least, b.least) AS least"
        )
        tables.append(written(met.unionByName(tables[-1].where("up IS NULL")), "jumps"))
    return tables


def _links(messages: DataFrame) -> DataFrame:
    """tree, node, up and score; up is null where the parent is not in the tree."""
    known = messages.select(*_KEY).where("node IS NOT NULL").alias("k")
    m = messages.alias("m")
    found = m.join(known, F.expr("m.tree <=> k.tree AND m.parent = k.node"), "left")
    return found.selectExpr("m.tree", "m.node", "k.node AS up", "m.score")


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """tree, leaf, rank, score, pos (1 at the root) and node of the messages on the ``branches`` best paths of a tree.

    ``messages`` has unique (tree, node) besides parent and score; a path's score is the sum over its messages.  None
    takes all paths.
    """
    links = written(_links(messages), "links")
    tables = _walked(links)
    circles = tables[-1].where("up IS NOT NULL AND node = least").select(*_KEY)
    if not circles.isEmpty():
        cut = links.alias("l").join(circles.alias("c"), F.expr("l.tree <=> c.tree AND l.node = c.node"), "left")
        links = written(cut.selectExpr("l.tree", "l.node", "if(c.node IS NULL, l.up, NULL) AS up", "l.score"), "links")
        tables = _walked(links)
    parents = links.select(F.col("tree").alias("t"), F.col("up").alias("u")).where("u IS NOT NULL").distinct()
    leaves = tables[-1].join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("u")), "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "node")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), F.row_number().over(order).alias("rank"), "score", F.col("n").alias("pos"), "node", "n")
    paths = written(ranked if branches is None else ranked.where(F.col("rank") <= branches), "paths")
    for k in reversed(range(len(tables) - 1)):
        step = 1 << k
        jump = tables[k].select(F.col("tree").alias("t"), F.col("node").alias("from"), "up")
        met = F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("from")) & (F.col("n") > step)
        near = F.struct("pos", "node", F.least("n", F.lit(step).cast("long")).alias("n"))
        far = F.struct((F.col("pos") - step).alias("pos"), F.col("up").alias("node"), (F.col("n") - step).alias("n"))
        parts = F.explode(F.when(F.col("n") > step, F.array(near, far)).otherwise(F.array(near)))
        split = paths.join(jump, met, "left").select("tree", "leaf", "rank", "score", parts.alias("part"))
        paths = written(split.select("tree", "leaf", "rank", "score", "part.*"), "paths")
    return paths.drop("n")


def format_chats(
    messages: DataFrame,
    tree_col: str = "tree_id",
    node_col: str = "node_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = None,
    branches: int | None = 1,
    template: ChatTemplate = ChatTemplate(),
    loss_role: str = "assistant",
) -> DataFrame:
    """One conversation per chosen path: tree, leaf, rank, score, n_turns, formatted and loss.

    loss: spans (start and end in code points of ``formatted``, end exclusive) of the escaped texts of ``loss_role``.
    """
    score = F.coalesce(messages[score_col].cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    empty = lambda c: F.coalesce(messages[c], F.lit(""))
    rows = messages.select(
        messages[tree_col].alias("tree"),
        messages[node_col].alias("node"),
        messages[parent_col].alias("parent"),
        score.alias("score"),
        empty(role_col).alias("role"),
        empty(text_col).alias("text"),
    )
    first = F.min_by(F.struct("parent", "score", "role", "text"), F.struct(-F.col("score"), "role", "text", "parent"))
    rows = written(rows.groupBy(*_KEY).agg(first.alias("m")).select(*_KEY, "m.*"), "messages")
    paths = best_paths(rows.drop("role", "text"), branches)
    texts = rows.select(F.col("tree").alias("t"), F.col("node").alias("of"), "role", "text")
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & F.col("node").eqNullSafe(F.col("of")))
    turns = turns.withColumn("head", F.concat(F.lit(template.open), template.escaped(F.col("role")), F.lit(template.mid)))
    turns = turns.withColumn("body", template.escaped(F.col("text")))
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(template.close)))
    path = ["tree", "leaf", "rank", "score"]
    before = W.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn").cast("long")).over(before), F.lit(0)) + F.length("head")
    turns = turns.select(*path, "pos", "role", "turn", start.alias("start"), (start + F.length("body")).alias("end"))
    own = F.when(F.col("role") == loss_role, F.struct("start", "end"))
    whole = turns.groupBy(*path).agg(F.sort_array(F.collect_list(F.struct("pos", "turn"))).alias("turns"), F.sort_array(F.collect_list(own)).alias("loss"))
    return whole.select(*path, F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.turn", "").alias("formatted"), "loss")


def read_back(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """tree and leaf of formatted conversations, with what their text and loss spans say.

    n_turns, turns_sha256 (role, line feed, text, line feed of every turn), loss_chars and loss_sha256 (texts of the loss
    spans, end to end) and formatted_chars.
    """
    rows = chats.select("tree", "leaf", "formatted", "loss")
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turns = template.turns(text)
                loss = "".join(template.plain(text[s["start"] : s["end"]]) for s in spans)
                made.append((len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(text)))
            columns = [pa.array(c) for c in zip(*made, strict=True)] if made else [pa.array([], k) for k in _READ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["tree", "leaf", *_NAMES])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("tree", "leaf"))
    found = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(_NAMES, _READ, strict=True))
    return rows.mapInArrow(read, f"{kinds}, {found}")


_NAMES = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
_READ = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def as_replies(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as messages, each the reply to the one before: tree_id, node_id, parent_id, role and text.

    Equal turns follow each other by role and text; a null turn comes first.
    """
    rows = conversations.select(*(conversations[c].alias(n) for c, n in ((id_col, "tree_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    at = F.row_number().over(W.partitionBy("tree_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select("tree_id", at.alias("node_id"), "role", "text").withColumn("parent_id", F.col("node_id") - 1)
