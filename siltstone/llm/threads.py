"""Quotation linking: nested quotes, hashes of quoted passages, original messages, reply order. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written
from .decontaminate import LOWER, UPPER

#: Marks before a quoted line, the lines that announce a quote, and white space that is one space in a passage.
MARKS, SAYS, SPACE = r"^((?:[ \t]*>)+)", r"^[ \t]*On .+ wrote:[ \t\r]*$", r"[ \t\r]+"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def _normal(line: Column) -> Column:
    """The line without its marks, A-Z lowered, white space collapsed."""
    return F.translate(F.btrim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), SPACE, " "), F.lit(" ")), UPPER, LOWER)


def _says(line: Column) -> Column:
    """Whether the line announces a quote, at any level."""
    return F.regexp_replace(line, MARKS, "").rlike(SAYS)


def passages(base: DataFrame) -> DataFrame:
    """(rid, conv_id, turn, text) -> distinct (rid, conv_id, turn, level, h).

    Neighbouring lines of one level are joined, so wrapped quotes meet their originals, and cut after . ! ? into
    sentences: each is a passage. h is its MD5. Blank lines and lines that announce a quote aren't part of any."""
    line = base.select("rid", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = line.select("rid", "conv_id", "turn", "pos", _level(F.col("line")).alias("level"), _normal(F.col("line")).alias("body"), _says(F.col("line")).alias("says")).where("body <> '' and not says")
    by = W.partitionBy("rid").orderBy("pos")  # one message
    run = line.withColumn("new", (F.col("level") != F.coalesce(F.lag("level").over(by), F.lit(-1))).cast("int")).withColumn("run", F.sum("new").over(by))
    run = run.groupBy("rid", "conv_id", "turn", "run", "level").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("x"))
    cut = run.select("rid", "conv_id", "turn", "level", F.explode(F.split(F.regexp_replace(F.array_join("x.body", " "), "([.!?]) ", "$1\n"), "\n")).alias("s"))
    return cut.where("s <> ''").select("rid", "conv_id", "turn", "level", F.md5(F.col("s").cast("binary")).alias("h")).distinct()


def parents(passage: DataFrame) -> DataFrame:
    """(rid, parent, n_linked): the message that each quoting message answers.

    A passage's original is the first message of the conversation that has it outside quotes, if that is an earlier
    turn. The parent is the original of most passages of the outermost quote level that has any; ties: the latest.
    One original stands for each passage, so passages that many messages share give one row for each quote of them."""
    first = passage.where("level = 0").groupBy("conv_id", "h").agg(F.min(F.struct("turn", "rid")).alias("o"))
    quoted = passage.where("level > 0")
    met = quoted.join(first, ["conv_id", "h"]).where("o.turn < turn")
    per = met.groupBy("rid", "level", "o").agg(F.count("*").alias("n"))
    best = per.groupBy("rid").agg(F.max(F.struct((-F.col("level")).alias("out"), "n", F.col("o.turn").alias("turn"), F.col("o.rid").alias("parent"))).alias("b"), F.sum("n").alias("n_linked"))
    return best.select("rid", F.col("b.parent").alias("parent"), "n_linked")


def roots(base: DataFrame, parent: DataFrame) -> DataFrame:
    """(rid, root, depth): the turn of the message that begins the thread, and the number of replies down to here.

    Pointers are doubled: each round joins a message to its furthest known ancestor, so the rounds are the logarithm of
    the depth, and a row's size doesn't follow it. Each round is a written table."""
    now = written(base.join(parent, "rid", "left").select("rid", F.col("parent").alias("up"), F.col("turn").alias("root"), F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth")), "roots")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("rid").alias("a_rid"), F.col("up").alias("a_up"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"))
        joined = now.join(above, now.up == above.a_rid, "left")
        now = written(joined.select("rid", F.col("a_up").alias("up"), F.coalesce("a_root", "root").alias("root"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth")), "roots")
    return now.select("rid", "root", "depth")


def unquoted(text: Column) -> Column:
    """The lines outside quotes, without those that announce one."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: (_level(x) == 0) & ~_says(x)), "\n")


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) -> a row for each: conv_id, turn, role, text without quotes, reply_to and
    root (turns), depth, n_quoted, n_linked (passages), levels (deepest quote).

    Ordered by conv_id, root and turn, each conversation is in reply order: threads one after the other, in each a message
    follows the one it answers, which has an earlier turn. Messages without a linked quote start a thread (reply_to null,
    depth 0, root its own turn). Null text has no passages and stays null. Rows with
    null conv_id or turn link to nothing. Repeated rows stay rows; the first of them is the original. Other columns are ignored.
    """
    base = written(messages.select(F.monotonically_increasing_id().alias("rid"), F.col("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"), "messages")
    passage = written(passages(base), "passages")
    parent = written(parents(passage), "parents")
    root = roots(base, parent)
    quoted = passage.groupBy("rid").agg(F.count_if(F.col("level") > 0).alias("n_quoted"), F.max("level").alias("levels"))
    turn = base.select(F.col("rid").alias("parent"), F.col("turn").alias("reply_to"))
    out = base.join(root, "rid").join(quoted, "rid", "left").join(parent.join(turn, "parent"), "rid", "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        unquoted(F.col("text")).alias("text"),
        "reply_to",
        "root",
        "depth",
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("levels", F.lit(0)).cast("long").alias("levels"),
    )


#: Passages, originals and parents in SQL; (conv_id, turn) names a message. Threads by recursion.
ORACLE = r"""
WITH RECURSIVE line AS (
  SELECT conv_id, turn, pos, ln, length(regexp_replace(regexp_extract(ln, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
         translate(trim(regexp_replace(regexp_replace(ln, '^((?:[ \t]*>)+)', ''), '[ \t\r]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body,
         regexp_matches(regexp_replace(ln, '^((?:[ \t]*>)+)', ''), '^[ \t]*On .+ wrote:[ \t\r]*$') AS says
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS ln, unnest(range(len(string_split(text, chr(10))))) AS pos FROM conversations)),
solid AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 0 ELSE 1 END AS new FROM line WHERE body <> '' AND NOT says),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run FROM solid),
run AS (SELECT conv_id, turn, run, level, string_agg(body, ' ' ORDER BY pos) AS body FROM numbered GROUP BY ALL),
passage AS (SELECT DISTINCT conv_id, turn, level, md5(s) AS h FROM (SELECT conv_id, turn, level, unnest(string_split(regexp_replace(body, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))) AS s FROM run) WHERE s <> ''),
orig AS (SELECT conv_id, h, min(turn) AS o FROM passage WHERE level = 0 GROUP BY ALL),
per AS (SELECT p.conv_id, p.turn, level, o, count(*) AS n FROM passage p JOIN orig USING (conv_id, h) WHERE level > 0 AND o < p.turn GROUP BY ALL),
best AS (SELECT conv_id, turn, o, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, o DESC) AS k FROM per),
parent AS (SELECT conv_id, turn, o, n_linked FROM best WHERE k = 1),
tree AS (
  SELECT conv_id, turn, turn AS root, 0 AS depth FROM conversations WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM parent)
  UNION ALL
  SELECT p.conv_id, p.turn, t.root, t.depth + 1 FROM tree t JOIN parent p ON p.conv_id = t.conv_id AND p.o = t.turn),
quoted AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted, max(level) AS levels FROM passage GROUP BY ALL),
plain AS (SELECT conv_id, turn, string_agg(ln, chr(10) ORDER BY pos) AS body FROM line WHERE level = 0 AND NOT says GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, CASE WHEN c.text IS NOT NULL THEN coalesce(body, '') END AS text, o AS reply_to, root, CAST(depth AS BIGINT) AS depth,
       coalesce(n_quoted, 0) AS n_quoted, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, CAST(coalesce(levels, 0) AS BIGINT) AS levels
FROM conversations c JOIN tree USING (conv_id, turn) LEFT JOIN parent USING (conv_id, turn) LEFT JOIN quoted USING (conv_id, turn) LEFT JOIN plain USING (conv_id, turn)
"""


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))
