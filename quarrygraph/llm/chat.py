"""Chat formatting with quotation linking. DataFrame expressions only.

A line's quote level is its number of leading ``>``. Runs of lines of one level are passages; a passage and each of its
lines get a hash of their normalised text, and so do every message's own lines and its own text as a whole. A quoted
passage votes, by length, for the earliest message whose own text holds it, in its conversation or else in an earlier
one. Conversations that quote each other are one thread; within it, (conversation, turn) puts every message after
those that it quotes. The formatted text has a message's own words only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound, connected_components, write_shared

#: What marks a quoted line and the line that announces a quotation.
_MARK = r"^[ \t]{0,3}((?:>[ \t]?)+)"
_SAYS = r"(?i)^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$"
_ROLES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}
#: Shorter normalised passages and lines are too common to link.
KEY_CHARS = 12
#: Turns dealt to one window, which bounds it however long a conversation is.
TURN_BLOCK = 1024
_PASSAGES = "array<struct<level:int,body:string>>"


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _lines(text: Column) -> Column:
    def one(line: Column) -> Column:
        mark = F.regexp_extract(line, _MARK, 1)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.regexp_replace(line, _MARK, "").alias("body"))

    return F.transform(F.split(text, r"\r?\n"), one)


def _unannounced(lines: Column) -> Column:
    """The lines without those that announce the deeper passage right after them."""

    def over(x: Column) -> Column:
        following = lambda k: F.coalesce(F.get(x, k + 1)["level"], F.lit(0))
        return F.filter(x, lambda line, k: ~((following(k) > line["level"]) & line["body"].rlike(_SAYS)))

    return bound(lines, over)


def _passages(lines: Column) -> Column:
    """Runs of quoted lines of one level, joined."""

    def over(x: Column) -> Column:
        level = lambda k: F.get(x, k)["level"]
        begins = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda k: (k == 0) | (level(k) != level(k - 1)))

        def runs(begin: Column) -> Column:
            def run(start: Column, k: Column) -> Column:
                last = F.coalesce(F.get(begin, k + 1), F.size(x)) - 1
                body = F.array_join(F.transform(F.sequence(start, last), lambda j: F.get(x, j)["body"]), "\n")
                return F.struct(level(start).alias("level"), body.alias("body"))

            return F.filter(F.transform(begin, run), lambda p: p["level"] > 0)

        return bound(begins, runs)

    return F.when(F.size(lines) > 0, bound(lines, over)).otherwise(F.expr(f"cast(array() as {_PASSAGES})"))


def _keys(body: Column) -> Column:
    """Distinct ``struct(key, chars)`` of a text as a whole and of its lines."""
    parts = F.transform(F.concat(F.array(body), F.split(body, "\n")), normalised)
    long = F.filter(F.array_distinct(parts), lambda p: F.length(p) >= KEY_CHARS)
    return F.transform(long, lambda p: F.struct(F.md5(p.cast("binary")).alias("key"), F.length(p).alias("chars")))


def parse_messages(messages: DataFrame) -> DataFrame:
    """``(rid, conv_id, turn, role, content, passages)`` of ``messages(conv_id, turn, role, text)``."""
    text = F.coalesce("text", F.lit(""))
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in _ROLES.items() for x in pair])
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.try_element_at(known, role), role).alias("role"), text.alias("text"))
    rows = rows.withColumn("lines", F.when(F.contains("text", F.lit(">")), _unannounced(_lines(F.col("text")))))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    content = F.trim(F.regexp_replace(F.when(F.col("lines").isNull(), F.col("text")).otherwise(own), r"^\s+|\s+$", ""))
    passages = F.when(F.col("lines").isNull(), F.expr(f"cast(array() as {_PASSAGES})")).otherwise(_passages(F.col("lines")))
    return rows.select(F.monotonically_increasing_id().alias("rid"), "conv_id", "turn", "role", content.alias("content"), passages.alias("passages"))


def quotation_links(parsed: DataFrame) -> DataFrame:
    """``(rid, level, to_conv, to_turn, votes)``: for each message and quote level the message most quoted there.

    A key's originals are reduced to the earliest in each conversation and the earliest of all before the join, so a
    line that is in very many messages meets one or two rows of them, never all.
    """
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    quoted = parsed.where(known & (F.size("passages") > 0)).select("rid", "conv_id", "turn", F.explode("passages").alias("p"))
    quoted = quoted.select("rid", "conv_id", "turn", "p.level", F.explode(_keys(F.col("p.body"))).alias("k")).select("rid", "conv_id", "turn", "level", "k.key", "k.chars")
    owned = parsed.where(known).select("conv_id", "turn", F.explode(_keys(F.col("content"))).alias("k")).select("conv_id", "turn", "k.key")
    first = owned.groupBy("key", F.col("conv_id").alias("own_conv")).agg(F.min("turn").alias("own_turn"))
    first = first.join(quoted.select("key").distinct(), "key", "left_semi")
    earliest = first.groupBy("key").agg(F.min(F.struct("own_conv", "own_turn")).alias("e"))
    near = quoted.join(first, (quoted.key == first.key) & (quoted.conv_id == first.own_conv) & (first.own_turn < quoted.turn), "left").drop(first.key)
    both = near.join(earliest, "key", "left")
    before = F.col("e.own_conv") < F.col("conv_id")
    to_conv = F.when(F.col("own_turn").isNotNull(), F.col("own_conv")).when(before, F.col("e.own_conv"))
    to_turn = F.when(F.col("own_turn").isNotNull(), F.col("own_turn")).when(before, F.col("e.own_turn"))
    votes = both.select("rid", "level", "conv_id", "chars", to_conv.alias("to_conv"), to_turn.alias("to_turn")).where("to_conv is not null")
    votes = votes.groupBy("rid", "level", "conv_id", "to_conv", "to_turn").agg(F.sum("chars").alias("votes"))
    best = F.max_by(F.struct("to_conv", "to_turn", "votes"), F.struct("votes", (F.col("to_conv") == F.col("conv_id")).cast("int").alias("same"), (-F.col("to_conv")).alias("c"), (-F.col("to_turn")).alias("t")))
    return votes.groupBy("rid", "level").agg(best.alias("b")).select("rid", "level", "b.*")


def previous_turns(parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn, previous)`` of the distinct turns, by windows of bounded size."""
    turns = parsed.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").count().select("conv_id", "turn", F.floor(F.col("turn") / TURN_BLOCK).alias("part"))
    parts = turns.groupBy("conv_id", "part").agg(F.max("turn").alias("last"))
    parts = parts.select("conv_id", "part", F.lag("last").over(Window.partitionBy("conv_id").orderBy("part")).alias("before"))
    inside = F.lag("turn").over(Window.partitionBy("conv_id", "part").orderBy("turn"))
    return turns.withColumn("inside", inside).join(parts, ["conv_id", "part"]).select("conv_id", "turn", F.coalesce("inside", "before").alias("previous"))


def format_chats(messages: DataFrame) -> DataFrame:
    """``(thread_id, conv_id, turn, role, content, n_quotes, n_linked, parent_conv, parent_turn, by_quote, formatted)``,
    one row a message; ``thread_id, conv_id, turn`` is the reply order.

    The parent is the message quoted at the lowest level that links, else the turn before in the conversation; no
    message of an earlier turn, no parent. A null text is empty, a null role ''; a message without conversation or turn
    links with nothing and has no thread; repeated rows are returned each; an empty table gives no rows; other columns
    are ignored.
    """
    parsed = write_shared(parse_messages(messages), "chat")
    links = write_shared(quotation_links(parsed), "chat-links")
    direct = links.groupBy("rid").agg(F.min_by(F.struct("to_conv", "to_turn"), "level").alias("to"), F.count("*").alias("n_linked"))
    joined = parsed.join(direct, "rid", "left").join(previous_turns(parsed), ["conv_id", "turn"], "left")
    across = parsed.select("rid", "conv_id").join(links, "rid").where("conv_id <> to_conv")
    threads = connected_components(across.select(F.col("conv_id").alias("a"), F.col("to_conv").alias("b")), "chat-threads")
    joined = joined.join(threads.select(F.col("node").alias("conv_id"), "component"), "conv_id", "left")
    by_quote = F.col("to").isNotNull()
    return joined.select(
        F.when(F.col("turn").isNotNull(), F.coalesce("component", "conv_id")).alias("thread_id"),
        "conv_id",
        "turn",
        "role",
        "content",
        F.size("passages").cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.when(by_quote, F.col("to.to_conv")).when(F.col("previous").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(by_quote, F.col("to.to_turn")).otherwise(F.col("previous")).alias("parent_turn"),
        by_quote.alias("by_quote"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>\n")).alias("formatted"),
    )


ORACLE = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, lower(trim(coalesce(role, ''))) AS said, coalesce(text, '') AS text FROM conversations
), split AS (
  SELECT rid, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS k FROM base
), marked AS (
  SELECT rid, k, length(regexp_replace(regexp_extract(line, '^[ \t]{0,3}((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^[ \t]{0,3}((?:>[ \t]?)+)', '') AS body FROM split
), told AS (
  SELECT *, coalesce(lead(level) OVER (PARTITION BY rid ORDER BY k), 0) AS following FROM marked
), kept AS (
  SELECT * FROM told WHERE NOT (following > level AND regexp_matches(body, '(?i)^\s*(?:on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$'))
), own AS (
  SELECT b.rid, conv_id, turn, CASE said WHEN 'human' THEN 'user' WHEN 'prompter' THEN 'user' WHEN 'bot' THEN 'assistant' WHEN 'gpt' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE said END AS role,
    trim(regexp_replace(CASE WHEN contains(text, '>') THEN coalesce((SELECT string_agg(body, chr(10) ORDER BY k) FROM kept WHERE kept.rid = b.rid AND level = 0), '') ELSE text END, '^\s+|\s+$', '', 'g')) AS content FROM base b
), turned AS (
  SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY k) AS run FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY rid ORDER BY k), 0) AS before FROM kept)
), passages AS (
  SELECT rid, level, run, string_agg(body, chr(10) ORDER BY k) AS body FROM turned WHERE level > 0 GROUP BY ALL
), quoted AS (
  SELECT DISTINCT rid, level, run, trim(lower(regexp_replace(part, '\s+', ' ', 'g'))) AS key FROM (SELECT rid, level, run, unnest(list_concat([body], string_split(body, chr(10)))) AS part FROM passages)
), owned AS (
  SELECT DISTINCT conv_id, turn, trim(lower(regexp_replace(part, '\s+', ' ', 'g'))) AS key FROM (SELECT conv_id, turn, unnest(list_concat([content], string_split(content, chr(10)))) AS part FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), wanted AS (SELECT o.* FROM owned o WHERE length(key) >= 12 AND key IN (SELECT key FROM quoted)
), first AS (SELECT key, conv_id AS oc, min(turn) AS ot FROM wanted GROUP BY ALL
), earliest AS (SELECT key, min(oc) AS ec, arg_min(ot, oc) AS et FROM first GROUP BY key
), votes AS (
  SELECT q.rid, q.level, m.conv_id, coalesce(f.oc, CASE WHEN ec < m.conv_id THEN ec END) AS tc, CASE WHEN f.oc IS NOT NULL THEN f.ot WHEN ec < m.conv_id THEN et END AS tt, sum(length(q.key)) AS votes
  FROM quoted q JOIN own m USING (rid) LEFT JOIN first f ON f.key = q.key AND f.oc = m.conv_id AND f.ot < m.turn LEFT JOIN earliest e ON e.key = q.key
  WHERE length(q.key) >= 12 AND m.conv_id IS NOT NULL AND m.turn IS NOT NULL GROUP BY ALL
), links AS (
  SELECT rid, level, conv_id, first(tc ORDER BY votes DESC, (tc = conv_id) DESC, tc, tt) AS tc, first(tt ORDER BY votes DESC, (tc = conv_id) DESC, tc, tt) AS tt FROM votes WHERE tc IS NOT NULL GROUP BY ALL
), direct AS (SELECT rid, arg_min(tc, level) AS tc, arg_min(tt, level) AS tt, count(*) AS n FROM links GROUP BY rid
), across AS (SELECT DISTINCT conv_id AS a, tc AS b FROM links WHERE conv_id <> tc UNION SELECT DISTINCT tc, conv_id FROM links WHERE conv_id <> tc
), reach AS (SELECT a AS conv_id, a AS r FROM across UNION SELECT conv_id, b FROM reach JOIN across ON r = a
), threads AS (SELECT conv_id, min(r) AS thread FROM reach GROUP BY conv_id
), turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM own WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), numbers AS (SELECT rid, count(*) AS n FROM passages GROUP BY rid)
SELECT CASE WHEN o.turn IS NOT NULL THEN coalesce(thread, o.conv_id) END AS thread_id, o.conv_id, o.turn, role, content, coalesce(numbers.n, 0) AS n_quotes, coalesce(d.n, 0) AS n_linked,
  CASE WHEN d.rid IS NOT NULL THEN tc WHEN previous IS NOT NULL THEN o.conv_id END AS parent_conv, CASE WHEN d.rid IS NOT NULL THEN tt ELSE previous END AS parent_turn, d.rid IS NOT NULL AS by_quote,
  concat('<|', role, '|>', chr(10), content, chr(10), '<|end|>', chr(10)) AS formatted
FROM own o LEFT JOIN direct d USING (rid) LEFT JOIN threads ON threads.conv_id = o.conv_id LEFT JOIN turns t ON t.conv_id = o.conv_id AND t.turn = o.turn LEFT JOIN numbers USING (rid)
"""
