"""Chat formatting with a grammar round trip, in DataFrame expressions only.

The grammar of a formatted conversation:

    conversation = turn { turn }
    turn         = "### " role ": " text " </turn>\\n"

A parser for it is deterministic: take off the first "### " and the last
" </turn>\\n", cut at every " </turn>\\n### ", cut each part at its first ": "
and undo the escapes.  Escapes are a backslash and a letter: \\b backslash,
\\h hash, \\l less-than, \\c colon.  An encoder writes \\b for every backslash
first, so plain replacements, \\b last, undo it exactly.

A conversation is rendered as it is; the parser reads it back; if the turns it
recovers aren't the source's, the next escape level is tried, until they are:

    0  nothing is escaped
    1  backslashes, and the "<" of each "</turn>"
    2  backslashes, "#", "<" and, in roles, ":"

Level 2 leaves no "#" or "<" outside the template and no ":" in a role, so its
round trip can't fail; ``raise_error`` stands behind it all the same.

Null roles and texts count as empty.  Turns are ordered by (turn, role, text),
nulls first, so ties and repeated rows have one order; repeated rows are turns
like any other.  Rows with a null conv_id form one conversation.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
BETWEEN = CLOSE + OPEN


def escape(text: Column, level: int, role: bool = False) -> Column:
    if level == 0:
        return text
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    if level == 1:
        return F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))
    out = F.replace(F.replace(out, F.lit("#"), F.lit("\\h")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    for code, plain in (("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(turns: Column, level: int) -> Column:
    """The formatted text of an array of (role, text)."""
    one = lambda t: F.concat(F.lit(OPEN), escape(t["role"], level, True), F.lit(SEP), escape(t["text"], level), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The array of (role, text) that the grammar reads in a formatted text."""
    inner = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))

    def turn(part: Column) -> Column:
        at = F.instr(part, F.lit(SEP))
        head = F.when(at > 0, F.substring(part, F.lit(1), at - 1)).otherwise(part)
        body = F.when(at > 0, F.substring(part, at + len(SEP), F.length(part))).otherwise(F.lit(""))
        return F.struct(unescape(head).alias("role"), unescape(body).alias("text"))

    return F.transform(F.split(inner, BETWEEN, -1), turn)


def loss_spans(formatted: Column, role: str) -> Column:
    """(start, length) in code points, from 1, of each text of ``role`` as it stands in the formatted text."""
    inner = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))

    def step(state: Column, part: Column) -> Column:
        at = F.instr(part, F.lit(SEP))
        body = F.struct((state["at"] + at + len(SEP) - 1).alias("start"), (F.length(part) - at - len(SEP) + 1).alias("len"))
        mine = F.substring(part, F.lit(1), at - 1) == F.lit(role)
        return F.struct((state["at"] + F.length(part) + len(BETWEEN)).alias("at"), F.when(mine, F.concat(state["spans"], F.array(body))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(len(OPEN) + 1).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))
    return F.aggregate(F.split(inner, BETWEEN, -1), start, step, lambda s: s["spans"])


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, level, turns (reparsed), loss_spans.

    The rows of a conversation meet in one task, as its text is one value; nothing else is gathered.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    given = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    df = given.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tries = [render(F.col("source"), k) for k in (0, 1, 2)]
    fits = [parse(t) == F.col("source") for t in tries]
    level = F.when(fits[0], 0).when(fits[1], 1).when(fits[2], 2).otherwise(F.raise_error(F.lit("a conversation didn't survive the round trip")).cast("int"))
    df = df.withColumn("level", level)
    df = df.select("conv_id", "level", F.when(F.col("level") == 0, tries[0]).when(F.col("level") == 1, tries[1]).otherwise(tries[2]).alias("formatted"))
    return df.select("conv_id", "formatted", "level", parse(F.col("formatted")).alias("turns"), loss_spans(F.col("formatted"), loss_role).alias("loss_spans"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns, read back from the formatted text and its loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["len"]))), "")
    return formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The conversation that the query adds, as rows of conversations.
ADDED = r"""SELECT * FROM VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', r'\### Assistant: </turn> ok'),
    (CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)"""


def op8_chat(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return digests(format_conversations(rows.unionByName(spark.sql(ADDED))))


def _duck(level: int) -> str:
    text, role = "t.text", "t.role"
    if level:
        text, role = f"replace({text}, '\\', '\\b')", f"replace({role}, '\\', '\\b')"
    if level == 1:
        text, role = (f"replace({x}, '</turn>', '\\l/turn>')" for x in (text, role))
    if level == 2:
        text, role = (f"replace(replace({x}, '#', '\\h'), '<', '\\l')" for x in (text, role))
        role = f"replace({role}, ':', '\\c')"
    return f"array_to_string(list_transform(src, lambda t: '### ' || {role} || ': ' || {text} || ' </turn>' || chr(10)), '')"


ORACLE = f"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
grouped AS (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS src,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS loss
    FROM given GROUP BY conv_id),
tried AS (SELECT *, {_duck(0)} AS f0, {_duck(1)} AS f1, {_duck(2)} AS f2 FROM grouped),
cut AS (
    SELECT *, string_split(f0[5:length(f0) - 9], ' </turn>' || chr(10) || '### ') AS p0,
        string_split(f1[5:length(f1) - 9], ' </turn>' || chr(10) || '### ') AS p1 FROM tried),
read_back AS (
    SELECT *,
        list_transform(p0, lambda p: struct_pack(role := {{u}}(CASE WHEN contains(p, ': ') THEN p[1:instr(p, ': ') - 1] ELSE p END), text := {{u}}(CASE WHEN contains(p, ': ') THEN p[instr(p, ': ') + 2:] ELSE '' END))) AS t0,
        list_transform(p1, lambda p: struct_pack(role := {{u}}(CASE WHEN contains(p, ': ') THEN p[1:instr(p, ': ') - 1] ELSE p END), text := {{u}}(CASE WHEN contains(p, ': ') THEN p[instr(p, ': ') + 2:] ELSE '' END))) AS t1
    FROM cut)
SELECT conv_id, CAST(len(src) AS BIGINT) AS n_turns,
    sha256(array_to_string(list_transform(src, lambda t: t.role || chr(10) || t.text || chr(10)), '')) AS turns_sha256,
    CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(length(CASE WHEN t0 = src THEN f0 WHEN t1 = src THEN f1 ELSE f2 END) AS BIGINT) AS formatted_chars
FROM read_back
"""


def _inline(sql: str) -> str:
    """Write the unescape function {u}(x) out as nested replacements."""
    while "{u}(" in sql:
        at = sql.index("{u}(")
        depth, end = 0, at + 3
        for end in range(at + 3, len(sql)):
            depth += (sql[end] == "(") - (sql[end] == ")")
            if depth == 0:
                break
        inner = sql[at + 4 : end]
        sql = sql[:at] + f"replace(replace(replace(replace({inner}, '\\h', '#'), '\\l', '<'), '\\c', ':'), '\\b', '\\')" + sql[end + 1 :]
    return sql


ORACLE_SQL = _inline(ORACLE)
