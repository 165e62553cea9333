"""Chat formatting by quotation linking.

Lines that begin with > marks are quotations, their level the number of marks. Lines of one level that follow each other
without a blank line are a passage. Passages and single lines are normalised (lower case, white space folded) and hashed;
a quoted one is joined to the first message of the conversation that said the same itself, before the quoting
message, and the two texts are compared. Only conversations in which something is quoted are read for that. A message replies to the message that most of its least-level linked quotation (in characters) comes from, the
later one among equals. Attribution lines before a quotation ("... wrote:") and the quotations are left out of the text.

Order: a message that replies to none begins a thread; threads follow each other by their first turn, messages in a
thread by turn, so a reply always comes after what it answers. `depth` counts replies up to the thread's first message;
it is found by pointer doubling, in as many rounds as the binary logarithm of the longest chain. No conversation is
gathered in one task: rows carry their order, and `in_order` sorts by ranges that may cut a conversation.

Null texts are empty messages. Messages with a null conversation or turn stay, unlinked, as threads of their own.
Passages and lines of any length but the empty ones are linked; their length only weighs votes. Repeated (conversation,
turn) rows stay each; a reply to such a turn is to either. A very long text costs time in proportion to its lines. An
empty table gives an empty result. Columns besides the four named are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import discard, materialise, table, work_dir

_MARKS = r"\A[ \t]*(?:>[ \t]?)+"
#: Stand between passages while they are put together, and count as blanks in comparisons.
_SIGNS = "\x01\x02"
#: Finds every text with a quotation, and a few others.
_QUOTES = r"(?m)^[ \t]*>"
_WROTE = r"(?i)\A[^\n>]{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*\z"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(text, _SIGNS, "  ")), r"\s+", " "))


def parsed(text: Column) -> Column:
    """Array of (level, body, joins): joins tells that a line goes on with the passage before it."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    marks = lambda line: F.regexp_extract(line, _MARKS, 0)
    return F.transform(lines, lambda x: F.struct((F.length(marks(x)) - F.length(F.translate(marks(x), ">", ""))).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body")))


def passages(lines: Column) -> Column:
    """Array of (level, text), from runs of lines of one level without a blank one between."""
    start, cut = _SIGNS

    def piece(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        body = F.translate(x["body"], _SIGNS, "  ")
        new = F.concat(F.lit(start), x["level"].cast("string"), F.lit(cut), body)
        goes_on = (i > 0) & (before["level"] == x["level"]) & (F.trim(before["body"]) != "") & (F.trim(x["body"]) != "")
        return F.when(goes_on, F.concat(F.lit("\n"), body)).otherwise(new)

    runs = F.split(F.array_join(F.transform(lines, piece), ""), start)
    return F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.struct(F.substring_index(r, cut, 1).cast("int").alias("level"), F.substring_index(r, cut, -1).alias("text")))


def _units(read: DataFrame, quoted: bool) -> DataFrame:
    """(conv_id, turn, level, text, h) of what each message quotes or says, once each."""
    fit = F.filter("units", lambda u: ((u["level"] > 0) == F.lit(quoted)) & (u["text"] != ""))
    # as texts, which array_distinct takes from a hash table
    told = F.array_distinct(F.transform(fit, lambda u: F.concat(u["level"].cast("string"), F.lit(" "), u["text"])))
    each = read.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(told).alias("u"))
    each = each.select("conv_id", "turn", F.substring_index("u", " ", 1).cast("int").alias("level"), F.expr("substring(u, instr(u, ' ') + 1)").alias("text"))
    return each.withColumn("h", F.xxhash64("text"))


def messages(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    plain = F.coalesce(F.col(text), F.lit(""))
    out = chats.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), parsed(plain).alias("lines"))
    out = out.withColumn("runs", passages(F.col("lines")))
    lines = F.transform("lines", lambda x: F.struct(x["level"].cast("int").alias("level"), normal(x["body"]).alias("text")))
    runs = F.transform("runs", lambda x: F.struct(x["level"].alias("level"), normal(x["text"]).alias("text")))
    # a line is its own words, unless it introduces a quotation
    said = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(x["body"].rlike(_WROTE) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)))
    whole = F.array_join(F.transform(said, lambda x: x["body"]), "\n")
    units = F.concat(runs, lines, F.array(F.struct(F.lit(0).alias("level"), normal(whole).alias("text"))))
    return out.select("conv_id", "turn", "role", F.trim(F.regexp_replace(F.regexp_replace(whole, r"\A\s+|\s+\z", ""), r"\n{3,}", "\n\n")).alias("text"), F.size(F.filter("runs", lambda r: r["level"] > 0)).alias("n_quotes"), units.alias("units"))


def replies(chats: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, parent) of the messages that quote an earlier one."""
    quoted = _units(messages(chats.filter(F.col(text).rlike(_QUOTES)), conv, turn, role, text), True)
    quoted = materialise(quoted)
    asked = quoted.select(F.col("conv_id").alias(conv)).distinct()
    said = _units(messages(chats.join(asked, conv, "left_semi"), conv, turn, role, text), False)
    said = said.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    said = said.groupBy("conv_id", "h", "text").agg(F.min("turn").alias("source"))
    linked = quoted.join(said, ["conv_id", "h", "text"]).filter("source < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "source").agg(F.sum(F.length("text")).alias("chars"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "source")).alias("best")).select("conv_id", "turn", F.col("best.source").alias("parent"))


def chains(found: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of the messages that reply, by pointer doubling; a round's table goes after the next."""
    spark = found.sparkSession
    folder = work_dir(spark)
    at = materialise(found.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), folder)
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        met = at.join(up, ["conv_id", "root"], "left")
        last, folder = folder, work_dir(spark)
        new = materialise(met.select("conv_id", "turn", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")), folder)
        discard(spark, last)
        at = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return at


def link(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, thread (its first turn), depth, turn, parent, role, text without quotations, n_quotes; a row a message."""
    read = messages(chats, conv, turn, role, text)
    found = materialise(replies(chats, conv, turn, role, text))
    out = read.select("conv_id", "turn", "role", "text", "n_quotes")
    deep = chains(found).join(found, ["conv_id", "turn"])
    out = out.join(deep, ["conv_id", "turn"], "left")
    return out.select("conv_id", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "turn", "parent", "role", "text", "n_quotes")


def in_order(linked: DataFrame, parts: int | None = None) -> DataFrame:
    """Conversations one after the other, each in reply order, in sorted ranges of rows."""
    by = ["conv_id", "thread", "turn"]
    dealt = linked.repartitionByRange(parts, *by) if parts else linked.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def op1_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_order(link(table(spark, sf_dir, "conversations")))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over messages that quote the ones before them: whole, in capitals, nested, with words of their own."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = lambda n: chats.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"t{n}"))
    rows = chats.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    return in_order(link(rows.select("conv_id", "turn", "role", F.expr(_QUOTING).alias("text"))))


#: An expression of both engines; t1 and t2 are the texts one and two turns before.
_QUOTING = """CASE WHEN turn % 5 = 1 AND t1 IS NOT NULL THEN concat('Someone wrote:', chr(10), '> ', replace(t1, chr(10), concat(chr(10), '> ')), chr(10), chr(10), text)
     WHEN turn % 5 = 2 AND t2 IS NOT NULL THEN concat('> > ', replace(upper(t2), chr(10), concat(chr(10), '> > ')), chr(10), '>', replace(t1, chr(10), concat(chr(10), '>')), chr(10), text)
     WHEN turn % 5 = 3 AND t2 IS NOT NULL THEN concat('> ', replace(t2, ' ', '  '), chr(10), text)
     WHEN turn % 5 = 4 AND t1 IS NOT NULL THEN concat('> ', t1, ' and more', chr(10), text) ELSE text END"""


ORACLE_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS i FROM m),
v AS (SELECT id, i, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS body
      FROM (SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS mark FROM l)),
w AS (SELECT *, CASE WHEN lag(level) OVER p = level AND trim(lag(body) OVER p) <> '' AND trim(body) <> '' THEN 0 ELSE 1 END AS new,
        coalesce(lead(level) OVER p, 0) AS following FROM v WINDOW p AS (PARTITION BY id ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM w),
runs AS (SELECT id, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS text FROM r GROUP BY id, run),
said AS (SELECT id, string_agg(body, chr(10) ORDER BY i) AS text FROM w
         WHERE level = 0 AND NOT (following > 0 AND regexp_matches(body, '(?i)^[^\n>]{0,200}\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$')) GROUP BY id),
units AS (SELECT DISTINCT id, level, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS text FROM
          (SELECT id, level, text FROM runs UNION ALL SELECT id, level, body FROM v UNION ALL SELECT id, 0, text FROM said)),
known AS (SELECT u.*, conv_id, turn FROM units u JOIN m USING (id) WHERE u.text <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
source AS (SELECT conv_id, text, min(turn) AS source FROM known WHERE level = 0 GROUP BY conv_id, text),
votes AS (SELECT k.conv_id, k.turn, k.level, source, sum(length(k.text)) AS chars FROM known k JOIN source s ON k.conv_id = s.conv_id AND k.text = s.text AND source < k.turn
          WHERE k.level > 0 GROUP BY ALL),
parent AS (SELECT conv_id, turn, arg_max(source, {'a': -level, 'b': chars, 'c': source}) AS parent FROM votes GROUP BY conv_id, turn),
chain AS (SELECT conv_id, turn, parent, parent AS root, 1 AS depth FROM parent
          UNION ALL SELECT c.conv_id, c.turn, c.parent, p.parent, c.depth + 1 FROM chain c JOIN parent p ON c.conv_id = p.conv_id AND c.root = p.turn),
top AS (SELECT conv_id, turn, parent, arg_max(root, depth) AS root, max(depth) AS depth FROM chain GROUP BY conv_id, turn, parent)
SELECT m.conv_id, coalesce(t.root, m.turn) AS thread, coalesce(t.depth, 0) AS depth, m.turn, t.parent, m.role,
       coalesce(trim(regexp_replace(regexp_replace(regexp_replace(s.text, '^\s+', ''), '\s+$', ''), '\n{3,}', chr(10) || chr(10), 'g')), '') AS text,
       (SELECT count(*) FROM runs WHERE runs.id = m.id AND level > 0) AS n_quotes
FROM m LEFT JOIN said s USING (id) LEFT JOIN top t ON m.conv_id = t.conv_id AND m.turn = t.turn
"""

QUOTED_SQL = ORACLE_SQL.replace("WITH RECURSIVE m AS", f"""WITH RECURSIVE quoting AS (SELECT conv_id, turn, role, {_QUOTING} AS text FROM conversations
  LEFT JOIN (SELECT conv_id, turn + 1 AS turn, text AS t1 FROM conversations) USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn + 2 AS turn, text AS t2 FROM conversations) USING (conv_id, turn)),
m AS""").replace("FROM conversations),\nl AS", "FROM quoting),\nl AS")
