"""Chat formatting with a grammar round trip (native).

A formatted conversation is a run of turns ``[INST]`` level role ``[/INST]`` body ``</s>``.
Level 0 holds role and body as they are, level 1 with every control string
broken by a backslash; neither may hold a control string, so the parser takes a turn
with one for no turn. A conversation is rendered at level 0, parsed and compared
with its source. If it differs, each of its turns that does not come back when it is rendered and parsed
on its own is escaped, and the whole compared again; if it still differs, all turns are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
TRAINED = "assistant"
_CONTROLS = r"(?:(\[)(/?INST\]))|(?:(<)(/s>))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROLS, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turn(t: Column, bare: Column) -> Column:
    whole = F.concat(F.lit(OPEN + "0"), t["role"], F.lit(CLOSE), t["text"], F.lit(END))
    safe = F.concat(F.lit(OPEN + "1"), escape(t["role"]), F.lit(CLOSE), escape(t["text"]), F.lit(END))
    return F.when(bare, whole).otherwise(safe)


def render(turns: Column, plain: Column) -> Column:
    """turns: array of (role, text); plain: array of booleans, the turns that need no escape."""
    return F.array_join(F.zip_with(turns, plain, _turn), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: role, text, and skip and keep, the code points of its head and of its body.

    Deterministic: a turn ends at the first END, its head at the first CLOSE. What
    is no turn, or holds a further control string, comes back as a turn of null role.
    """
    pieces = F.split(formatted, END.replace("/", "\\/"), -1)
    pieces = F.when(F.get(pieces, F.size(pieces) - 1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)

    def one(p: Column) -> Column:
        at = F.instr(p, CLOSE)
        level = F.substring(p, len(OPEN) + 1, 1)
        role = F.substring(p, F.lit(len(OPEN) + 2), at - len(OPEN) - 2)
        skip = at + len(CLOSE) - 1
        body = F.substring(p, skip + 1, F.length(p))
        free = ~(F.contains(role, F.lit(OPEN)) | F.contains(body, F.lit(OPEN)) | F.contains(body, F.lit(CLOSE)))
        good = F.startswith(p, F.lit(OPEN)) & level.isin("0", "1") & (at > 0) & free
        read = lambda x: F.when(level == "1", unescape(x)).otherwise(x)
        return F.struct(
            F.when(good, read(role)).alias("role"),
            F.when(good, read(body)).otherwise(p).alias("text"),
            F.when(good, skip).otherwise(F.lit(0)).cast("int").alias("skip"),
            F.when(good, F.length(body)).otherwise(F.length(p)).cast("int").alias("keep"),
        )

    return F.transform(pieces, one)


def _same(a: Column, b: Column) -> Column:
    return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])


def _comes_back(t: Column) -> Column:
    """Whether a turn rendered as it is, parsed on its own, is the same turn."""
    got = parse(_turn(t, F.lit(True)))
    return (F.size(got) == 1) & F.coalesce(_same(F.get(got, F.lit(0)), t), F.lit(False))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, formatted, turns (as parsed from formatted), mask, round_trip.

    mask has for each turn the code points to skip, to train on (an assistant's
    body as it stands in formatted) and to skip after it. Null texts and roles
    count as empty; a null conv is one conversation; ties of turn are ordered by
    role and text, repeated rows stay; an empty table gives none. A
    conversation is one output value, so its turns meet in one row.
    """
    turns = rows.select(rows[conv].alias("conv"), F.struct(rows[turn].alias("turn"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text")).alias("t"))
    chats = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    equal = lambda got: (F.size(got) == F.size("turns")) & F.forall(F.zip_with(got, "turns", _same), lambda x: x)
    done = chats.withColumns({"formatted": F.lit(""), "got": F.expr("cast(null as array<struct<role:string,text:string,skip:int,keep:int>>)"), "fine": F.lit(False)})
    for plain in (F.transform("turns", lambda t: F.lit(True)), F.transform("turns", _comes_back), F.transform("turns", lambda t: F.lit(False))):
        done = done.withColumn("formatted", F.when(F.col("fine"), F.col("formatted")).otherwise(render(F.col("turns"), plain)))
        done = done.withColumn("got", F.when(F.col("fine"), F.col("got")).otherwise(parse(F.col("formatted"))))
        done = done.withColumn("fine", F.col("fine") | F.coalesce(equal("got"), F.lit(False)))
    trained = lambda t: t["role"] == TRAINED
    mask = F.transform(
        "got",
        lambda t: F.struct(
            F.when(trained(t), t["skip"]).otherwise(t["skip"] + t["keep"] + len(END)).alias("skip"),
            F.when(trained(t), t["keep"]).otherwise(0).alias("train"),
            F.when(trained(t), len(END)).otherwise(0).alias("after"),
        ),
    )
    return done.select(F.col("conv").alias(conv), "formatted", F.col("got").alias("turns"), mask.alias("mask"), F.col("fine").alias("round_trip"))


def under_mask(formatted: Column, mask: Column) -> Column:
    """The stretches of formatted that the mask trains on, each unescaped if its turn says so."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["skip"]
        body = F.substring(formatted, begin, m["train"])
        level = F.substring(formatted, acc["at"] + len(OPEN), F.lit(1))
        own = F.when(m["after"] > 0, F.array(F.when(level == "1", unescape(body)).otherwise(body))).otherwise(F.array().cast("array<string>"))
        return F.struct((begin + m["train"] + m["after"]).alias("at"), F.concat(acc["out"], own).alias("out"))

    return F.aggregate(mask, start, step)["out"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = f"{END}{OPEN} ok {CLOSE}"
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(hard).alias("text"))
    chats = format_chats(rows.unionByName(planted))
    chats = chats.withColumn("loss", F.array_join(under_mask(F.col("formatted"), F.col("mask")), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = f"""
with told as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{END}{OPEN} ok {CLOSE}'
  union all select -1, 1, 'assistant', '{END}{OPEN} ok {CLOSE}'
), whole as (
  select *, contains(role, '{OPEN}') or contains(text, '{OPEN}') or contains(role, '{CLOSE}') or contains(text, '{CLOSE}') or contains(role, '{END}') or contains(text, '{END}') as clash from told
), sized as (
  select *, case when clash then length(replace(replace(replace(replace(role, '\\', '\\\\'), '{OPEN}', '{OPEN}+'), '{CLOSE}', '{CLOSE}+'), '{END}', '{END}+'))
    + length(replace(replace(replace(replace(text, '\\', '\\\\'), '{OPEN}', '{OPEN}+'), '{CLOSE}', '{CLOSE}+'), '{END}', '{END}+'))
    else length(role) + length(text) end + {len(OPEN) + 1 + len(CLOSE) + len(END)} as chars from whole
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = '{TRAINED}'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{TRAINED}'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""
