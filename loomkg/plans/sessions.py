"""Session-log plans: message kinds, calls, costs, parent and bridge edges, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Price per million billable tokens by family; the roll-up prices unknown models as the dearest.
RATES = {"opus": 15.0, "sonnet": 3.0, "haiku": 1.0}
GRAINS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}
_ASSIGN = r"[\p{L}_][\p{L}\p{N}_]*=\S*"
_WRAPPERS = "sudo|time|nohup|exec|xargs|env|command"
_UNWRAP = "if|elif|then|else|do|while|until"
_REJECT = "for|case|in|done|fi|esac"
_TAKES_VALUE = ["-C", "-f", "-I", "-j", "-l", "-o", "-W"]
_BLOCKS = "struct<content: array<struct<type: string, name: string, text: string, input: struct<skill: string, subagent_type: string, command: string>>>>"


def rate(model: Column, unknown: float | None = 0.0) -> Column:
    out = F.lit(None).cast("double")
    for family, price in reversed(list(RATES.items())):
        out = F.when(F.lower(model).contains(family), F.lit(price)).otherwise(out)
    return F.coalesce(out, F.lit(max(RATES.values()) if unknown is None else unknown))


def billable(inp: Column, out: Column, read: Column, write: Column) -> Column:
    z = [F.coalesce(c.cast("double"), F.lit(0.0)) for c in (inp, out, read, write)]
    return z[0] + 5 * z[1] + 0.1 * z[2] + 1.25 * z[3]


def cost(model: Column, tokens: Column, unknown: float | None = 0.0) -> Column:
    return F.round(tokens * rate(model, unknown) / 1e6, 8)


def message_kind(kind: Column, is_meta: Column, block: Column, text: Column) -> Column:
    """One of nine kinds from the event's type, its meta flag, the type of its first block and its text.

    block is "string" where the content is a plain string instead of a list of blocks.
    """
    return (
        F.when((kind == "user") & F.coalesce(is_meta, F.lit(False)), "meta")
        .when((kind == "user") & (block == "string") & F.coalesce(text.rlike(r"^\s*<task-notification>"), F.lit(False)), "task_notification")
        .when((kind == "user") & (block == "string"), "human")
        .when((kind == "user") & (block == "tool_result"), "tool_result")
        .when(kind == "user", "user_text")
        .when((kind == "assistant") & (block == "thinking"), "thinking")
        .when((kind == "assistant") & (block == "tool_use"), "tool_use")
        .when(kind == "assistant", "assistant_text")
        .otherwise("other")
    )


def shell_segments(line: Column) -> Column:
    """(head, rest) of every command of a shell line: assignments, wrappers with their flags and control words skipped."""

    def head_and_rest(segment: Column) -> Column:
        words = F.concat(F.regexp_replace(F.trim(F.regexp_replace(segment, r"\s+", " ")), r"\s+", " "), F.lit(" "))
        rejected = words.rlike(rf"^(?:{_ASSIGN} )*+(?:(?:{_UNWRAP}) )*+(?:{_REJECT}) ")
        bare = F.regexp_replace(words, rf"^(?:{_ASSIGN} )*+(?:(?:{_UNWRAP}) )*+(?:(?:{_WRAPPERS}) (?:-\S* )*+(?:{_ASSIGN} )*+)*+", "")
        tokens = F.filter(F.split(bare, " "), lambda w: w != "")
        first = F.element_at(F.split(F.regexp_replace(F.get(tokens, F.lit(0)), r"^\(+", ""), "/"), -1)
        head = F.regexp_replace(first, r"[();&]+$", "")
        return F.when(~rejected & head.rlike(r"[\p{L}\p{N}]"), F.struct(head.alias("head"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("rest")))

    return F.filter(F.transform(F.split(F.coalesce(line, F.lit("")), r"\|\||&&|;|\|"), head_and_rest), lambda x: x.isNotNull())


def make_targets(rest: Column) -> Column:
    """Targets among the words behind `make`: flags with their values, assignments and redirections skipped."""

    def step(state: Column, word: Column) -> Column:
        passed = word.startswith("-") | word.rlike(rf"^{_ASSIGN}$") | word.rlike(r"^(?:[<>&]|\d[<>])")
        return F.struct(
            (~state["skip"] & word.isin(_TAKES_VALUE)).alias("skip"),
            F.when(state["skip"] | passed, state["out"]).otherwise(F.concat(state["out"], F.array(word))).alias("out"),
        )

    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(rest, start, step, lambda x: x["out"])


def cli_calls(events: DataFrame, id_col: str, line_col: str) -> DataFrame:
    """(id, position, call) of every program in a shell line."""
    return events.select(F.col(id_col), F.posexplode(F.transform(shell_segments(F.col(line_col)), lambda x: x["head"])).alias("position", "call"))


def event_calls(events: DataFrame, id_col: str, message_col: str) -> DataFrame:
    """(id, ord, call_type, call_name) of the calls in the blocks of a message in JSON; ord is the block's place.

    Types: tool, skill, subagent, cli and make_target from tool_use blocks, rule from reminders in text blocks.
    """

    def call(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("call_type"), name.alias("call_name"))

    def calls(block: Column) -> Column:
        name, given = block["name"], block["input"]
        skill, agent = F.trim(F.coalesce(given["skill"], F.lit(""))), F.trim(F.coalesce(given["subagent_type"], F.lit("")))
        tool = F.array(call("tool", name))
        shell = F.flatten(
            F.transform(
                shell_segments(given["command"]),
                lambda x: F.concat(F.array(call("cli", x["head"])), F.when(x["head"] == "make", F.transform(make_targets(x["rest"]), lambda m: call("make_target", m))).otherwise(F.array().cast("array<struct<call_type: string, call_name: string>>"))),
            )
        )
        reminders = F.regexp_extract_all(block["text"], F.lit(r"(?s)<system-reminder>(.*?)</system-reminder>"), F.lit(1))
        rules = F.flatten(F.transform(reminders, lambda r: F.regexp_extract_all(r, F.lit(r"Contents of\s+(/[^\s:'\"]+)"), F.lit(1))))
        return (
            F.when((block["type"] == "tool_use") & (name == "Skill") & (skill != ""), F.array(call("skill", skill)))
            .when((block["type"] == "tool_use") & (name == "Agent") & (agent != ""), F.array(call("subagent", agent)))
            .when((block["type"] == "tool_use") & (name == "Bash"), F.concat(tool, shell))
            .when((block["type"] == "tool_use") & (name != ""), tool)
            .when(block["type"] == "text", F.transform(rules, lambda r: call("rule", r)))
        )

    blocks = events.select(F.col(id_col), F.posexplode(F.from_json(message_col, _BLOCKS)["content"]).alias("ord", "block"))
    return blocks.select(id_col, "ord", F.explode(calls(F.col("block"))).alias("c")).select(id_col, "ord", "c.call_type", "c.call_name")


def parent_edges(events: DataFrame) -> DataFrame:
    """(src, dst): parent to child, where the parent is known."""
    return events.where("parent_uuid IS NOT NULL").select(F.col("parent_uuid").alias("src"), F.col("uuid").alias("dst")).join(events.select(F.col("uuid").alias("src")).distinct(), "src", "left_semi")


def bridge_edges(starts: DataFrame, results: DataFrame) -> DataFrame:
    """(src, dst): first tool result of a prompt to the start of the sub-session it caused. starts, results: (uuid, prompt_id, ts)."""
    by = Window.partitionBy("prompt_id").orderBy("ts", "uuid")
    first = results.withColumn("r", F.row_number().over(by)).where("r = 1").select("prompt_id", F.col("uuid").alias("src"))
    return starts.select("prompt_id", F.col("uuid").alias("dst")).join(first, "prompt_id").select("src", "dst")


def rollup(events: DataFrame, keys: list[str], distinct: str, value: str) -> DataFrame:
    """Keys with first and last time, count, distinct count and sum."""
    return events.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.count_distinct(distinct).alias("n_distinct"), F.sum(value).alias("total"))


def time_cube(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(granularity, bucket, keys, n, total) at four grains in one pass; null keys are ''."""
    grain = F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), F.date_trunc(u, "ts").alias("bucket")) for g, u in GRAINS.items()]))
    rows = events.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], F.col(value).alias("__v"), grain.alias("g"))
    return rows.groupBy("g.granularity", "g.bucket", *keys).agg(F.count("*").alias("n"), F.sum("__v").alias("total"))


def refresh_range(cube: DataFrame, path: str) -> None:
    """Overwrite only the granularities and buckets that the cube holds."""
    spark = cube.sparkSession
    day = cube.withColumn("bucket_day", F.to_date("bucket"))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("granularity", "bucket_day").parquet(path)
    del spark


def sequence_edges(events: DataFrame, group: str, order: list[str], node: str) -> DataFrame:
    """(src, dst) of consecutive rows in each group."""
    by = Window.partitionBy(group).orderBy(*order)
    return events.withColumn("dst", F.lead(node).over(by)).where("dst IS NOT NULL").select(F.col(node).alias("src"), "dst")
