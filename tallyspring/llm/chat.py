"""Chat formatting with Spark expressions only.

The rows of a conversation are collected as structs and sorted; adjacent turns of one role are merged into a block
by array functions, and the blocks are concatenated. Template:

    <turn>ROLE
    TEXT<also>NEXT TEXT OF THE SAME ROLE</turn>

In texts and roles a backslash becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles a line end becomes ``\\n``), so a marker
can't appear inside a text, and reading back gives every text as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ALSO, CLOSE = "<turn>", "<also>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text starts a pair, so the two replacements can't meet."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns with one role, from the sorted array of turns."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def blocks(s: Column) -> Column:
        def block(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(s, k + 1), F.size(turns))
            return F.struct(F.get(turns, at)["role"].alias("role"), F.transform(F.slice(turns, at + 1, end - at), lambda t: t["text"]).alias("texts"))

        return F.transform(s, block)

    return F.get(F.transform(F.array(starts), blocks), F.lit(0))


def running_totals(numbers: Column) -> Column:
    """Sums of an array's numbers up to each. An array that grows by one is copied each time, so totals are taken in about
    sqrt(n) runs of sqrt(n) numbers, and then of the runs: n * sqrt(n) small steps for n numbers."""

    def totals(run: Column) -> Column:
        def add(state: Column, x: Column) -> Column:
            return F.struct((state["sum"] + x).alias("sum"), F.concat(state["all"], F.array(state["sum"] + x)).alias("all"))

        return F.aggregate(run, F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all")), add, lambda state: state["all"])

    def of(told: Column) -> Column:
        values, width = told["values"], told["width"]
        runs = F.transform(F.sequence(F.lit(0), F.size(values) - 1, width), lambda at: totals(F.slice(values, at + 1, width)))

        def shifted(both: Column) -> Column:
            def moved(before: Column) -> Column:
                return F.flatten(F.transform(both, lambda run, k: let(F.coalesce(F.get(before, k - 1), F.lit(0)), lambda ahead: F.transform(run, lambda x: x + ahead))))

            return let(totals(F.transform(both, lambda run: F.element_at(run, -1))), moved)

        return let(runs, shifted)

    root = lambda values: F.struct(values.alias("values"), F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1)).alias("width"))
    return let(let(numbers, root), of)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def format_conversations(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: id, formatted, loss_spans.

    Turns stand by turn, then role, then text, so ties and repeated rows have a set order. A null text or role is
    empty; a null id is a conversation like others. ``loss_spans`` holds start and end (code points, end exclusive) in
    ``formatted`` of every text of ``loss_role``; markers bear no loss. Other columns are left out.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), escape_role(empty(role_col)).alias("role"), escape(empty(text_col)).alias("text")).alias("t"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    one = lambda b: F.concat(F.lit(OPEN), b["role"], F.lit("\n"), F.array_join(b["texts"], ALSO), F.lit(CLOSE))
    turns = F.col("turns")

    def with_lead(t: Column, i: Column) -> Column:
        """A turn's length with what stands before its text: the end of a block and the head of the next, or a mark."""
        head = len(OPEN) + F.length(t["role"]) + 1
        lead = F.when(i == 0, head).when(F.get(turns, i - 1)["role"] != t["role"], head + len(CLOSE)).otherwise(len(ALSO))
        return lead + F.length(t["text"])

    def span(t: Column, end: Column) -> Column:
        return F.struct(F.when(t["role"] == escape_role(F.lit(loss_role)), end - F.length(t["text"])).alias("start"), end.alias("end"))

    told = grouped.select("conv", "turns", running_totals(F.transform(turns, with_lead)).alias("ends"))
    spans = F.filter(F.zip_with("turns", "ends", span), lambda x: x["start"].isNotNull())
    formatted = F.array_join(F.transform(merged(turns), one), "")
    return told.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, one for each row that went in."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2)
        role = unescape_role(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(body, ALSO), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.filter(F.split(formatted, CLOSE), lambda b: b != ""), turns))


#: Code points of the pieces that spans are cut from.
PIECE = 1024


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. A place in a long string is found by counting from its
    start, so spans are cut from short pieces of it."""

    def cut(pieces: Column, s: Column) -> Column:
        first, last = (s["start"] / PIECE).cast("int"), (s["end"] / PIECE).cast("int")
        head = F.substring(F.get(pieces, first), s["start"] % PIECE + 1, s["end"] - s["start"])
        tail = F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), s["end"] % PIECE)
        return F.when(first == last, head).otherwise(F.concat(head, F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), tail))

    pieces = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(pieces, lambda p: F.array_join(F.transform(spans, lambda s: unescape(F.coalesce(cut(p, s), F.lit("")))), ""))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from the output of ``format_conversations``."""
    turns = read_back(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.select(conv_col, "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
