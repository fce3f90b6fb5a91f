"""Chat formatting into budgeted, turn-aligned windows, with DataFrame functions only.

Template: ``<turn ROLE>TEXT</turn>`` for each turn.  Inside texts a backslash
becomes ``\\b`` and ``<`` becomes ``\\l`` (in roles ``>`` becomes ``\\g`` too), so
a mark can never come from a text, and plain replacements in the opposite order
undo it.

A turn costs a quarter of its formatted code points, rounded up: an estimate of
its tokens, not their number.  Prefix sums of these costs cut a conversation into
stripes of half the room that the budget leaves beside system turn and history; a
turn larger than a stripe stands alone.  Every window after the first repeats the
system turn (a first turn with role ``system``) and up to two turns before it, if
these cost at most ``history``.  A system turn that costs more than half of
what history leaves of the budget is not repeated, but cut like any other turn.  Beside
a turn that stands alone, history gives way first, then the system turn.  So
no window exceeds the budget unless one single turn does: turns are never cut.
Repeated turns are outside the loss mask; each assistant turn is under it
exactly once.

Defined results: null text or role counts as empty; turns are ordered by turn,
then role, then text, null turns first, so repeated turn numbers are all kept;
rows with a null conv_id form one conversation; an empty table gives no rows.
A conversation is a unit of the result, so its rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET, HISTORY, HISTORY_TURNS = 4096, 512, 2
OPEN, CLOSE = "<turn ", "</turn>"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replace(c, ("\\", "\\b"), ("<", "\\l"))


def unescape(c: Column) -> Column:
    return _replace(c, ("\\l", "<"), ("\\g", ">"), ("\\b", "\\"))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss, n_repeated, cost) for each window.

    ``loss``: array of (begin, end) code point ranges of ``formatted``.  The
    first ``n_repeated`` turns of a window are repeated from earlier ones.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    t = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    head = F.concat(F.lit(OPEN), _replace(escape(F.col("role")), (">", "\\g")), F.lit(">"))
    body = escape(F.col("text"))
    t = t.select(
        "conv_id", "turn", "role", "text",
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        F.char_length(head).alias("b0"),
        (F.char_length(head) + F.char_length(body)).alias("b1"),
    )
    t = t.withColumn("pos", F.row_number().over(order))
    t = t.withColumn("chars", F.char_length("piece"))
    full = F.expr("cast((chars + 3) div 4 as bigint)")
    t = t.withColumn("is_sys", (F.col("pos") == 1) & (F.col("role") == "system") & (2 * full <= budget - history))
    t = t.withColumn("cost", F.when(F.col("is_sys"), F.lit(0).cast("bigint")).otherwise(full)).withColumn(
        "sys_cost", F.when(F.col("is_sys"), full).otherwise(F.lit(0).cast("bigint"))
    )
    t = t.withColumn("before", F.coalesce(F.sum("cost").over(past), F.lit(0).cast("bigint")))
    t = t.withColumn("sys", F.sum("sys_cost").over(whole)).withColumn("half", F.expr(f"greatest(({budget - history} - sys) div 2, 1)"))
    t = t.withColumn("stripe", F.expr("before div half")).withColumn("big", F.col("cost") > F.col("half"))
    # a turn that stands alone and has no room for the system turn
    t = t.withColumn("bare", F.col("big") & (F.col("sys") > 0) & (F.col("cost") + F.col("sys") > budget))
    after_sys = F.coalesce(F.lag("is_sys").over(order), F.lit(False))
    begins = (
        (F.col("pos") > 1)
        & (~after_sys | F.col("bare"))
        & (
            F.col("big")
            | F.coalesce(F.lag("big").over(order), F.lit(False))
            | (F.col("stripe") != F.lag("stripe").over(order))
        )
    )
    t = t.withColumn("begins", F.coalesce(begins, F.lit(False)).cast("int"))
    t = t.withColumn(
        "win", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    )
    t = t.withColumn("last_win", F.max("win").over(whole))
    t = t.withColumn("bare_wins", F.collect_set(F.when(F.col("bare"), F.col("win"))).over(whole))
    # what repeated turns may cost beside the turn that begins the window
    t = t.withColumn(
        "spare",
        F.when(F.col("big"), F.greatest(F.lit(-1), budget - F.col("cost") - F.when(F.col("bare"), F.lit(0)).otherwise(F.col("sys")))).otherwise(history),
    )
    again = [
        F.when(
            ~F.col("is_sys")
            & (F.lead("win", j).over(order) != (F.lead("win", j - 1).over(order) if j > 1 else F.col("win")))
            & (F.lead("before", j).over(order) - F.col("before") <= F.least(F.lit(history), F.lead("spare", j).over(order))),
            F.lead("win", j).over(order),
        )
        for j in range(1, HISTORY_TURNS + 1)
    ]
    t = t.withColumn(
        "at",
        F.concat(
            F.array(F.struct(F.col("win").alias("w"), F.lit(True).alias("own"))),
            F.transform(
                F.filter(F.array(*again), lambda x: x.isNotNull()),
                lambda x: F.struct(x.alias("w"), F.lit(False).alias("own")),
            ),
            F.when(
                F.col("is_sys") & (F.col("last_win") > 0),
                F.transform(
                    F.array_except(F.sequence(F.lit(1), F.greatest(F.col("last_win"), F.lit(1))), F.col("bare_wins")),
                    lambda x: F.struct(x.alias("w"), F.lit(False).alias("own")),
                ),
            ).otherwise(F.expr("array_remove(array(named_struct('w', 0, 'own', false)), named_struct('w', 0, 'own', false))")),
        ),
    )
    placed = t.select("conv_id", "pos", "role", "piece", "chars", "b0", "b1", F.expr("cost + sys_cost").alias("cost"), F.explode("at").alias("at"))
    placed = placed.select("*", F.col("at.w").alias("window"), F.col("at.own").alias("own")).drop("at")
    inside = Window.partitionBy("conv_id", "window").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("base", F.coalesce(F.sum("chars").over(inside), F.lit(0).cast("bigint")))
    rows = placed.groupBy("conv_id", "window").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "pos", "piece", "own", (F.col("own") & (F.col("role") == "assistant")).alias("learn"),
                    (F.col("base") + F.col("b0")).alias("begin"), (F.col("base") + F.col("b1")).alias("end"),
                )
            )
        ).alias("rows"),
        F.sum("cost").alias("cost"),
    )
    return rows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("rows", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(
            F.filter("rows", lambda x: x["learn"]),
            lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")),
        ).alias("loss"),
        F.size(F.filter("rows", lambda x: ~x["own"])).alias("n_repeated"),
        "cost",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of each conversation, recovered from the formatted windows alone."""
    pieces = F.split(F.col("formatted"), CLOSE)  # the part after the last mark is empty
    own = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - F.col("n_repeated") - 1, F.lit(0)))
    role = lambda x: F.substring_index(x, ">", 1)
    turn = lambda x: F.concat(
        unescape(F.substr(role(x), F.lit(len(OPEN) + 1))), F.lit("\n"),
        unescape(F.substr(x, F.char_length(role(x)) + 2)), F.lit("\n"),
    )
    learned = F.transform(
        "loss", lambda s: unescape(F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))
    )
    per = windows.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform(own, turn), "").alias("turns"),
            F.array_join(learned, "").alias("learned"),
        ).alias("part"),
        F.size(own).cast("long").alias("n"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    whole = per.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    turns = F.array_join(F.transform("parts", lambda p: p["turns"]), "")
    learned = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    return whole.select(
        "conv_id", "n_turns", turns.alias("turns"), learned.alias("learned"), "formatted_chars"
    ).select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )
