r"""Chat formatting in token-budgeted windows.

A turn is written as ``<|turn|>role\ntext<|end|>\n``.  Inside roles and texts a backslash
is doubled and every control string of the usual chat templates is broken by a backslash
after its first character, so no control string survives, and dropping each backslash
that escapes gives the text back.

Windows: the prefix sum of turn tokens before a turn, divided by half of what the budget
leaves, gives the turn's bin.  Only the last turn of a bin can be longer than that half;
such a turn has a window of its own, the others of the bin share one, and so no window
exceeds the budget unless a single turn (or the system turn) does.  Every window begins
with the conversation's first system turn and then repeats at most ``history`` tokens of
the turns before it.  Only assistant texts that are not repeated bear loss.

Prefix sums are made in two steps, over runs of turn numbers and then inside them, and a
window collects what a budget holds; no task gathers a conversation.

Defined cases: a null text or role is empty; a null turn comes first and null conv_id is
one conversation; turns with one number are ordered by role and text; repeated rows each
count; further system turns are ordinary turns; a conversation of only a system turn has
one window; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
# Control strings of common chat templates.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET = 2048
HISTORY = 256
TURN_TOKENS = 4
RUN = 4096
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def turn_tokens(text: Column) -> Column:
    """A token for every four UTF-8 bytes, and the turn's marks."""
    return (F.floor((F.octet_length(text) + 3) / 4) + TURN_TOKENS).cast("long")


def _placed(conversations: DataFrame, budget: int, history: int, tokens: Column | None) -> DataFrame:
    """Each turn with its position, prefix sum, bin and the conversation's system turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        text.alias("text"),
        (turn_tokens(text) if tokens is None else tokens).cast("long").alias("tok"),
        F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(1 << 60))).alias("run"),
    ).withColumn("is_sys", F.col("role") == "system")
    order = F.struct("turn", "role", "text")
    sys = F.when(F.col("is_sys"), F.struct(order.alias("at"), F.col("text"), F.col("tok")))
    runs = t.groupBy("conv", "run").agg(
        F.sum("tok").alias("r_tok"), F.count("*").alias("r_n"), F.count_if("is_sys").alias("r_sys"), F.min(sys).alias("r_first")
    )
    conv = Window.partitionBy("conv")
    earlier = conv.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    runs = runs.select(
        F.col("conv").alias("_c"),
        F.col("run").alias("_r"),
        before("r_tok").alias("b_tok"),
        before("r_n").alias("b_n"),
        before("r_sys").alias("b_sys"),
        F.min("r_first").over(conv).alias("sys"),
        (F.sum("r_n").over(conv) == 1).alias("alone"),
    )
    t = t.join(runs, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("run") == F.col("_r"))).drop("_c", "_r")
    ordered = Window.partitionBy("conv", "run").orderBy("turn", "role", "text")
    inside = ordered.rowsBetween(Window.unboundedPreceding, -1)
    within = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0))
    t = t.withColumns(
        {
            "pos": F.col("b_n") + F.row_number().over(ordered) - 1,
            "n_sys": F.col("b_sys") + within(F.col("is_sys").cast("long")),
            "t_tok": F.col("b_tok") + within("tok"),
        }
    )
    sys_tok = F.coalesce(F.col("sys.tok"), F.lit(0))
    half = F.floor(F.greatest(F.lit(budget - history) - sys_tok, F.lit(budget // 4)) / 2)
    t = t.withColumns({"the_sys": F.col("is_sys") & (F.col("n_sys") == 0), "start": F.col("t_tok") - F.when(F.col("n_sys") > 0, sys_tok).otherwise(0), "half": half})
    t = t.withColumns({"bin": F.floor(F.col("start") / F.col("half")), "long": (F.col("tok") > F.col("half")).cast("int")})
    last = F.lag(F.when(F.col("the_sys"), F.lit(None)).otherwise(F.struct("bin", "long"))).over(ordered)
    first = ~last.eqNullSafe(F.struct("bin", "long"))
    return t.withColumn("sys_here", F.when((first | F.col("the_sys")) & F.col("sys").isNotNull(), F.struct("sys.at.turn", "sys.text", "sys.tok")))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Column | None = None) -> DataFrame:
    """conv_id, window, formatted, loss_spans, turns, repeated and n_tokens of every window.

    ``loss_spans`` are code point ranges of ``formatted``; ``turns`` and ``repeated`` tell
    for each turn in it its number and whether another window has it as its own.
    """
    t = _placed(conversations, budget, history, tokens)
    back = F.least(F.lit(history), F.col("half"))
    none = F.array().cast("array<struct<bin:bigint,long:int,new:boolean>>")
    to = lambda b, long, new: F.struct(b.cast("bigint").alias("bin"), long.cast("int").alias("long"), F.lit(new).alias("new"))
    own = F.array(to(F.col("bin"), F.col("long"), True))
    later = F.array(*[to(F.col("bin") + 1, F.lit(i), False) for i in (0, 1)])
    same = F.when(F.col("long") == 0, F.array(to(F.col("bin"), F.lit(1), False))).otherwise(none)
    goes = (
        F.when(F.col("the_sys"), F.when(F.col("alone"), F.array(to(F.lit(0), F.lit(0), True))).otherwise(none))
        .when(F.col("tok") <= back, F.concat(own, same, later))
        .otherwise(own)
    )
    sent = t.select("conv", "turn", "pos", "start", "tok", "role", "text", "the_sys", "half", "sys_here", F.explode(goes).alias("w"))
    item = F.struct("pos", "turn", "start", "tok", "role", "text", F.col("w.new").alias("new"), "the_sys")
    g = sent.groupBy("conv", F.col("w.bin").alias("bin"), F.col("w.long").alias("long")).agg(
        F.sort_array(F.collect_list(item)).alias("items"),
        F.min(F.when(F.col("w.new"), F.col("start"))).alias("first"),
        F.max(F.when(F.col("w.new"), F.col("sys_here"))).alias("sys"),
        F.min("half").alias("half"),
    )
    g = g.where("first is not null")
    fit = lambda x: x.new | ((x.start >= F.col("first") - F.least(F.lit(history), F.col("half"))) & (x.start < F.col("first")))
    made = lambda turn, role, text, tok, rep: F.struct(turn.alias("turn"), escape_role(role).alias("role"), escape(text).alias("text"), tok.alias("tok"), rep.alias("repeated"), (~rep & (role == LOSS_ROLE)).alias("loss"))
    turns = F.transform(F.filter("items", lambda x: fit(x) & ~x.the_sys), lambda x: made(x.turn, x.role, x.text, x.tok, ~x.new))
    head = F.array(made(F.col("sys.turn"), F.lit("system"), F.col("sys.text"), F.col("sys.tok"), F.col("first") != 0))
    g = g.select("conv", (F.col("bin") * 2 + F.col("long")).alias("window"), F.when(F.col("sys").isNotNull(), F.concat(head, turns)).otherwise(turns).alias("turns"))
    lead = lambda x: F.lit(len(TURN) + 1) + F.length(x.role)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn:bigint,start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a.at + lead(x) + F.length(x.text) + len(END)).alias("at"),
            F.when(x.loss, F.concat(a.spans, F.array(F.struct(x.turn.alias("turn"), (a.at + lead(x)).alias("start"), (a.at + lead(x) + F.length(x.text)).alias("end"))))).otherwise(a.spans).alias("spans"),
        ),
        lambda a: a.spans,
    )
    text = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(TURN), x.role, F.lit("\n"), x.text, F.lit(END))), "")
    return g.select(
        F.col("conv").alias("conv_id"),
        "window",
        text.alias("formatted"),
        spans.alias("loss_spans"),
        F.transform("turns", lambda x: x.turn).alias("turns"),
        F.transform("turns", lambda x: x.repeated).alias("repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x.tok).alias("n_tokens"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Each window's new turns, and the texts under its loss mask, parsed from its formatted text.

    Columns: conv_id, window, formatted_chars, turns (turn, role, text) and losses (turn, text).
    """
    piece = F.slice(F.split("formatted", r"<\|turn\|>"), F.lit(2), F.size("turns"))
    pairs = F.zip_with(
        piece,
        F.arrays_zip("turns", "repeated"),
        lambda p, m: F.struct(m.turns.alias("turn"), m.repeated.alias("repeated"), F.regexp_extract(p, r"^((?:[^\\\n]|\\[\s\S])*)\n", 1).alias("role"), p.alias("p")),
    )
    new = F.filter(pairs, lambda x: ~x.repeated)
    cut = lambda x: F.substring(x.p, F.length(x.role) + 2, F.length(x.p) - F.length(x.role) - 1 - len(END))
    turns = F.transform(new, lambda x: F.struct(x.turn.alias("turn"), unescape(x.role).alias("role"), unescape(cut(x)).alias("text")))
    losses = F.transform("loss_spans", lambda s: F.struct(s.turn.alias("turn"), unescape(F.substring(F.col("formatted"), s.start + 1, s.end - s.start)).alias("text")))
    return formatted.select("conv_id", "window", F.length("formatted").alias("formatted_chars"), turns.alias("turns"), losses.alias("losses"))
