"""Chat formatting in budgeted windows; DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a span
is what ends in one stretch of ``budget`` tokens, and a turn that reaches over a
stretch's border stands alone, so a window's new turns never exceed the budget
unless one turn does by itself (it is kept whole). Every window keeps the
system turn and repeats a limited history; only its own assistant turns are
under the loss mask, so each target counts once.

Turns are marked by ``<|im_start|>role\\n`` and ``<|im_end|>\\n``. In texts a
backslash is doubled and one is put behind the first character of any control
string; roles are URL-encoded. Both are undone exactly by :func:`read_back`.

Defined results: null text and role count as empty, null turns come first, ties
are ordered by role and text, null conversation ids form one conversation,
repeated rows are turns of their own, an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>)"
_INST = r"(\[)(/?INST\])"


def escape(text: Column) -> Column:
    twice = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(twice, _CONTROL, r"$1\\$2"), _INST, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens_of(text: Column) -> Column:
    """An estimate: a token for each four bytes begun, and four for a turn's marks."""
    return F.ceil(F.octet_length(text) / 4).cast("long") + 4


def _segment(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.url_encode(role), F.lit("\n"), escape(text), F.lit(END))


def windows(turns: DataFrame, budget: int = 512, history: int = 128, history_turns: int = 2, target: str = "assistant", tokens: str | None = None) -> DataFrame:
    """One row a window of ``turns`` (conv_id, turn, role, text; others are ignored).

    Returns conv_id, window (long, in order), formatted, loss (array of start and length in
    code points of the escaped targets), n_turns, n_repeated (leading turns that are repeats)
    and n_tokens (of its own turns). ``tokens`` names a column with each turn's count of tokens (null and
    negative count as 0); without one they are estimated. One shuffle, by conversation.
    """
    count = tokens_of(F.coalesce("text", F.lit(""))) if tokens is None else F.greatest(F.coalesce(turns[tokens].cast("long"), F.lit(0)), F.lit(0))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), count.alias("tokens"))
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(conv))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    t = t.withColumn("tokens", F.when(system, 0).otherwise(F.col("tokens")))
    t = t.withColumn("upto", F.sum("tokens").over(conv.rowsBetween(Window.unboundedPreceding, 0))).withColumn("since", F.col("upto") - F.col("tokens"))
    stretch = F.floor(F.greatest(F.col("upto") - 1, F.lit(0)) / budget)
    t = t.withColumn("window", stretch * 2 + (F.col("since") >= stretch * budget).cast("long"))
    opens = F.coalesce(F.lag("window").over(conv), F.lit(-1)) != F.col("window")
    kept = F.first(F.when(F.col("role") == "system", _segment(F.col("role"), F.col("text")))).over(conv)
    past = []
    for back in range(history_turns, 0, -1):
        near = (F.col("since") - F.lag("since", back).over(conv) <= history) & (F.col("pos") > back) & ~((F.col("pos") == back + 1) & kept.isNotNull())
        past.append(F.when(near, _segment(F.lag("role", back).over(conv), F.lag("text", back).over(conv))))
    repeats = F.when(opens & (F.col("pos") > 1), F.filter(F.array(kept, *past), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("repeats", repeats).withColumn("before", F.concat(F.array_join("repeats", ""), F.lit(START), F.url_encode("role"), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    piece = F.concat("before", "body", F.lit(END))
    inside = Window.partitionBy("conv_id", "window").orderBy("pos")
    t = t.withColumn("piece", piece).withColumn("at", F.coalesce(F.sum(F.length("piece")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role") == target, F.struct("pos", (F.col("at") + F.length("before")).alias("start"), F.length("body").cast("long").alias("length")))
    grouped = t.withColumn("span", span).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"), F.sort_array(F.collect_list("span")).alias("spans"),
        F.count("*").alias("n_turns"), F.sum(F.size("repeats")).alias("n_repeated"), F.sum("tokens").alias("n_tokens"))
    return grouped.select("conv_id", "window", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"), "n_turns", "n_repeated", "n_tokens")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, in order, without repeats), loss_text, formatted_chars; from what :func:`windows` wrote alone."""
    marked = F.split("formatted", r"<\|im_end\|>\n")
    own = F.slice(marked, F.col("n_repeated") + 1, F.greatest(F.size(marked) - 1 - F.col("n_repeated"), F.lit(0)))
    cut = lambda s: F.instr(s, "\n")
    turn = lambda s: F.struct(F.url_decode(F.substr(s, F.lit(len(START) + 1), cut(s) - len(START) - 1)).alias("role"), unescape(F.substr(s, cut(s) + 1)).alias("text"))
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    parts = formatted.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), F.transform(own, turn).alias("turns"), F.array_join(masked, "").alias("masked"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "masked"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["masked"]), "").alias("loss_text"), "formatted_chars")
