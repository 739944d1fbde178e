"""Preference formatting: a shared prompt and two masked completions from a pair of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import cut

#: Rendered characters after which a pair goes on in a further row; a turn stays whole.
MOST = 1 << 24
TRAINED_ROLE = "assistant"


def pair_up(conversations: DataFrame) -> DataFrame:
    """Pairs by number: conversation 2k is the chosen one, 2k + 1 the rejected one, of pair k.

    Adds ``pair_id`` and ``side``; rows with a null conv_id are in no pair.
    """
    conv = F.col("conv_id")
    return conversations.filter(conv.isNotNull()).withColumns(
        {
            "pair_id": F.floor(conv / 2).cast("long"),
            "side": F.when(F.pmod(conv, F.lit(2)) == 0, "chosen").otherwise("rejected"),
        }
    )


def swap_answers(conversations: DataFrame, trained: str = TRAINED_ROLE) -> DataFrame:
    """Pairs for a table without preferences: each conversation against itself with another's answer.

    The chosen side of pair ``conv_id`` is that conversation up to its last turn of role
    ``trained``; on the rejected side this turn holds the last answer of the neighbour, whose
    number differs in the lowest bit.  Conversations without an answer, or whose neighbour
    has none, are in no pair, nor are rows with a null conv_id.  Null turns come first; of
    several texts at the last turn the neighbour is given the greatest.
    """
    own = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("pair_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    answers = own.filter(F.col("role") == trained).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    neighbour = F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id")
    ends = answers.select("pair_id", F.col("last.turn").alias("at")).join(answers.select(neighbour, F.col("last.text").alias("text")), "pair_id")
    sides = F.when(F.col("turn") < F.col("at"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    kept = own.join(ends.select("pair_id", "at"), "pair_id").filter("turn <= at")
    return kept.select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text").unionAll(
        ends.select("pair_id", F.lit("rejected").alias("side"), F.col("at").alias("turn"), F.lit(trained).alias("role"), "text")
    )


def render_head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render_body(text: Column) -> Column:
    """A turn's text and end mark; ``<|`` inside the text is set apart so that it can't pose as a mark."""
    return F.concat(F.replace(text, F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def _part(name: str) -> Column:
    """The rendered turns of a part in order, as one string."""
    turns = F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "role", "text", "head", "body"))))
    return turns.alias(name)


def _joined(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"])), "")


def _mask(turns: str, trained: str) -> Column:
    """``start:end`` of the bodies of trained turns, comma-joined, in code points of the pair's whole text."""
    start = F.struct(F.col(f"{turns}_at").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        s = acc["at"] + F.length(t["head"])
        e = s + F.length(t["body"])
        span = F.when(t["role"] == trained, F.array(F.concat_ws(":", s.cast("string"), e.cast("string"))))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.coalesce(span, F.array().cast("array<string>"))).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["out"], ","))


def _long_pairs(seen: DataFrame, most: int) -> DataFrame:
    """``(pair_id, turn, block, blocks, prompt_turns, chosen_at, rejected_at)`` of the turns of long pairs.

    A block begins where ``most`` more characters are rendered.  Only numbers are gathered
    by pair, one row a turn.
    """
    size = F.sum(F.col("size"))
    turns = seen.groupBy("pair_id", "turn").agg(
        size.alias("size"), F.count_if("shared").alias("prompts"),
        *[F.sum(F.when(~F.col("shared") & (F.col("sides").bitwiseAND(F.lit(k)) > 0), F.col("size")).otherwise(0)).alias(name) for name, k in (("chosen", 1), ("rejected", 2))],
    )
    pair = Window.partitionBy("pair_id")
    before = pair.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    placed = turns.withColumns(
        {name + "_at": F.coalesce(F.sum(name).over(before), zero) for name in ("size", "chosen", "rejected")}
    ).withColumn("step", F.floor(F.col("size_at") / most))
    placed = placed.withColumn("block", (F.dense_rank().over(pair.orderBy("step")) - 1).cast("long"))
    block = Window.partitionBy("pair_id", "block")
    return placed.select(
        "pair_id", "turn", "block", (F.max("block").over(pair) + 1).alias("blocks"), F.sum("prompts").over(pair).alias("prompt_turns"),
        F.min("chosen_at").over(block).alias("chosen_at"), F.min("rejected_at").over(block).alias("rejected_at"),
    )


def preferences(turns: DataFrame, trained: str = TRAINED_ROLE, most: int = MOST) -> DataFrame:
    """Format pairs of conversations for preference training.

    ``turns`` holds ``pair_id``, ``side`` (chosen or rejected), ``turn``, ``role``, ``text``.
    The prompt is the longest common prefix: all turns before the first turn number at which
    the sides differ.  It is rendered once; what follows is each side's completion, whose
    mask lists the spans to train on, the bodies of turns of role ``trained``.

    One row a pair: ``pair_id``, ``block`` (0), ``blocks`` (1), ``n_prompt_turns``, ``prompt``,
    ``chosen``, ``chosen_mask``, ``rejected``, ``rejected_mask``.  Only a pair of more than
    ``most`` rendered characters, which no task should hold at once, goes on in further rows:
    its texts are each column joined in order of ``block``, masks too, as they count from the
    beginning of the pair's whole text; ``n_prompt_turns`` counts those of the whole pair.

    Repeated rows count once.  Several texts at one turn are taken in order of role and
    text.  Null role or text is the empty string, a null turn comes before all others.  Equal
    conversations are all prompt; where one side is a prefix of the other its completion is
    empty.  Pairs that lack a side give no row, nor do rows with a null pair_id.  Other
    columns are ignored; no turns give no rows.
    """
    own = turns.filter(F.col("pair_id").isNotNull()).select(
        "pair_id", "side", F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    size = (F.length(render_head(F.col("role"))) + F.length(render_body(F.col("text")))).cast("long")
    # A turn that both sides hold alike is seen on two sides; partial sums come before the shuffle.
    seen = own.groupBy("pair_id", "turn", "role", "text").agg(
        F.bit_or(F.when(F.col("side") == "chosen", 1).otherwise(2)).alias("sides")
    )
    pairs = seen.groupBy("pair_id").agg(F.min(F.when(F.col("sides") != 3, F.col("turn"))).alias("parts_at"), F.bit_or("sides").alias("both"))
    placed = seen.join(pairs.filter("both = 3").drop("both"), "pair_id")
    shared = F.col("parts_at").isNull() | (F.col("turn") < F.col("parts_at"))
    # Repeats included, a pair of fewer characters has one block; so no text moves to find the others.
    long = cut(own.groupBy("pair_id").agg(F.sum(size).alias("size")).filter(F.col("size") > most).select("pair_id"))
    blocks = cut(_long_pairs(placed.join(long, "pair_id", "left_semi").withColumns({"shared": shared, "size": size}), most))
    placed = placed.join(blocks, ["pair_id", "turn"], "left")
    names = F.when(shared, F.array(F.lit("prompt"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("sides").bitwiseAND(F.lit(1)) > 0, "chosen"),
                F.when(F.col("sides").bitwiseAND(F.lit(2)) > 0, "rejected"),
            )
        )
    )
    zero = F.lit(0).cast("long")
    parts = placed.withColumn("part", F.explode(names)).withColumns(
        {"head": render_head(F.col("role")), "body": render_body(F.col("text")), "block": F.coalesce("block", zero)}
    )
    rows = parts.groupBy("pair_id", "block").agg(
        _part("prompt"), _part("chosen"), _part("rejected"), F.coalesce(F.max("blocks"), F.lit(1)).alias("blocks"), F.max("prompt_turns").alias("prompt_turns"),
        *[F.coalesce(F.max(name), zero).alias(name) for name in ("chosen_at", "rejected_at")],
    )
    return rows.select(
        "pair_id", "block", "blocks", F.coalesce("prompt_turns", F.size("prompt")).cast("long").alias("n_prompt_turns"),
        _joined("prompt").alias("prompt"), _joined("chosen").alias("chosen"), _mask("chosen", trained).alias("chosen_mask"),
        _joined("rejected").alias("rejected"), _mask("rejected", trained).alias("rejected_mask"),
    )
