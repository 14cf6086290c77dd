"""Conversations: parsing of shapes, pairing of turns, prompts, padding, batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chat_prompt
from ..functions.vectors import let
from .evaluate import hash_order, hash_positions

# fixed values: names under which instruction and output come, and roles
ASKED = ["instruction", "question", "prompt", "input", "user"]
ANSWERED = ["output", "answer", "response", "assistant"]
TURN_ASKED = ["instruction", "question", "user", "value"]
TURN_ANSWERED = ["output", "answer", "assistant"]
USER_ROLES = ["human", "user"]
MODEL_ROLES = ["gpt", "assistant", "model"]


def _first(turn: Column, keys: list[str]) -> Column:
    """The first of a JSON object's fields that isn't empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(turn, f"$.{k}"), F.lit("")) for k in keys], F.lit(""))


def parse_turns(raw: Column) -> Column:
    """An array of (instruction, output) from a conversation as JSON text, whatever its shape.

    A list gives a turn for each object with something in it, routed by role if
    it names one; an object gives one turn; text that isn't JSON is an
    instruction without an output; null gives no turn.
    """
    text = F.trim(raw)
    array = F.from_json(text, "array<string>")
    role = lambda t: F.lower(F.coalesce(F.nullif(F.get_json_object(t, "$.from"), F.lit("")), F.get_json_object(t, "$.role"), F.lit("")))
    value = lambda t: F.nullif(F.get_json_object(t, "$.value"), F.lit(""))

    def turn(t: Column) -> Column:
        asked, answered = _first(t, TURN_ASKED), _first(t, TURN_ANSWERED)
        user, model = role(t).isin(USER_ROLES), role(t).isin(MODEL_ROLES)
        instruction = F.when(user, F.coalesce(value(t), asked)).when(model, "").otherwise(asked)
        output = F.when(user, "").when(model, F.coalesce(value(t), answered)).otherwise(answered)
        return F.struct(instruction.alias("instruction"), output.alias("output"))

    turns = F.filter(F.transform(array, turn), lambda t: (t["instruction"] != "") | (t["output"] != ""))
    single = F.array(F.struct(_first(text, ASKED).alias("instruction"), _first(text, ANSWERED).alias("output")))
    plain = F.array(F.struct(raw.alias("instruction"), F.lit("").alias("output")))
    none = F.array().cast("array<struct<instruction:string,output:string>>")
    is_object = text.startswith("{") & F.get_json_object(text, "$").isNotNull()
    is_list = text.startswith("[") & array.isNotNull()
    return F.when(raw.isNull(), none).when(is_list, turns).when(is_object, single).otherwise(plain)


def turn_pairs(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pair, instruction, output): each user turn with the assistant turn right after it; others are left out."""
    by = Window.partitionBy(conv).orderBy(turn)
    talk = df.filter(F.col(role).isin(*USER_ROLES, *MODEL_ROLES))
    ahead = talk.withColumn("__role", F.lead(role).over(by)).withColumn("output", F.lead(text).over(by))
    pairs = ahead.filter(F.col(role).isin(USER_ROLES) & F.col("__role").isin(MODEL_ROLES))
    return pairs.select(conv, (F.row_number().over(by) - 1).alias("pair"), F.col(text).alias("instruction"), "output")


def role_violations(df: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """(conv, n_violations): neighbouring turns of one side."""
    talk = df.filter(F.col(role).isin(*USER_ROLES, *MODEL_ROLES)).withColumn("__u", F.col(role).isin(USER_ROLES))
    before = F.lag("__u").over(Window.partitionBy(conv).orderBy(turn))
    return talk.withColumn("__b", before).groupBy(conv).agg(F.count_if(F.col("__u") == F.col("__b")).alias("n_violations"))


def packed(pairs: DataFrame, conv: str) -> DataFrame:
    """(conv, conversation): pairs in order as an array.  A conversation is one row's worth of data by nature."""
    turns = F.array_sort(F.collect_list(F.struct("pair", "instruction", "output")))
    return pairs.groupBy(conv).agg(F.transform(turns, lambda t: F.struct(t["instruction"].alias("instruction"), t["output"].alias("output"))).alias("conversation"))


def unpacked(df: DataFrame, *keep: str, conversation: str = "conversation") -> DataFrame:
    """A sample for each turn, other columns copied."""
    return df.select(*keep, F.posexplode(conversation).alias("turn", "t")).select(*keep, "turn", "t.*")


def ends(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, n_turns, first_text, last_text, first_reply): one aggregation, no ordering of groups."""
    reply = F.when(F.col(role).isin(MODEL_ROLES), F.col(turn))
    return df.groupBy(conv).agg(
        F.count("*").alias("n_turns"), F.min_by(text, turn).alias("first_text"), F.max_by(text, turn).alias("last_text"), F.min_by(text, reply).alias("first_reply")
    )


def chat_samples(pairs: DataFrame, system: str = "You are a helpful assistant.") -> DataFrame:
    return pairs.withColumn("prompt", chat_prompt(F.lit(system), F.col("instruction"), F.col("pair") == 0))


def drop_yes_no(questions: Column, answers: Column) -> Column:
    """Question and answer pairs whose answer isn't yes or no."""
    return F.filter(F.arrays_zip(questions.alias("q"), answers.alias("a")), lambda x: ~F.lower(F.trim(x["a"])).isin("yes", "no"))


def split_name(code: Column) -> Column:
    return F.element_at(F.create_map(F.lit(1), F.lit("train"), F.lit(2), F.lit("val"), F.lit(3), F.lit("test")), code)


def labels_for(instruction_ids: Column, output_ids: Column, ignore: int = -100, test: bool = False) -> tuple[Column, Column]:
    """Input ids and labels of a turn: the instruction is ignored in the loss; in tests there is no output."""
    masked = F.array_repeat(F.lit(ignore), F.size(instruction_ids))
    return (instruction_ids, masked) if test else (F.concat(instruction_ids, output_ids), F.concat(masked, output_ids))


def padded(df: DataFrame, ids: str, batch: str, pad: int = 0) -> DataFrame:
    """Rows padded on the left to their batch's length, with mask and positions (0 on padding)."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    n = F.col("__n")
    out = df.withColumn("__n", F.greatest(longest - F.size(ids), F.lit(0)))
    ones = F.array_repeat(F.lit(1), F.size(ids))
    return out.select(
        *df.columns,
        F.concat(F.array_repeat(F.lit(pad), n), F.col(ids)).alias("padded"),
        F.concat(F.array_repeat(F.lit(0), n), ones).alias("mask"),
        F.concat(F.array_repeat(F.lit(0), n), F.transform(F.col(ids), lambda x, i: i)).alias("position"),
    )


def _even_chunks(lengths: list[int], chunks: int) -> list[int]:
    """The chunk of each length, longest first: the emptiest chunk that isn't full; strided if they can't be equal."""
    n = len(lengths)
    if n % chunks:
        return [i % chunks for i in range(n)]
    room, held, out = [n // chunks] * chunks, [0] * chunks, []
    for length in lengths:
        k = min((c for c in range(chunks) if room[c]), key=lambda c: held[c])
        room[k] -= 1
        held[k] += length
        out.append(k)
    return out


def length_grouped(df: DataFrame, key: str, length: str, batch: int, chunks: int, seed: int = 42) -> DataFrame:
    """(key, length, megabatch, chunk): rows in random megabatches, balanced by length over chunks within each.

    Rows are dealt to megabatches by hash, which needs no global order, so a
    megabatch holds about ``batch * chunks`` rows; each is packed by itself.
    """
    total = df.count()
    megas = max(1, -(-total // (batch * chunks)))
    dealt = df.select(F.col(key).alias("k"), F.col(length).cast("long").alias("n"), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(megas)).alias("megabatch"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k"], ascending=[False, True]).reset_index(drop=True)
        pdf["chunk"] = _even_chunks(pdf["n"].tolist(), chunks)
        return pdf

    kind = df.schema[key].dataType.simpleString()
    out = dealt.groupBy("megabatch").applyInPandas(pack, f"k {kind}, n long, megabatch long, chunk long")
    return out.select(F.col("k").alias(key), F.col("n").alias(length), "megabatch", "chunk")


def clip_scale(df: DataFrame, norm: str, group: str) -> DataFrame:
    """``scale``: how far each gradient norm is above the least of its group, at most 1."""
    least = F.min(norm).over(Window.partitionBy(group))
    return df.withColumn("scale", F.least(F.lit(1.0), least / (F.col(norm) + 1e-6)))


# --- segments at special tokens ---------------------------------------------


def segments(ids: Column, labels: Column, starts: dict[str, int], ends: dict[str, int]) -> Column:
    """An array of (modality, ids, labels): a sequence cut at its special tokens.

    What stands between a modality's start and end token is a segment of that
    modality, without labels (-100); the tokens themselves and all else are text.
    A start without an end runs to the end of the sequence.
    """
    n = F.size(ids)
    opens = F.create_map(*[x for name, token in starts.items() for x in (F.lit(token), F.lit(name))])
    closes = F.create_map(*[x for name, token in ends.items() for x in (F.lit(token), F.lit(name))])
    special = F.array(*[F.lit(t) for t in (*starts.values(), *ends.values())])
    places = F.filter(F.transform(ids, lambda x, i: F.struct(x.alias("token"), (i + 1).alias("at"))), lambda p: F.array_contains(special, p["token"]))
    piece = lambda at, kind: F.struct(at.cast("int").alias("at"), kind.alias("kind"))
    state = F.struct(F.lit("text").alias("inside"), F.array(piece(F.lit(1), F.lit("text"))).alias("cuts"))

    def step(a: Column, p: Column) -> Column:
        begin = (a["inside"] == "text") & F.element_at(opens, p["token"]).isNotNull()
        over = F.coalesce(F.element_at(closes, p["token"]) == a["inside"], F.lit(False))
        kind = F.when(begin, F.element_at(opens, p["token"])).when(over, "text").otherwise(a["inside"])
        # both marks are text: a segment begins after its start and the text after it with its end
        cuts = F.when(begin, F.concat(a["cuts"], F.array(piece(p["at"] + 1, kind)))).when(over, F.concat(a["cuts"], F.array(piece(p["at"], kind)))).otherwise(a["cuts"])
        return F.struct(kind.alias("inside"), cuts.alias("cuts"))

    def cut(c: Column) -> Column:
        sized = F.transform(c, lambda p, k: F.struct(p["at"].alias("at"), p["kind"].alias("kind"), (F.coalesce(F.get(c, k + 1)["at"], n + 1) - p["at"]).alias("size")))
        return F.transform(
            F.filter(sized, lambda p: p["size"] > 0),
            lambda p: F.struct(
                p["kind"].alias("modality"),
                F.slice(ids, p["at"], p["size"]).alias("ids"),
                F.when(p["kind"] == "text", F.slice(labels, p["at"], p["size"])).otherwise(F.array_repeat(F.lit(-100), p["size"])).alias("labels"),
            ),
        )

    return F.when(n > 0, let(F.aggregate(places, state, step, lambda a: a["cuts"]), cut))


def modality_mask(parts: Column, modality: str) -> Column:
    """One for each token of a modality, zero elsewhere, over all segments."""
    return F.flatten(F.transform(parts, lambda p: F.array_repeat(F.when(p["modality"] == modality, 1).otherwise(0), F.size(p["ids"]))))


def shard_rows(df: DataFrame, key: str, shards: int, index: int, contiguous: bool = False, seed: str = "shard") -> DataFrame:
    """One of ``shards`` equal parts of the rows, in the order of a hash of the key: every n-th row, or a run of them."""
    placed = hash_positions(df, [], hash_order(seed, key), key, "__place")
    if not contiguous:
        return placed.filter(F.col("__place") % shards == index).drop("__place")
    n = df.count()
    first, last = (n * index) // shards, (n * (index + 1)) // shards
    return placed.filter((F.col("__place") >= first) & (F.col("__place") < last)).drop("__place")


def first_users(df: DataFrame, user: str, order: str, n: int) -> DataFrame:
    """All rows of the ``n`` users that appear first; a limit that is the operator's purpose."""
    first = df.groupBy(user).agg(F.min(order).alias("__first")).orderBy("__first", user).limit(n)
    return df.join(F.broadcast(first.select(user)) if n <= 100_000 else first.select(user), user, "left_semi")
