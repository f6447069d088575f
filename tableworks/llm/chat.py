"""Operator 6: chat formatting by prefix-target expansion."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, shorten_batches, stored
from .registry import query

#: The marks of the template and other control strings that a text must not be able to forge.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
CODES = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
#: A chunk of a conversation: turns that it has at most, and code points within which they start.
CHUNK_TURNS, CHUNK_CHARS = 32, 1 << 16


def escape(text: Column) -> Column:
    """A backslash becomes two; the first character of a control string becomes a backslash and a letter. Reversible."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for first, letter in (("<", "l"), ("[", "b")):
        rest = "|".join(re.escape(c[1:]).replace("/", "\\/") for c in CONTROL if c[0] == first)
        out = F.regexp_replace(out, f"{re.escape(first)}(?={rest})", f"\\\\{letter}")
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: CODES[m[1]], text) if "\\" in text else text


def _own_chunks(turns: DataFrame) -> DataFrame:
    """Per turn the row that ends its example, see ``expand``, and ``replies``: the assistant turns of its chunk up to here."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    pieces = turns.select(
        "conv_id", "turn", "role", "text", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("target"),
        F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("piece"),
    )
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumns({"position": F.row_number().over(order).cast("long") - 1, "piece_start": before.cast("long")})
    placed = placed.withColumns({"by_turns": F.expr(f"position div {CHUNK_TURNS}"), "by_chars": F.expr(f"piece_start div {CHUNK_CHARS}")})
    chunk = Window.partitionBy("conv_id", "by_turns", "by_chars").orderBy("position")
    so_far = chunk.rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.concat_ws("", F.collect_list("piece").over(so_far))
    start = F.col("piece_start") + F.col("head")
    last = F.lead(F.lit(True)).over(chunk).isNull()
    return placed.select(
        "conv_id", "position", "piece", "target", F.first("piece_start").over(chunk).alias("text_start"), F.when(F.col("target") | last, prefix).alias("text"),
        F.when(F.col("target"), start).alias("loss_start"), F.when(F.col("target"), start + F.col("body")).alias("loss_end"),
        F.col("target").alias("example"), last.alias("last"), F.collect_list(F.when(F.col("target"), F.col("position"))).over(so_far).alias("replies"),
    )


def _contexts(turns: DataFrame) -> DataFrame | None:
    """The rows of examples for the chunks before their own, None where every conversation is one chunk.

    Which chunks go with which is found without their texts; then each chunk's text is sent to one task, which writes it for all later
    replies. So what is shuffled is linear in the pieces, and a task holds one chunk at a time, also of a conversation of any length.
    """
    spark = turns.sparkSession
    # escapes at most double a text
    most = 2 * F.length(F.concat(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))) + len(START + "\n" + END)
    sizes = turns.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n"), F.sum(most).alias("chars"))
    long = sizes.where((F.col("n") > CHUNK_TURNS) | (F.col("chars") > CHUNK_CHARS))
    chunks = _own_chunks(turns.join(long, F.col("conv_id").eqNullSafe(F.col("of")), "left_semi")).where("last")
    chunks = stored(chunks.select("conv_id", "text_start", "text", "replies"), "chat-chunks")
    later = chunks.where("text_start > 0 AND size(replies) > 0").select(F.col("conv_id").alias("of"), F.col("text_start").alias("own"), "replies")
    if later.isEmpty():
        return None
    earlier = chunks.select(F.col("conv_id").alias("from"), F.col("text_start").alias("at"))
    pairs = later.join(earlier, F.col("of").eqNullSafe(F.col("from")) & (F.col("at") < F.col("own"))).select("from", "at", "replies")
    # dealt by number, as pairs are small but not what is written for them
    pairs = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "from", "at")
    rows = pairs.join(chunks.drop("replies"), F.col("from").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("text_start")))
    none = F.lit(None).cast("long")
    return rows.select(
        "conv_id", F.explode("replies").alias("position"), F.lit(None).cast("string").alias("piece"), F.lit(False).alias("target"), "text_start", "text",
        none.alias("loss_start"), none.alias("loss_end"), F.lit(True).alias("example"), F.lit(False).alias("last"),
    )


def expand(turns: DataFrame) -> DataFrame:
    """One example for every assistant turn: all turns before it are context, only its reply is trained on.

    ``turns`` has conv_id, turn, role, text. Gives rows (conv_id, position, piece, target, text_start, text, loss_start, loss_end, example,
    last), at least one per turn: ``piece`` is the turn formatted, ``target`` marks assistant turns, and the example of such a turn is the
    formatted context and reply. loss_start and loss_end are the code points of the escaped reply within the example.

    A whole example is written out for every reply, in rows of bounded size: a long conversation is cut into chunks of at most CHUNK_TURNS
    turns that start within CHUNK_CHARS code points, and an example has a row (``example`` is true) for each chunk it reaches, whose ``text``
    starts at ``text_start`` of the example. Its last row, the ``target``, has its own chunk up to the reply; rows before it have no
    piece and hold the chunks before, whole. Joined by text_start they are the example, as ``render`` gives it. The examples of a
    conversation grow with the square of its turns by definition. An example of a conversation that is one chunk is one row.

    ``last`` marks the last row of a chunk, whose text is the chunk; it has a text also where it is no reply and in no example.

    Null text or role is empty. Turns are ordered by turn (nulls last), role and text, so ties and repeated rows have one order
    up to equal rows; all of them are kept. Rows without conv_id form one conversation. Further columns are ignored.
    """
    own, contexts = _own_chunks(turns).drop("replies"), _contexts(turns)
    return own if contexts is None else contexts.unionByName(own)


def render(examples: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, text, loss_start, loss_end): each example as one text, its rows joined. A text is as long as its conversation;
    give the conv_ids wanted to join a part."""
    if conversations is not None:
        examples = examples.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    rows = examples.where("example").groupBy("conv_id", "position")
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("text_start", "text"))), lambda x: x["text"]))
    return rows.agg(F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"), text.alias("text"))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation from the texts of examples alone: turns parsed from the template, digests over all turns and over what
    lies under the loss masks, and the length of all examples.

    Lengths are summed where the texts are. Of these, the last of each chunk, which has all its turns, and of every other reply what lies
    under its mask are dealt by conversation and sorted; a digest is inherently sequential, so a task streams through them and keeps the
    state of one conversation only.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def digest(batches):
        conv, state = None, None

        def row():
            n, turns, chars, loss, total = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += r["chars"]
                # a turn ends where END does: a role's line breaks and control strings are escaped, as are those of a text
                for turn in (r["chunk"] or "").split(END)[:-1]:
                    role, _, said = turn.removeprefix(START).partition("\n")
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                if r["trained"] is not None:
                    trained = unescape(r["trained"])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
            yield table(out)
        if state is not None:
            yield table([row()])

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    shorten_batches(examples.sparkSession)
    place, masked = F.col("loss_start") - F.col("text_start") + 1, F.col("loss_end") - F.col("loss_start")
    trained = F.when(F.col("target"), F.substring(F.col("text"), place.cast("int"), masked.cast("int")))
    own = examples.where("text IS NOT NULL AND (target OR last)").select(
        "conv_id", "position", F.when(F.col("last"), F.col("text")).alias("chunk"), trained.alias("trained"),
        F.when(F.col("example"), F.length("text")).otherwise(0).cast("long").alias("chars"),
    )
    none = F.lit(None).cast("string")
    contexts = examples.where("example AND NOT target").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    rows = own.unionByName(contexts.select("conv_id", F.lit(-1).cast("long").alias("position"), none.alias("chunk"), none.alias("trained"), "chars"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(digest, schema)


EXTRA = "</s>[INST] ok [/INST]"


@query("op6_chat_formatting")
def op6_chat_formatting(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", EXTRA), (-7, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    examples = expand(turns.union(more)).where("text IS NOT NULL").drop("piece")
    return read_back(stored(examples, "chat"))
