"""Chat formatting by linking quotations: quoted passages are found, traced to their originals, and left out."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import arrow_batch, discard, map_arrow, pieces, saved

_mark = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)(.*)$")
#: A line that introduces a deeper quotation: it ends with a colon, after an address or after a date or time and a name,
#: in whatever language; or after one of the verbs that mail programs use, which are fixed values.
_attribution = re.compile(r"^(?=.{1,300}$)(.*\b(wrote|writes|said|schrieb|a écrit|escribió)\b.*|.*\S@\S.*|.*\d[\d./:-]*\d.*[^\W\d_]{2,}.*):\s*$")
_space = re.compile(r"\s+")
#: Letters and digits of a unit that may lead to another conversation, at least; shorter ones ("ok", "thanks") are looked
#: for in their own conversation only, as they say nothing about which other one they come from.
LEAST = 12
#: Bytes of a short unit's hash, by which it is told from others'.
SHORT = 15
WHOLE, LINE = 0, 1


def lines_by_level(text: str) -> list[tuple[int, str]]:
    """Each line's quote level, the number of ``>`` before it, and the line without them. The line that introduces a
    deeper quotation ("Ann wrote:") belongs to it and is left out."""
    out = []
    for line in text.split("\n"):
        found = _mark.match(line)
        out.append((found[1].count(">"), found[2]) if found else (0, line))
    return [(n, x) for i, (n, x) in enumerate(out) if not (i + 1 < len(out) and out[i + 1][0] > n and _attribution.match(x))]


def any_hash(text: str, least: int = LEAST) -> bytes | None:
    """A hash of the text without differences of case, form and white space: SHORT bytes if it has fewer than ``least``
    letters and digits, else 16; None if nothing is left."""
    plain = _space.sub(" ", unicodedata.normalize("NFKC", text).casefold()).strip()
    size = 16 if sum(map(str.isalnum, plain)) >= least else SHORT
    return hashlib.blake2b(plain.encode(), digest_size=size).digest() if plain else None


def unit_hash(text: str) -> bytes | None:
    """The hash of a text by which it is found in any conversation; None if it is too short to tell."""
    h = any_hash(text)
    return h if h and len(h) != SHORT else None


def parse(text: str, least: int = LEAST) -> tuple[str, list[bytes], list[tuple[int, int, int, int, bytes]]]:
    """(own text, hashes of its units, (passage, level, WHOLE or LINE, line, hash) of each quoted unit).

    A passage is a stretch of lines of one level, cut at lines that are blank. An original's units are its whole own
    text, its passages and its lines; a quotation's are each passage, and its lines.
    """
    lines = lines_by_level(text)
    own = "\n".join(x for n, x in lines if n == 0)
    own = re.sub(r"\n{3,}", "\n\n", own).strip("\n")
    passages: list[tuple[int, list[str]]] = []
    last = None
    for n, x in lines:
        if not x.strip():
            last = None
            continue
        if last != n:
            passages.append((n, []))
        passages[-1][1].append(x)
        last = n
    units = {any_hash(own, least), *(any_hash(x, least) for n, p in passages if n == 0 for x in ("\n".join(p), *p))} - {None}
    quoted = []
    for k, (n, p) in enumerate([p for p in passages if p[0] > 0]):
        for kind, i, x in [(WHOLE, 0, "\n".join(p)), *((LINE, i, x) for i, x in enumerate(p))]:
            h = any_hash(x, least)
            if h:
                quoted.append((k, n, kind, i, h))
    return own, sorted(units), quoted


def link_quotations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", least: int = LEAST) -> DataFrame:
    """Messages without their quotations, each with what it quotes, in the order of reply.

    Columns: conversation, turn, role, text (without quoted lines and attributions), max_level, n_quotes (passages),
    n_linked, parent_conv and parent_turn, thread_turn, reply_depth. A passage's original is the first message that has
    it as a passage, a line or whole in its own text: of the same conversation, at an earlier turn; else of all others,
    the smallest (conversation, turn), unless it has fewer than ``least`` letters and digits. A passage that is nowhere whole links by its first line that is. The parent is
    the original of the shallowest linked passage, of the same conversation if there is one, and the latest turn of
    those. A thread is what replies lead back to within a conversation: ``thread_turn`` is its first message's turn,
    so rows by (conversation, thread_turn, turn) have every reply after what it answers. A message that quotes nothing
    of its conversation begins a thread.

    A null text counts as empty; a null conversation or turn has no place in an order, so such messages neither link nor
    are linked to, and are threads of their own with a null thread_turn where the turn is null. Repeated rows stay;
    rows of one turn share its parent. No rows give none; other columns are left.
    """
    kinds = {c: messages.schema[c].dataType.simpleString() for c in (conversation, turn, role)}
    rows = messages.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    place = [("conv", kinds[conversation]), ("turn", kinds[turn]), ("role", kinds[role])]

    def run(batches):
        for part in pieces(batches, "text"):
            said = [parse(x, least) for x in part.column("text").to_pylist()]
            quotes = [[dict(zip(("passage", "level", "kind", "line", "hash"), q)) for q in x[2]] for x in said]
            unit = pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("line", pa.int32()), ("hash", pa.binary())])
            yield arrow_batch(
                [*((c, part.schema.field(c).type) for c, _ in place), ("id", pa.binary()), ("text", pa.string()), ("units", pa.list_(pa.binary())), ("quoted", pa.list_(unit))],
                [*(part.column(c) for c, _ in place), [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in part.column("text").to_pylist()], [x[0] for x in said], [x[1] for x in said], quotes],
            )

    schema = ", ".join(f"{c} {k}" for c, k in place) + ", id binary, text string, units array<binary>, quoted array<struct<passage:int,level:int,kind:int,line:int,hash:binary>>"
    known = saved(map_arrow(rows, run, schema), "messages")
    placed = known.where("conv is not null and turn is not null")
    # one row a quoted unit; repeated rows quote once
    quoted = saved(placed.where(F.size("quoted") > 0).select("conv", "turn", "id", F.inline("quoted")).distinct(), "quoted")
    # units of originals that anyone quotes, summed up before they meet the quotations
    wanted = quoted.select("hash").distinct()
    originals = placed.select("conv", "turn", F.explode("units").alias("hash")).groupBy("hash", "conv").agg(F.min("turn").alias("first")).join(wanted, "hash", "left_semi")
    originals = saved(originals, "originals")
    # the two smallest conversations of each hash, for a quotation may be in the smallest; each task passes on two at most
    rank = F.row_number().over(W.partitionBy("hash").orderBy("conv"))
    two = originals.where(F.length("hash") != SHORT).withColumn("rank", rank).where("rank <= 2")
    anywhere = saved(two.groupBy("hash").agg(F.min(F.struct("conv", "first")).alias("any"), F.max(F.struct("conv", "first")).alias("other")), "anywhere")
    own = originals.withColumnRenamed("conv", "c")
    found = quoted.join(own, (quoted.hash == own.hash) & (quoted.conv == own.c), "left").drop(own.hash).drop("c").join(anywhere, "hash", "left")
    inside = F.when(F.col("first") < F.col("turn"), F.struct("conv", F.col("first").alias("turn")))
    outside = F.coalesce(*(F.when(F.col(f"{x}.conv") != F.col("conv"), F.struct(F.col(f"{x}.conv").alias("conv"), F.col(f"{x}.first").alias("turn"))) for x in ("any", "other")))
    units = found.withColumn("to", F.coalesce(inside, outside)).select("conv", "turn", "id", "passage", "level", F.when(F.col("to").isNotNull(), F.struct("kind", "line", "to")).alias("link"))
    passages = units.groupBy("conv", "turn", "id", "passage", "level").agg(F.min("link").to.alias("to"))
    same = (F.col("to.conv") == F.col("conv")).cast("int")
    rank = F.when(F.col("to").isNotNull(), F.struct(same.alias("same"), (-F.col("level")).alias("near"), F.col("to.turn").alias("t"), "to"))
    by_message = passages.groupBy("conv", "turn", "id").agg(F.max("level").alias("max_level"), F.count("*").alias("n_passages"), F.count("to").alias("n_linked"), F.max(rank).to.alias("parent"))
    linked = saved(by_message, "linked")
    roots = thread_roots(linked.where("parent.conv = conv").groupBy("conv", "turn").agg(F.max("parent.turn").alias("up")))
    k = [known.conv.eqNullSafe(linked.conv), known.turn.eqNullSafe(linked.turn), known.id == linked.id]
    n_quotes = F.size(F.array_distinct(F.transform("quoted", lambda q: q.passage)))
    out = known.join(linked, k, "left").select(known.conv, known.turn, "role", "text", F.coalesce("max_level", F.lit(0)).alias("max_level"), n_quotes.alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"), F.col("parent.conv").alias("parent_conv"), F.col("parent.turn").alias("parent_turn"))
    r = roots.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "root", "depth")
    out = out.join(r, (out.conv == r.c) & (out.turn == r.t), "left").withColumn("thread_turn", F.coalesce("root", "turn")).withColumn("reply_depth", F.coalesce("depth", F.lit(0)).cast("int"))
    out = out.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), "text", "max_level", "n_quotes", "n_linked", "parent_conv", "parent_turn", "thread_turn", "reply_depth")
    discard(quoted, originals, anywhere)
    order = [conversation, "thread_turn", turn, role, "text"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def with_replies_quoted(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` as mail has them: each opens with the message of the turn before, quoted, and above that with the one
    two turns before, quoted twice. Turns without one before them, and null texts, are quoted as nothing. Turns are met by
    equal keys, so a long conversation is no group."""
    marked = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark))
    out = messages
    for back in (1, 2):
        before = messages.select(F.col(conversation).alias(f"c{back}"), (F.col(turn) + back).alias(f"t{back}"), F.col(text).alias(f"before{back}"))
        out = out.join(before, (out[conversation] == F.col(f"c{back}")) & (out[turn] == F.col(f"t{back}")), "left")
    quoted = F.concat_ws("\n", marked(F.col("before2"), "> > "), marked(F.col("before1"), "> "))
    whole = F.concat(F.when(quoted != "", F.concat(quoted, F.lit("\n\n"))).otherwise(""), F.coalesce(text, F.lit("")))
    return out.withColumn(text, whole).select(*messages.columns)


def thread_roots(up: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) for messages with a parent (conv, turn, up), by doubling: each round looks up where
    one's ancestor had come to, so the rounds are the logarithm of the longest thread."""
    now = saved(up.select("conv", "turn", F.col("up").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        step = now.join(above, (now.conv == above.c) & (now.root == above.t), "left")
        after = saved(step.select("conv", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads")
        discard(now)
        now = after
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
