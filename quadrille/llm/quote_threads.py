"""Chat formatting by quotation linking.

A message is parsed into passages: consecutive lines of the same quote level (the number of leading `>`).
Quoted passages and their lines are normalised (lower case, single spaces) and hashed, and meet the hashed
passages and lines of earlier messages of the same conversation.  A message replies to the latest message
that its shallowest linked passage quotes.  Replies are ordered after their thread's first message:
the order of a conversation is (thread, turn), where a thread is the chain of replies that begins with a
message without a link.  The formatted text leaves quotes and attribution lines out.

Messages are parsed in Python, once each; the rest is DataFrame code.  Passages that no quote of the conversation
asks for are held back by a bitmap.  A passage that a conversation repeats is looked up by windows over stretches of `STRETCH`
turns with the latest turn of earlier stretches carried in, never paired; thread roots are found by pointer
doubling over linked messages only, and messages that share a root are dealt over several tasks.  A
conversation isn't gathered in one row: messages carry their order, and `write_conversations` range-partitions
by it, so one huge conversation is dealt to several tasks.

Cases: null texts format as empty; a quote of nothing known has no link and is left out of the text all the
same; a message never links to itself or a later one; repeated (conv_id, turn) rows are each formatted, and
a link to such a turn is one link; null conv_id or turn gives no link; a very long text is parsed whole, line by
line; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quadrille.llm import _bitmap, _spark

QUOTE = r"^(?: ?>)+"
ATTRIBUTION = r"(?i)^\s*(?:on\b.{0,200}\bwrote|le\b.{0,200}\ba écrit|am\b.{0,200}\bschrieb.{0,80}|el\b.{0,200}\bescribió)\s*:\s*$"
TEMPLATE = ("<|", "|>\n", "<|end|>")
MAX_DOUBLINGS = 64
HEAVY = 1000


_QUOTE, _ATTRIBUTION, _SPACES, _ENDS = re.compile(QUOTE), re.compile(ATTRIBUTION), re.compile(r"\s+", re.ASCII), re.compile(r"^\s+|\s+$", re.ASCII)
STRETCH = 1024
PARSED = "conv_id long, turn long, role string, clean string, n_quoted long, levels array<int>, keys array<long>, checks array<long>"


def normalised(s: str) -> str:
    return _SPACES.sub(" ", s.lower()).strip(" ")


def parse_message(text: str | None) -> tuple[str, int, dict[tuple[bytes, bool], int]]:
    """The unquoted text, the number of quoted lines, and the least quote level of each passage and line by its 128-bit hash."""
    lines = []
    for line in re.split("\r?\n", text or ""):
        mark = _QUOTE.match(line)
        rest = line[mark.end() :] if mark else line
        lines.append((mark[0].count(">") if mark else 0, rest[1:] if rest[:1] == " " else rest))
    quoted = sum(level > 0 for level, _ in lines)
    found: dict[tuple[bytes, bool], int] = {}
    passage: list[str] = []
    for i, (level, s) in enumerate(lines):
        passage.append(s)
        whole = i + 1 == len(lines) or lines[i + 1][0] != level
        for body in {normalised(s), normalised(" ".join(passage)) if whole else ""} - {""}:
            key = (xxhash.xxh3_128_digest(body.encode("utf-8", "surrogatepass")), level > 0)
            found[key] = min(level, found.get(key, level))
        passage = [] if whole else passage
    own = [s for level, s in lines if not level and not (quoted and _ATTRIBUTION.search(s))]
    return _ENDS.sub("", "\n".join(own)), quoted, found


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean (unquoted text), n_quoted (quoted lines), and the passages: levels (0 own), keys and checks (128 bits)."""
    names = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(5)]
            for text in batch.column(3).to_pylist():
                clean, quoted, found = parse_message(text)
                both = np.frombuffer(b"".join(k for k, _ in found), np.int64)
                for col, v in zip(cols, (clean, quoted, list(found.values()), both[::2].tolist(), both[1::2].tolist())):
                    col.append(v)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    _spark.ship(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PARSED)


def passage_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): the earlier message that each linked message replies to."""
    known = parsed.filter("conv_id is not null and turn is not null")
    spread = known.select("conv_id", "turn", F.inline(F.arrays_zip(F.col("levels").alias("level"), F.col("keys").alias("key"), F.col("checks").alias("check"))))
    on = ["conv_id", "key", "check"]
    quoted = _spark.materialise(spread.filter("level > 0").groupBy("turn", *on).agg(F.min("level").alias("level")), "quotes")
    asked = F.xxhash64(*on)
    bitmap = parsed.sparkSession.sparkContext.broadcast(_bitmap.build(quoted.select(asked)))

    def likely(batches):
        for batch in batches:
            keep = _bitmap.holds(bitmap.value, batch.column(4).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], names=["conv_id", "turn", "key", "check"])

    own = spread.filter("level = 0").select("conv_id", "turn", "key", "check", asked).mapInArrow(likely, "conv_id long, turn long, key long, check long").distinct()
    events = quoted.select("turn", *on, "level", F.lit(None).cast("long").alias("source")).unionByName(own.select("turn", *on, F.lit(0).alias("level"), F.col("turn").alias("source")))
    events = events.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    # at one turn the quote comes before the message's own passages, so that it sees earlier turns only
    inside = W.partitionBy(*on, "stretch").orderBy("turn", F.col("source").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*on).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    events = _spark.materialise(events, "passages")
    carried = events.groupBy(*on, "stretch").agg(F.max("source").alias("_last"), F.max("level").alias("_level")).withColumn("_carry", F.max("_last").over(before)).filter("_level > 0 and _carry is not null").select(*on, "stretch", "_carry")
    near = events.withColumn("found", F.last("source", ignorenulls=True).over(inside)).filter("level > 0")
    seen = near.join(carried, [*on, "stretch"], "left").withColumn("found", F.coalesce("found", "_carry")).filter("found < turn")
    best = F.min(F.struct("level", (-F.col("found")).alias("back")))
    links = _spark.materialise(seen.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", (-F.col("b.back")).alias("reply_to")), "reply-links")
    _spark.discard(quoted, events)
    return links


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of linked messages, by pointer doubling."""
    state = _spark.materialise(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(MAX_DOUBLINGS):
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        steps = state.groupBy("conv_id", "thread").agg(F.count("*").alias("n")).join(up, ["conv_id", "thread"])
        steps = _spark.materialise(steps, "steps")
        if not steps.limit(1).count():
            _spark.discard(steps)
            return state
        step = _spark.skew_join(state, steps, ["conv_id", "thread"], how="left", heavy=HEAVY)
        old, state = state, _spark.materialise(step.select("conv_id", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")
        _spark.discard(old, steps)
    raise RuntimeError("threads did not converge")


def format_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, thread, depth, n_quoted and formatted of every message; (thread, turn) orders a conversation."""
    parsed = _spark.materialise(parse(messages), "messages", "zstd")
    links = passage_links(parsed)
    found = threads(links)
    _spark.discard(links)
    head, middle, tail = TEMPLATE
    out = parsed.drop("levels", "keys", "checks").join(found, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "n_quoted",
        F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), "clean", F.lit(tail)).alias("formatted"))


def write_conversations(messages: DataFrame, path: str) -> None:
    """Write formatted messages as files in conversation and reply order; a large conversation spans several files."""
    out = format_messages(messages)
    out.repartitionByRange("conv_id", "thread", "turn").sortWithinPartitions("conv_id", "thread", "turn").write.mode("overwrite").parquet(path)
