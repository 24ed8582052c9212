"""Conversations rebuilt from message rows.

Rows are normalised (ids and conversation ids by case and outer spaces, roles to speakers, times to seconds). What arrives
of a conversation is read as *exports*: a run of its rows, in order of arrival within one scan partition, in which the
order spoken never goes back; a late row or a message sent again begins another one. A run is held in pieces of at most
``FRAGMENT`` messages, each with the first message of the next. ``assemble`` puts exports together: the message hashes at
the end of one must be those at the beginning of the next; contained exports go, the longest overlap of each end is an
edge, an end with two equally long overlaps to different exports is ambiguous and stays open, and the paths left are
merged by pointer doubling. A conversation whose exports come out as one path has the order of that path. Exports that
overlap nowhere (late rows) leave several paths; these are woven by time, because the order spoken is the order of time
and rows that came late are no fault of the conversation. Overlapping messages must agree in time and speaker, so a path
never contradicts the times. Repeated ids count once.

The result is held as *fragments* of at most ``FRAGMENT`` messages, so no task ever holds all of a long conversation; each
carries the first message of its successor and is put together by ``assemble`` again, which decides what opens the
conversation and where each message stands; pieces that do not come out as one path make it broken.

Defined results: null or blank conversation ids belong to no conversation; a null id is a message of its own; system
rows are ignored; null content is blank; at equal seconds the user's message comes first, then the id decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.hot import ranked
from paperloom.session import cut_lineage

FRAGMENT = 400
#: Conversations of several exports, and long ones, up to this many are sent to all executors (48 bytes a row); beyond, an ordinary join.
BROADCAST_ROWS = 20_000
SPEAKERS = {"user": ("user", "human"), "assistant": ("assistant", "ai", "bot"), "system": ("system",)}
SPACE = r"^[\s 　﻿]+|[\s 　﻿]+$"


def clean_id(column: str) -> F.Column:
    return F.lower(F.regexp_replace(column, SPACE, ""))


def speaker(role: str) -> F.Column:
    """user, assistant, system, or 'none' for a role that names no speaker."""
    base = F.lower(F.regexp_replace(F.coalesce(role, F.lit("")), SPACE, ""))
    out = F.lit("none")
    for name, words in SPEAKERS.items():
        out = F.when(base.isin(*words), name).otherwise(out)
    return out


def seconds(ts: str) -> F.Column:
    """Epoch seconds of a time in seconds, milliseconds or microseconds."""
    size = F.abs(ts)
    return F.when(size >= 10**14, F.floor(F.col(ts) / 1_000_000)).when(size >= 10**11, F.floor(F.col(ts) / 1000)).otherwise(F.col(ts))


def blank(text: str | F.Column) -> F.Column:
    """Null, or without any letter or digit."""
    return ~F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"[\p{L}\p{N}]")


def normalised(messages: DataFrame, content: bool = False, arrival: bool = False) -> DataFrame:
    """(conv, mid, speaker, second, turn, blank, hash[, content][, arrived]) without system rows and rows of no conversation; ``arrived`` rises within a scan partition, whose number is in the bits from 33 on."""
    mid = F.coalesce(clean_id("id"), F.concat(F.lit("?"), F.xxhash64("conversation_id", "role", "content", "timestamp").cast("string")))
    columns = [
        clean_id("conversation_id").alias("conv"),
        mid.alias("mid"),
        speaker("role").alias("speaker"),
        F.coalesce(seconds("timestamp"), F.lit(0)).cast("long").alias("second"),
        blank("content").alias("blank"),
        F.xxhash64(mid, F.regexp_replace(F.coalesce("content", F.lit("")), SPACE, "")).alias("hash"),
    ]
    more = [*([F.col("content")] if content else []), *([F.monotonically_increasing_id().alias("arrived")] if arrival else [])]
    out = messages.where("conversation_id is not null").select(*columns, *more)
    return out.where("conv != '' and speaker != 'system'").withColumn("turn", (F.col("speaker") != "user").cast("int"))


def exports(messages: DataFrame, content: bool = False) -> DataFrame:
    """(conv, export, turns): the export fragments in which the rows arrived; ``turns`` are in order spoken, at most ``FRAGMENT`` and the first of the next piece."""
    rows = normalised(messages, content, arrival=True).withColumn("part", F.shiftright("arrived", 33))
    here = Window.partitionBy("conv", "part").orderBy("arrived")
    spoken = F.struct("second", "turn", "mid")
    runs = rows.withColumn("at", F.row_number().over(here)).withColumn("fresh", F.coalesce(spoken <= F.lag(spoken).over(here), F.lit(True)))
    runs = runs.withColumn("start", F.max(F.when(F.col("fresh"), F.col("at"))).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    since = F.col("at") - F.col("start")
    piece = F.floor(since / FRAGMENT)
    homes = F.when((since > 0) & (since % FRAGMENT == 0), F.array(piece - 1, piece)).otherwise(F.array(piece))
    turn = F.struct("second", "turn", "mid", "speaker", "blank", "hash", *(["content"] if content else []))
    pieces = runs.select("conv", "part", "start", F.explode(homes).alias("piece"), "arrived", turn.alias("t")).groupBy("conv", "part", "start", "piece")
    return pieces.agg(F.min("arrived").alias("export"), F.array_sort(F.collect_list("t")).alias("turns")).select("conv", "export", "turns")


def woven(arrived: DataFrame) -> DataFrame:
    """(conv, mid, key, second, turn, speaker, blank, hash[, content]) from ``exports``, ordered by ``key``: the place on the path for conversations whose exports come out as one, else the time."""
    mark = F.transform("turns", lambda t: F.xxhash64(t["mid"], t["second"], t["turn"], t["speaker"], t["blank"], t["hash"]))
    unlike = arrived.groupBy("conv", mark.alias("hashes")).agg(F.min("export").alias("fragment"))
    order = cut_lineage(assemble(unlike))
    alone = order.groupBy("conv").agg((F.min("root") == F.max("root")).alias("path"))
    # on a path an overlap has one place, so its rows are alike and count once
    laid = arrived.join(order.join(alone, "conv").withColumnRenamed("fragment", "export"), ["conv", "export"])
    rows = laid.select("conv", "path", "start", F.posexplode("turns").alias("at", "t"))
    return rows.select("conv", F.when(F.col("path"), F.col("start") + F.col("at")).otherwise(F.col("t.second")).alias("key"), "t.*")


def placed(rows: DataFrame, by: str = "second") -> DataFrame:
    """``rows``, in the order of ``by``, with the column ``fragment``: 0 for conversations of ordinary length, from 1 on ``FRAGMENT`` ranks each for the long ones, whose rows come out once per id."""
    long_ones = cut_lineage(rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > FRAGMENT).select("conv"))
    side = F.broadcast(long_ones) if long_ones.count() <= BROADCAST_ROWS else long_ones
    short = rows.join(side, "conv", "left_anti").withColumn("fragment", F.lit(0).cast("long"))
    rest = [c for c in rows.columns if c not in ("conv", "mid")]
    single = rows.join(side, "conv", "left_semi").groupBy("conv", "mid").agg(F.min(F.struct(*_first(rest))).alias("m")).select("conv", "mid", *(F.col(f"m.{c}").alias(c) for c in rest))
    place = ranked(single, "conv", by, [F.col(c) for c in dict.fromkeys([by, "second", "turn", "mid"])], "place")
    return short.unionByName(place.withColumn("fragment", (F.floor((F.col("place") - 1) / FRAGMENT) + 1).cast("long")).drop("place"))


def _first(columns: list[str]) -> list[str]:
    """The columns in the order in which the row of a repeated id is chosen."""
    return ["blank", "second", *(c for c in columns if c not in ("blank", "second"))]


def once(rows: DataFrame) -> DataFrame:
    """One row per (conversation, fragment, message id); partitioned by conversation and fragment, so that the next grouping needs no shuffle."""
    rest = [c for c in rows.columns if c not in ("conv", "fragment", "mid")]
    by = rows.repartition("conv", "fragment").groupBy("conv", "fragment", "mid")
    return by.agg(F.min(F.struct(*_first(rest))).alias("m")).select("conv", "fragment", "mid", *(F.col(f"m.{c}").alias(c) for c in rest))


def fragments(messages: DataFrame, content: bool = False) -> DataFrame:
    """(conv, fragment, turns, own): turns in order spoken; ``own`` of them belong to the fragment, one more may be carried from the next."""
    arrived = cut_lineage(exports(messages, content))
    once_only = F.size(F.array_distinct(F.transform("turns", lambda t: t["mid"]))) == F.size("turns")
    torn = cut_lineage(arrived.groupBy("conv").agg(F.count("*").alias("n"), F.bool_and(once_only).alias("ids")).where("n > 1 or not ids").select("conv"))
    side = F.broadcast(torn) if torn.count() <= BROADCAST_ROWS else torn
    alone = arrived.join(side, "conv", "left_anti").select("conv", F.lit(0).cast("long").alias("fragment"), "turns")
    fields = arrived.schema["turns"].dataType.elementType.names
    held = once(placed(cut_lineage(woven(arrived.join(side, "conv", "left_semi"))), "key"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("key", *fields))), lambda t: F.struct(*(t[c].alias(c) for c in fields)))
    whole = alone.unionByName(cut_lineage(held.groupBy("conv", "fragment").agg(ordered.alias("turns"))))
    whole = whole.withColumn("own", F.size("turns"))
    several = whole.where("fragment > 0")
    following = several.select("conv", (F.col("fragment") - 1).alias("fragment"), F.col("turns")[0].alias("carried"))
    turns_and_next = F.when(F.col("carried").isNull(), F.col("turns")).otherwise(F.concat("turns", F.array("carried")))
    carried = several.join(following, ["conv", "fragment"], "left").select("conv", "fragment", turns_and_next.alias("turns"), "own")
    return whole.where("fragment = 0").unionByName(carried)


def assemble(parts: DataFrame, rounds: int | None = None) -> DataFrame:
    """(conv, fragment, root, start) for parts (conv, fragment, hashes): the path a fragment lies on and its place there.

    Two fragments that hold the same hashes count once; a fragment contained in another has no row.
    """
    parts = cut_lineage(parts.where(F.size("hashes") > 0).select("conv", "fragment", "hashes"))
    counts = parts.groupBy("conv").agg(F.count("*").alias("n"))
    alone = parts.join(counts.where("n = 1"), "conv", "left_semi")
    many = parts.join(counts.where("n > 1"), "conv", "left_semi")
    heads = many.select("conv", F.col("fragment").alias("g"), F.col("hashes")[0].alias("h"))
    places = many.select("conv", F.col("fragment").alias("f"), F.posexplode("hashes").alias("p", "h"))
    met = places.join(heads, ["conv", "h"]).where("f != g").select("conv", "f", "g", "p")
    fh, gh = many.select("conv", F.col("fragment").alias("f"), F.col("hashes").alias("fh")), many.select("conv", F.col("fragment").alias("g"), F.col("hashes").alias("gh"))
    rest = F.expr("slice(fh, p + 1, size(fh))")
    compared = met.join(fh, ["conv", "f"]).join(gh, ["conv", "g"]).withColumn("rest", rest).withColumn("k", F.size("rest"))
    inside = F.expr("size(gh) <= k and slice(rest, 1, size(gh)) = gh and (size(gh) < size(fh) or f < g)")
    joined = F.expr("size(gh) > k and slice(gh, 1, k) = rest")
    verdict = cut_lineage(compared.select("conv", "f", "g", "k", F.size("fh").alias("n"), inside.alias("inside"), joined.alias("edge")))
    gone = verdict.where("inside").select("conv", F.col("g").alias("fragment")).distinct()
    edges = verdict.where("edge").join(gone.withColumnRenamed("fragment", "f"), ["conv", "f"], "left_anti").join(gone.withColumnRenamed("fragment", "g"), ["conv", "g"], "left_anti")
    out, into = Window.partitionBy("conv", "f"), Window.partitionBy("conv", "g")
    edges = edges.withColumn("best", F.max("k").over(out)).where("k = best").withColumn("ways", F.count("*").over(out)).where("ways = 1")
    edges = edges.withColumn("best", F.max("k").over(into)).where("k = best").withColumn("ways", F.count("*").over(into)).where("ways = 1")
    nodes = many.join(gone, ["conv", "fragment"], "left_anti").select("conv", "fragment")
    back = edges.select("conv", F.col("g").alias("fragment"), F.col("f").alias("root"), (F.col("n") - F.col("k")).cast("long").alias("start"))
    state = cut_lineage(nodes.join(back, ["conv", "fragment"], "left").select("conv", "fragment", F.coalesce("root", "fragment").alias("root"), F.coalesce("start", F.lit(0).cast("long")).alias("start")))
    longest = state.where("root != fragment").groupBy("conv").count().agg(F.max("count")).first()[0] or 1
    for _ in range(rounds if rounds is not None else max(0, (longest - 1).bit_length())):
        up = state.select("conv", F.col("fragment").alias("root"), F.col("root").alias("above"), F.col("start").alias("more"))
        state = cut_lineage(state.join(up, ["conv", "root"]).select("conv", "fragment", F.col("above").alias("root"), (F.col("start") + F.col("more")).alias("start")).repartition("conv", "fragment"))
    return alone.select("conv", "fragment", F.col("fragment").alias("root"), F.lit(0).cast("long").alias("start")).unionByName(state)


def paths(parts: DataFrame) -> DataFrame:
    """``assemble`` for the conversations that are held as several fragments."""
    return assemble(parts.where("fragment > 0").select("conv", "fragment", F.transform("turns", lambda t: t["hash"]).alias("hashes")))


def verdicts(conversations: DataFrame, parts: DataFrame, order: DataFrame) -> DataFrame:
    """(conversation_id, reason): the first reason to drop a conversation, null for those to keep; ``parts`` are its fragments, ``order`` their paths."""
    after = F.expr("slice(turns, 2, own)")
    own = F.expr("slice(turns, 1, own)")
    double = F.zip_with(own, after, lambda a, b: (a["speaker"] == "assistant") & F.coalesce(b["speaker"] == "assistant", F.lit(False)))
    unanswered = F.zip_with(own, after, lambda a, b: F.coalesce(a["speaker"] == "user", F.lit(False)) & ~F.coalesce((b["speaker"] == "assistant") & ~b["blank"], F.lit(False)))
    true = lambda x: F.coalesce(x, F.lit(False))
    facts = parts.select(
        "conv",
        "fragment",
        F.exists(own, lambda t: ~t["blank"]).alias("spoken"),
        F.exists(own, lambda t: t["speaker"] == "none").alias("nobody"),
        F.exists(double, true).alias("double"),
        F.exists(unanswered, true).alias("unanswered"),
        (F.col("turns")[0]["speaker"] == "assistant").alias("opens"),
        (F.col("fragment") == 0).alias("alone"),
    ).join(order, ["conv", "fragment"], "left")
    per = facts.groupBy("conv").agg(
        F.bool_or("spoken").alias("spoken"),
        F.bool_or("nobody").alias("nobody"),
        F.bool_or("double").alias("double"),
        F.bool_or("unanswered").alias("unanswered"),
        F.bool_or(F.col("opens") & (F.col("alone") | F.coalesce(F.col("start") == 0, F.lit(False)))).alias("opens"),
        F.coalesce(F.min("root") != F.max("root"), F.lit(False)).alias("gap"),
    )
    known = conversations.select(clean_id("id").alias("conv")).where("conv is not null and conv != ''").distinct().withColumn("known", F.lit(True))
    every = per.join(known, "conv", "full")
    broken = F.col("known").isNull() | F.col("nobody") | F.col("double") | F.col("opens") | F.col("gap")
    reason = F.when(~F.coalesce("spoken", F.lit(False)), "empty").when(broken, "broken").when(F.col("unanswered"), "missing_reply")
    return every.select(F.col("conv").alias("conversation_id"), reason.alias("reason"))


def found(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    parts = fragments(messages)
    return verdicts(conversations, parts, paths(parts)).where("reason is not null")


def turns(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """The kept conversations, one row per turn: (conversation_id, position, speaker, content)."""
    parts = fragments(messages, content=True)
    order = cut_lineage(paths(parts))
    kept = verdicts(conversations, parts, order).where("reason is null").select(F.col("conversation_id").alias("conv"))
    # the last fragment may be no more than what its predecessor carries
    gone = parts.where("fragment > 1").select("conv", "fragment").join(order, ["conv", "fragment"], "left_anti").select("conv", (F.col("fragment") - 1).alias("fragment"), F.lit(1).alias("more"))
    # the places are joined without the texts, so that these are dealt out once
    places = order.join(kept, "conv", "left_semi").join(gone, ["conv", "fragment"], "left").select("conv", "fragment", "start", F.coalesce("more", F.lit(0)).alias("more"))
    short = parts.where("fragment = 0").join(kept, "conv", "left_semi").select("conv", F.lit(0).cast("long").alias("start"), "turns")
    long = parts.where("fragment > 0").join(places, ["conv", "fragment"]).select("conv", "start", F.expr("slice(turns, 1, own + more)").alias("turns"))
    rows = short.unionByName(long).select("conv", "start", F.posexplode("turns").alias("at", "t"))
    return rows.select(F.col("conv").alias("conversation_id"), (F.col("start") + F.col("at")).alias("position"), F.col("t.speaker").alias("speaker"), F.regexp_replace("t.content", SPACE, "").alias("content"))
