"""Problem 6: conversations rebuilt from message rows.

Rows are put in order within their channel, the channel is split into sessions where it
was silent for longer than a gap that the gaps themselves show, roles are read or
inferred, and what lacks replies is dropped. Sessions of one conversation can be joined
again, where the channel's name says that they belong together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.plans.layout import cut, drop
from papyrine.plans.ordered import by_range, lag_across, running_sums

#: Gaps are counted in so many bins for each doubling; a valley holds at most this share of the peak behind it, and what lies behind it at least this share of all gaps.
BINS, VALLEY, BEHIND = 2, 0.25, 0.005

# Spellings of the roles.
ROLES = {
    "user": ["user", "human", "usr", "customer", "client", "person", "me"],
    "assistant": ["assistant", "ai", "bot", "model", "agent", "chatbot", "gpt", "llm"],
    "system": ["system", "sys", "developer"],
}
_OUTER = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def role_of(role):
    pairs = [F.lit(x) for k, names in ROLES.items() for n in names for x in (n, k)]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_replace(role, _OUTER, "")))


def instant_of(text):
    """Microseconds since 1970 UTC of an ISO time or Unix seconds, milliseconds or microseconds; null if unreadable."""
    t = F.regexp_replace(text, _OUTER, "")
    iso = r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d(?:[.,]\d{1,9})?) ?(Z|z|[+-]\d\d:?\d\d)?$"
    zone = F.regexp_replace(F.upper(F.regexp_extract(t, iso, 3)), r"^([+-]\d\d)(\d\d)$", "$1:$2")
    written = F.concat(F.regexp_extract(t, iso, 1), F.lit(" "), F.translate(F.regexp_extract(t, iso, 2), ",", "."), F.when(zone == "", "Z").otherwise(zone))
    return (
        F.when(t.rlike(r"^\d{10}$"), t.cast("long") * 1_000_000)
        .when(t.rlike(r"^\d{13}$"), t.cast("long") * 1_000)
        .when(t.rlike(r"^\d{16}$"), t.cast("long"))
        .when(t.rlike(r"^\d{10}\.\d{1,6}$"), (t.cast("decimal(18,6)") * 1_000_000).cast("long"))
        .when(t.rlike(iso), F.unix_micros(written.try_cast("timestamp")))
    )


def _once(messages: DataFrame) -> DataFrame:
    """One row per message id, as first received; rows without id each stand for themselves. Contents are held as two hashes."""
    said = F.regexp_replace("content", _OUTER, "")
    m = messages.where("conversation_id is not null").select(
        F.col("id").alias("message_id"),
        F.coalesce("id", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).alias("_key"),
        "conversation_id", "received_at", role_of(F.col("role")).alias("role"), instant_of(F.col("created_at")).alias("at"),
        F.xxhash64(said).alias("said"), F.xxhash64(F.lit(1), said).alias("said2"), F.coalesce(F.length(F.regexp_replace(said, r"[\s\p{Z}\p{C}]", "")) > 0, F.lit(False)).alias("visible"),
        F.get_json_object("metadata", "$.reply_to").alias("reply_to"),
    )
    kept = ["message_id", "conversation_id", "role", "at", "said", "said2", "visible", "reply_to"]
    return m.groupBy("_key").agg(F.min_by(F.struct(*kept), F.struct(F.col("received_at").isNull(), "received_at", "conversation_id", "at", "role", "said")).alias("r")).select("_key", "r.*")


def _sound(m: DataFrame, conversations: DataFrame | None, infer: bool) -> DataFrame:
    """Messages of channels whose every message can be read; known ones only, if a table of them is given."""
    ok = F.col("at").isNotNull() & F.col("visible")
    if not infer:
        ok = ok & F.col("role").isNotNull()
    whole = m.groupBy("conversation_id").agg(F.min(ok.cast("int")).alias("ok"), F.count("*").alias("rows")).where("ok = 1").drop("ok")
    if conversations is not None:
        whole = whole.join(conversations.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")
    return m.join(whole, "conversation_id").drop("visible")


def _depths(m: DataFrame) -> DataFrame:
    """(_key, depth) of messages that answer one of the same conversation and instant.

    Links are doubled until none leads further. What still leads on after as many rounds as the
    number of links has bits runs in a circle and has no depth, so that its ids decide.
    """
    tied = m.select("conversation_id", "at", "_key", "reply_to")
    parents = tied.select("conversation_id", "at", F.col("_key").alias("reply_to"))
    links = cut(tied.where("reply_to is not null and reply_to != _key").join(parents, ["conversation_id", "at", "reply_to"]).select("_key", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")))
    for _ in range(links.count().bit_length() + 1):
        over = links.select(F.col("_key").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        if links.where("up is not null").join(over, "up", "left_semi").isEmpty():
            return links.select("_key", "depth")
        last, links = links, cut(links.join(over, "up", "left").select("_key", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        drop(last)
    over = links.select(F.col("_key").alias("up"))
    return links.join(over, "up", "left_anti").select("_key", "depth")


# -- sessions ------------------------------------------------------------------------------------


def second_mode(counts: dict[int, int]) -> float | None:
    """The middle of the deepest valley between the commonest gaps and a later peak, in bins; None where there is no second peak."""
    total = sum(counts.values())
    if not total:
        return None
    bins = range(min(counts), max(counts) + 1)
    smooth = [sum(counts.get(b + j, 0) * w for j, w in ((-1, 1), (0, 2), (1, 1))) / 4 for b in bins]
    exact = [counts.get(b, 0) for b in bins]
    top = max(range(len(smooth)), key=smooth.__getitem__)
    best = None
    for v in range(top + 1, len(smooth) - 1):
        peak = max(smooth[v + 1 :])
        if smooth[v] <= VALLEY * peak and sum(exact[v + 1 :]) >= BEHIND * total and (best is None or peak - smooth[v] > best[0]):
            best = (peak - smooth[v], v)
    if best is None:
        return None
    # The valley's floor may be several bins wide; its middle is taken.
    end = best[1]
    while end + 1 < len(smooth) and smooth[end + 1] == smooth[best[1]]:
        end += 1
    return bins[0] + (best[1] + end + 1) / 2


def calibrated_gap(gaps: DataFrame) -> int | None:
    """Microseconds of silence that part sessions, from rows ``gap`` between neighbours of a channel; None where gaps have one mode.

    Gaps are counted in bins of their logarithm (64 * BINS at most), so all of them are used and little is brought together.
    """
    rows = gaps.where("gap > 0").groupBy(F.floor(F.log2("gap") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    at = second_mode({r.bin: r.n for r in rows})
    return None if at is None else int(math.exp2(at / BINS))


ORDER = ["at", "depth", "_key"]


def _in_order(messages: DataFrame, conversations: DataFrame | None, infer: bool) -> DataFrame:
    """Checked messages with the one before in their channel (struct ``p``), written once.

    Channels are cut into ranges of time, so one of any length is in many; messages of an instant stay together.
    """
    m = by_range(_sound(_once(messages), conversations, infer).drop("rows"), ["conversation_id"], ["at"])
    n = m.join(_depths(m), "_key", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))).drop("reply_to")
    if infer:
        n = lag_across(n, ["conversation_id"], "chunk", ORDER, ["role"], "q")
        # A message of no known role answers what stands before it.
        n = n.withColumn("role", F.coalesce("role", F.when(F.col("q.role") == "user", "assistant").when(F.col("q").isNull() | F.col("q.role").isin("assistant", "system"), "user"))).drop("q")
    out = cut(lag_across(n, ["conversation_id"], "chunk", ORDER, ["at", "role", "said", "said2"], "p"))
    drop(m)
    return out


def rebuild_conversations(messages: DataFrame, conversations: DataFrame | None = None, gap_us: int | str | None = "calibrated", join_sessions: bool = False, infer_roles: bool = False) -> DataFrame:
    """(conversation_id, session_no, turn_no, message_id, role, at) of the conversations that are kept.

    The channel is ``conversation_id``; it is split into sessions where it was silent for
    longer than ``gap_us``, by default the valley that ``calibrated_gap`` finds between the gaps
    inside and between sessions, or not at all where it finds none or the gap is None.
    Order is by instant, then by the chain of replies within an instant, then by id.
    Consecutive messages of one role and content count once. A session is kept if it is system
    messages, then one or more times user, assistant. With ``join_sessions`` the sessions
    of a conversation id are parts of one conversation, which is judged and numbered as a whole.
    A channel with any unreadable time, unknown role or invisible content is dropped whole;
    with ``infer_roles`` a message of unknown role answers the one before it. Null
    ids of conversations are dropped, empty tables give none, and repeated rows count once.
    """
    m = _in_order(messages, conversations, infer_roles)
    gap = calibrated_gap(m.select((F.col("at") - F.col("p.at")).alias("gap"))) if gap_us == "calibrated" else gap_us
    m = m.withColumn("starts", F.col("p").isNull() | (F.lit(False) if gap is None else F.coalesce(F.col("at") - F.col("p.at") > gap, F.lit(False))))
    unit = ["conversation_id"] if join_sessions else ["conversation_id", "session_no"]
    opens = F.col("p").isNull() if join_sessions else F.col("starts")
    repeat = ~opens & (F.col("p.role") == F.col("role")) & (F.col("p.said") == F.col("said")) & (F.col("p.said2") == F.col("said2"))
    before = F.when(opens, F.lit("start")).otherwise(F.col("p.role"))
    good = F.when(F.col("role") == "system", before.isin("start", "system")).when(F.col("role") == "user", before.isin("start", "system", "assistant")).otherwise(before == "user")
    m = m.withColumn("repeat", F.coalesce(repeat, F.lit(False))).withColumn("good", (F.col("repeat") | F.coalesce(good, F.lit(False))).cast("int")).drop("p", "said", "said2")
    m = running_sums(m, ["conversation_id"], "chunk", ORDER, {"session_no": F.col("starts"), "turn": ~F.col("repeat")}).drop("starts")
    m = cut(m.withColumn("session_no", (F.col("session_no") - 1).cast("int")))
    kept = m.groupBy(*unit).agg(F.min("good").alias("good"), F.max_by("role", F.struct(*ORDER)).alias("last"), F.min("turn").alias("first")).where("good = 1 and last = 'assistant'").drop("good", "last")
    out = m.where(~F.col("repeat")).join(kept, unit)
    return out.select("conversation_id", "session_no", (F.col("turn") - F.col("first")).cast("int").alias("turn_no"), "message_id", "role", F.timestamp_micros("at").alias("at"))
