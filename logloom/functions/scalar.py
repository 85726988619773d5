"""Scalar functions as Column expressions: classes of lines, names, sizes, durations, search text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Classes of transcript lines.
CONVERSATIONAL = ("user", "assistant", "system")
STATE_LINES = (
    "last-prompt", "ai-title", "mode", "permission-mode", "file-history-snapshot", "queue-operation", "attachment", "agent-name", "bridge-session",
    "file-history-delta", "started", "result",
)
CHAT_ROLES = ("user", "assistant")
TIER_RANK = {"session": 0, "subagent": 1, "workflow_agent": 2}


def fold_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def contains_ci(c: Column, value: str) -> Column:
    """LIKE '%value%' without case; % and _ of the value stay wildcards."""
    return c.ilike(f"%{value}%")


def vector_class(role: Column) -> Column:
    return F.when(role.isin(*CHAT_ROLES), "chat").otherwise("tools")


def speaker(line_type: Column, has_text: Column) -> Column:
    return F.when((line_type == "user") & has_text, "human").when(line_type == "assistant", "ai").otherwise("system")


def live_heat(seconds: Column) -> Column:
    return F.when(seconds <= 30, "hot").when(seconds <= 120, "warm").otherwise("cool")


def tier_rank(tier: Column) -> Column:
    out = F.lit(len(TIER_RANK))
    for name, rank in TIER_RANK.items():
        out = F.when(tier == name, F.lit(rank)).otherwise(out)
    return out


def diff_state(known_mtime: Column, known_size: Column, known_status: Column, mtime: Column, size: Column) -> Column:
    """new, changed or unchanged against what is known; a row without known columns is new."""
    return (
        F.when(known_mtime.isNull(), "new")
        .when((known_mtime != mtime) | (known_size != size) | ~known_status.eqNullSafe("imported"), "changed")
        .otherwise("unchanged")
    )


def index_state(known_mtime: Column, known_size: Column, known_status: Column, mtime: Column, size: Column) -> Column:
    """new, failed (before stale), stale or current."""
    return (
        F.when(known_mtime.isNull(), "new")
        .when(known_status == "failed", "failed")
        .when((known_mtime != mtime) | (known_size != size), "stale")
        .otherwise("current")
    )


def uuid_of_rollout(name: Column) -> Column:
    """The last five hyphen groups of a rollout file's name without its suffix."""
    return F.array_join(F.slice(F.split(F.regexp_replace(name, r"\.jsonl$", ""), "-"), -5, 5), "-")


def agent_display_name(agent: Column) -> Column:
    """The name in an agent id, agent-a<name>-<16 or more hex>; null without that end or if no name is before it."""
    rest = F.substring(F.regexp_replace(agent, "^agent-", ""), 2, 1 << 30)
    own = F.regexp_replace(agent, "^agent-", "").startswith("a") & rest.rlike("[0-9a-f]{16}$")
    return F.when(own, F.nullif(F.regexp_replace(rest, "-?[0-9a-f]{16,}$", ""), F.lit("")))


def display_label(uuid: Column, agent: Column) -> Column:
    """An agent's name, else the beginning of its id, and of the uuid where there is no agent."""
    return F.coalesce(agent_display_name(agent), F.substring(agent, 1, 10), F.substring(uuid, 1, 8))


def session_label(uuid: Column, agent: Column) -> Column:
    """The uuid's beginning, and the agent's id where there is one."""
    return F.concat_ws(" · ", F.substring(uuid, 1, 8), agent)


def sanitize_name(name: Column) -> Column:
    """Lower case, runs of other than letters and digits to one _, trimmed, t_ before a digit; null where nothing
    or more than 48 characters are left."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(F.char_length(flat).between(1, 48), F.when(flat.rlike(r"^\p{N}"), F.concat(F.lit("t_"), flat)).otherwise(flat))


def live_size(size: Column) -> Column:
    """999 B, 1 KB (whole, cut off), 2.0 MB and no larger unit."""
    mb = F.concat(F.format_string("%.1f", F.round(size / 1e6, 1)), F.lit(" MB"))
    return F.when(size < 1000, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1_000_000, F.concat(F.floor(size / 1000).cast("string"), F.lit(" KB"))).otherwise(mb)


def human_bytes(size: Column) -> Column:
    """1000-based: 999 B, 1.5 KB, 2.0 MB, 3.1 GB."""
    out = F.format_string("%d B", size.cast("long"))
    for unit, scale in (("KB", 1e3), ("MB", 1e6), ("GB", 1e9)):
        out = F.when(size >= scale, F.concat(F.format_string("%.1f", F.round(size / scale, 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def live_ago(seconds: Column) -> Column:
    """4s, 1m 07s, 75m 00s; never below 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0).cast("long"))
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), F.pmod(s, F.lit(60))))


def window_label(seconds: Column) -> Column:
    """5 min, 1 hour, 24 hours."""
    hours = F.floor(seconds / 3600)
    return F.when(seconds < 3600, F.format_string("%d min", F.floor(seconds / 60))).otherwise(F.concat(F.format_string("%d hour", hours), F.when(hours == 1, "").otherwise("s")))


def run_duration(seconds: Column) -> Column:
    """Below a minute 12.3s, else 4m 05s."""
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.format_string("%.1fs", F.round(seconds.cast("double"), 1))).otherwise(
        F.format_string("%dm %02ds", F.floor(whole / 60), F.pmod(whole, F.lit(60)))
    )


def eta_seconds(done_events: Column, done_vectors: Column, left_events: Column, vectors_per_second: Column) -> Column:
    """Seconds that the remaining events will take at the vectors an event has had so far."""
    return F.try_divide(F.try_divide(done_vectors, done_events) * left_events, vectors_per_second)


def _utc(epoch: Column) -> Column:
    """Seconds as a time in UTC, whatever the session's time zone."""
    return F.timestamp_add("SECOND", epoch, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def utc_stamp(epoch: Column, layout: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.when(epoch > 0, F.date_format(_utc(epoch), layout)).otherwise("—")


def compact_stamp(c: Column, epoch: bool = False) -> Column:
    """MM-dd HH:mm of seconds, or of an ISO stamp."""
    if epoch:
        return utc_stamp(c, "MM-dd HH:mm")
    return F.when(F.char_length(c) >= 16, F.replace(F.substring(c, 6, 11), F.lit("T"), F.lit(" "))).otherwise("—")


def iso_stamp(epoch: Column) -> Column:
    return F.date_format(_utc(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def short_time(ts: Column) -> Column:
    """The time of day in an ISO stamp."""
    return F.when(F.char_length(ts) >= 19, F.substring(ts, 12, 8)).otherwise("—")


def pad_left(c: Column, n: int) -> Column:
    """Like lpad, but longer texts stay whole."""
    return F.when(F.char_length(c) >= n, c).otherwise(F.lpad(c, n, " "))


def pad_right(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) >= n, c).otherwise(F.rpad(c, n, " "))


def one_line(c: Column, n: int) -> Column:
    """A text on one line: line ends shown as a sign, at most n characters."""
    flat = F.replace(c, F.lit("\n"), F.lit("⏎ "))
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def csv_list(c: Column) -> Column:
    """a, b,,c as [a, b, c]."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def short_path(dir_name: Column, tier: Column, uuid: Column, agent: Column, run: Column) -> Column:
    """The project folder's last two parts, then what tells the file: uuid, uuid and agent, or run and agent."""
    parts = F.filter(F.split(dir_name, "-"), lambda x: x != "")
    project = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "-")
    own, who = F.substring(uuid, 1, 8), F.coalesce(F.substring(agent, 1, 10), F.lit("?"))
    flow = F.concat_ws("/", project, F.coalesce(run, F.lit("?")), who)
    return F.when(tier == "session", F.concat_ws("/", project, own)).when(tier == "subagent", F.concat_ws("/", project, own, who)).otherwise(flow)


def token_cost(chars: Column, schema_bytes: Column) -> Column:
    return F.greatest(F.lit(40), F.floor((chars + schema_bytes) / 4).cast("int"))


def truncated(text: Column, most: int = 1200) -> Column:
    """Text as shown in a reader: at most ``most`` characters, then a line with how many are left."""
    n = F.char_length(text)
    return F.when(n > most, F.concat(F.substring(text, 1, most), F.format_string("\n  […%d more chars]", n - most))).otherwise(text)


def rendered(seq: Column, role: Column, ts: Column, text: Column, most: int = 1200) -> Column:
    """An event as text for a reader: number, role and stamp, its text, a blank line."""
    stamp = F.when(F.coalesce(ts, F.lit("")) != "", F.concat(F.lit(" "), F.substring(ts, 1, 19))).otherwise("")
    return F.concat(F.lit("#"), seq.cast("string"), F.lit(" "), F.coalesce(role, F.lit("")), stamp, F.lit("\n"), truncated(F.coalesce(text, F.lit("")), most), F.lit("\n\n"))


def excerpt(text: Column, lines: int = 14, chars: int = 900) -> Column:
    """struct(shown, hidden): the first lines of a text within both bounds, cut at a line's end where
    there is one, and how many lines are not shown."""
    every = F.split(text, "\n")
    first = F.array_join(F.slice(every, 1, lines), "\n")
    cut = F.substring(first, 1, chars)
    at_line = F.when(F.instr(cut, "\n") > 0, F.regexp_replace(cut, r"\n[^\n]*$", "")).otherwise(cut)
    shown = F.when(F.char_length(first) > chars, at_line).otherwise(first)
    return F.struct(shown.alias("shown"), (F.size(every) - F.size(F.split(shown, "\n"))).alias("hidden"))
