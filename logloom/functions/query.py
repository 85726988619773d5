"""What a search text means: routing, phrases, windows of time. Runs while a plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

#: Latin letters with the letter that token search takes them for.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


@dataclass(frozen=True)
class TextQuery:
    """phrases: texts to be held all; prefix: whether the last phrase may go on; engine: substring or token."""

    engine: str
    phrases: tuple[str, ...]
    prefix: bool = False


def routes_to_substring(text: str) -> bool:
    return len(text.strip()) >= 3


def compile_query(text: str, engine: str | None = None) -> TextQuery:
    """Splits on white space, all words to be found. Substring search drops words under three characters
    (none left: nothing is found); token search lets the last word be a prefix."""
    words = text.split()
    if engine is None:
        engine = "substring" if routes_to_substring(text) else "token"
    if engine == "substring":
        return TextQuery(engine, tuple(w.lower() for w in words if len(w) >= 3))
    if engine != "token":
        raise ValueError(f"unknown engine {engine!r}")
    return TextQuery(engine, tuple(words), bool(words))


def like_pattern(value: str) -> str:
    return f"%{value}%"


def parse_since(value: str | None, now: datetime) -> int | None:
    """Epoch seconds of a window's begin: all, today, 90m, 12h, 7d or yyyy-MM-dd; None: no window or not understood."""
    text = (value or "").strip().lower()
    if text in ("", "all"):
        return None
    if text == "today":
        return int(now.replace(hour=0, minute=0, second=0, microsecond=0).timestamp())
    if m := re.fullmatch(r"(\d{1,9})([mhd])", text):
        n = int(m[1])
        try:
            return int((now - timedelta(minutes=n * {"m": 1, "h": 60, "d": 1440}[m[2]])).timestamp()) if n else None
        except OverflowError:
            return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        try:
            day = datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=now.tzinfo or timezone.utc)
        except ValueError:
            return None
        return int(day.timestamp()) if 2000 <= day.year <= 2100 else None
    return None
