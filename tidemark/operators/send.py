"""Messages over HTTP, and what a run would publish as text."""

from __future__ import annotations

import json
import sys
import urllib.request

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def post(server: str, body: str, token: str | None = None, timeout: float = 20.0) -> str | None:
    """Sends one message; what went wrong, or None."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(server, body.encode(), headers, method="POST"), timeout=timeout):
            return None
    except Exception as e:  # the other messages are sent all the same
        return str(e)[:120]


def post_messages(messages: DataFrame, server: str, token: str | None = None) -> list[tuple[int, str]]:
    """Sends the messages of one edition (at most its limit of stories) one after the other; (rank, error) of those that failed."""
    rows = messages.orderBy("rank").select("rank", "message").collect()
    return [(r["rank"], said) for r in rows if (said := post(server, r["message"], token)) is not None]


def report_lines(stories: DataFrame, feeds: dict | None = None) -> list[str]:
    """What an edition holds, a line for the feeds and two a story: bounded by the limit of stories."""
    lines = [f"{feeds['succeeded']} of {feeds['attempted']} feeds" + "".join(f"\n  {x['id']}: {x['error']}" for x in feeds["failed"])] if feeds else []
    for r in stories.orderBy("rank").select("rank", "topicShort", "title", "sourceCount", "leanCount", "wireCount", F.col("score").alias("score"), "url").collect():
        lines += [f"{r['rank']:>3}. [{r['topicShort']}] {r['title']}", f"     {r['sourceCount']} outlets, {r['leanCount']} leans, {r['wireCount']} agencies, score {r['score']}  {r['url'] or ''}".rstrip()]
    return lines


def dry_run(stories: DataFrame, feeds: dict | None = None, out=None) -> None:
    (out or sys.stdout).write("\n".join(report_lines(stories, feeds)) + "\n")


def as_json(log: DataFrame) -> str:
    """A fetch log, one row a feed of the registry, as a JSON array."""
    return json.dumps([r.asDict() for r in log.collect()], ensure_ascii=False)
