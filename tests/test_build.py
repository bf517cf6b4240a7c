"""Sources, sinks and the whole build on small files and a local server."""

import datetime
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import publish, send
from tidemark.sources import feeds, fetch
from tidemark.sources.saved import saved

NOW = datetime.datetime(2026, 3, 4, 12)
LEANS = ["left", "center-left", "center", "center-right", "right", "center"]
EVENTS = {  # title by outlet number, what it is about
    "dam": ["Kestrel Dam breach floods Orlow valley, hundreds evacuated", "Hundreds evacuated after Kestrel Dam breach in Orlow valley", "Orlow valley evacuated as Kestrel Dam breach spreads", "Kestrel Dam breach: Orlow valley villages evacuated", "Evacuated Orlow families wait after Kestrel Dam breach", "Kestrel Dam breach forces Orlow valley evacuation"],
    "vote": ["Marovian parliament passes fisheries treaty with Quell islands", "Quell islands fisheries treaty passes Marovian parliament", "Marovian parliament backs Quell fisheries treaty"],
    "alone": ["Librarians of Tansy borough catalogue forgotten lighthouse logs"],
}


def feed(n: int) -> str:
    rows = [(t[n], k) for k, t in EVENTS.items() if n < len(t)] + [("Opinion: we must act", "opinion")] * (n == 0)
    items = "".join(f"<item><title>{t}</title><link>https://o{n}.test/{k}/story</link><description>{t}. Officials in the region confirmed what happened there on Tuesday.</description><pubDate>Wed, 04 Mar 2026 0{n}:00:00 GMT</pubDate></item>" for t, k in rows)
    return f"<rss><channel><title>o{n}</title>{items}</channel></rss>"


def registry(url: str = "http://none.test") -> str:
    rows = [{"id": f"s{n}", "name": f"Outlet {n}", "lean": LEANS[n], "wire": n == 2, "url": f"{url}/s{n}", "outlet": f"o{n}", "topic": None} for n in range(6)]
    return json.dumps({"sources": rows, "leanWeights": {"left": -2, "center-left": -1, "center": 0, "center-right": 1, "right": 2}})


@pytest.fixture
def landed(tmp_path):
    (tmp_path / "raw").mkdir()
    for n in range(6):
        (tmp_path / "raw" / f"s{n}.xml").write_text(feed(n))
    (tmp_path / "sources.json").write_text(registry())
    return tmp_path


def run(spark, folder, *more):
    return cli.main(["--registry", f"{folder}/sources.json", "--raw", f"{folder}/raw", "--out", f"{folder}/docs", "--min-stories", "2", *more], spark, NOW)


def test_whole_build(spark, landed, capsys):
    """The flagship from landed feeds to stored documents, against what plain reading of the feeds says."""
    assert run(spark, landed) == 0
    said = capsys.readouterr().out
    body = json.loads((landed / "docs" / "digest.json").read_text())
    assert body == json.loads((landed / "docs" / "archive" / "2026-03-04.json").read_text()) and body["edition"] == "2026-03-04"
    assert body["feeds"] == {"attempted": 6, "succeeded": 6, "failed": []}
    got = body["stories"]
    assert [s["sourceCount"] for s in got] == [6, 3, 1] and [s["rank"] for s in got] == [1, 2, 3]
    assert [{c["title"] for c in s["coverage"]} for s in got] == [set(EVENTS[k]) for k in ("dam", "vote", "alone")]
    assert [s["leanCount"] for s in got] == [5, 3, 1] and [s["wireCount"] for s in got] == [1, 1, 0]
    # The leans reach over the whole scale: spread 1. Breadth and diversity follow the published formulas.
    spread = 1.0
    assert got[0]["leanSpread"] == spread and got[2]["leanSpread"] == 0
    assert got[0]["scoreComponents"]["breadth"] == pytest.approx(8.42, abs=0.006) and got[0]["scoreComponents"]["diversity"] == pytest.approx(1.4 * 4 + 2.2 * spread, abs=0.006)
    assert got[0]["publishedAt"] == "2026-03-04T05:00:00.000Z" and got[0]["scoreComponents"]["freshness"] == pytest.approx(2.5 * 0.5 ** (7 / 18), abs=0.006)
    assert "6 of 6 feeds" in said and "6 outlets, 5 leans, 1 agencies" in said
    stored = feeds.read_editions(spark, f"{landed}/docs/archive", "latest").select("edition", F.inline("stories"))
    assert feeds.select_story(stored, "2").first()["sourceCount"] == 3 and feeds.select_story(stored, "LIGHTHOUSE").first()["rank"] == 3
    atom = publish.build_atom(stored, "2026-03-04T12:00:00Z", "https://site.test", "https://site.test/feed.xml")
    assert atom.count("<entry>") == 3 and "6 outlets · 5 editorial leans" in atom


def test_dry_run_and_guards(spark, landed, capsys):
    assert run(spark, landed, "--dry-run", "--quiet") == 0 and not (landed / "docs").exists()
    assert "Kestrel" in capsys.readouterr().out
    for n in range(4):
        (landed / "raw" / f"s{n}.xml").unlink()
    assert run(spark, landed) == 1 and not (landed / "docs").exists()
    assert "only 2 feeds answered" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.parse_args(["--registry", "x", "--unknown"])


def test_fixture_items_are_taken_as_they_are(spark, landed):
    rows = [{"sourceId": f"s{n}", "title": t, "description": "", "link": "https://x.test/opinion/a", "published": "2020-01-01T00:00:00Z"} for n, t in enumerate(EVENTS["dam"][:3])]
    (landed / "fixture.json").write_text(json.dumps(rows))
    assert run(spark, landed, "--fixture", f"{landed}/fixture.json", "--quiet") == 0
    assert [s["sourceCount"] for s in json.loads((landed / "docs" / "digest.json").read_text())["stories"]] == [2, 1]


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            if self.path == "/s1":
                self.send_response(302)
                self.send_header("Location", "/s0")
                return self.end_headers()
            fine = self.path in ("/s0", "/s2") or self.path == "/s3" and seen.count("/s3") > 1
            self.send_response(200 if fine else 503)
            self.end_headers()
            self.wfile.write((feed(int(self.path[-1])) if self.path != "/s2" else "<rss></rss>").encode())

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body["title"], self.headers["Authorization"]))
            self.send_response(500 if body["title"] == "bad" else 200)
            self.end_headers()

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_fetch_follows_retries_and_tallies(spark, server, tmp_path):
    url, seen = server
    (tmp_path / "sources.json").write_text(registry(url))
    known, weights = feeds.read_registry(spark, f"{tmp_path}/sources.json")
    assert weights["left"] == -2 and known.count() == 6
    log = spark.createDataFrame(fetch.fetch_log(saved(fetch.fetch(known, 5))).collect())
    by = {r["source_id"]: (r["ok"], r["items"], r["error"]) for r in log.collect()}
    assert by == {"s0": (True, 4, None), "s1": (True, 4, None), "s2": (True, 0, None), "s3": (True, 1, None), "s4": (False, 0, "HTTP 503"), "s5": (False, 0, "HTTP 503")}
    assert seen.count("/s4") == 2 and seen.count("/s3") == 2
    assert fetch.tally(log).first().asDict(recursive=True) == {"attempted": 6, "succeeded": 4, "failed": [{"id": k, "error": "HTTP 503"} for k in ("s4", "s5")]}
    assert [r["source_id"] for r in fetch.probe_list(log).collect()] == ["s0", "s1", "s3", "s2", "s4", "s5"]
    assert fetch.probe_passes(log, 3) and not fetch.probe_passes(log)
    assert fetch.get(None) == (None, "no url") and len(fetch.get("http://127.0.0.1:1/x" + "y" * 300)[1]) <= 120
    assert len(json.loads(send.as_json(log))) == 6


def test_messages_are_sent_one_by_one(spark, server):
    url, seen = server
    rows = spark.createDataFrame([(3, "third"), (1, "first"), (2, "bad")], "rank int, title string").select("rank", F.to_json(F.struct("title")).alias("message"))
    failed = send.post_messages(rows, url, "t0k")
    assert [f[0] for f in failed] == [2] and seen == [(t, "Bearer t0k") for t in ("first", "bad", "third")]


def test_report_of_nothing(spark):
    out = io.StringIO()
    empty = spark.createDataFrame([], "rank int, topicShort string, title string, sourceCount int, leanCount int, wireCount int, score double, url string")
    send.dry_run(empty, {"attempted": 1, "succeeded": 0, "failed": [{"id": "a", "error": "x"}]}, out)
    assert out.getvalue() == "0 of 1 feeds\n  a: x\n"
