"""Downloads from a server that misbehaves, the chart of a comparison, and locks."""

import gzip
import threading
import xml.etree.ElementTree as ET
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from marlstone.operators import locks
from marlstone.plans import chart, measure
from marlstone.sources import download

BODY = gzip.compress(b"tconst\tnumVotes\n" + bytes(range(256)) * 200, mtime=0)


class Server(ThreadingHTTPServer):
    """Serves BODY under any name. breaks: how many transfers stop half-way; ranges: whether parts can be asked for; head: whether HEAD is answered."""

    def __init__(self, breaks=0, ranges=True, head=True, body=BODY):
        self.breaks, self.ranges, self.head, self.body, self.asked = breaks, ranges, head, body, []
        super().__init__(("127.0.0.1", 0), Handler)

    def url(self, name="title.ratings.tsv.gz"):
        return f"http://127.0.0.1:{self.server_port}/{name}"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_HEAD(self):
        self.send_response(200 if self.server.head else 405)
        if self.server.head:
            self.send_header("Content-Length", str(len(self.server.body)))
        self.end_headers()

    def do_GET(self):
        server, asked = self.server, self.headers.get("Range")
        server.asked.append(asked)
        body, whole = server.body, len(server.body)
        if asked and server.ranges:
            first, _, last = asked.removeprefix("bytes=").partition("-")
            body = body[int(first) : int(last) + 1 if last else whole]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {first}-{int(first) + len(body) - 1}/{whole}")
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        if server.breaks and asked != "bytes=0-0":
            server.breaks -= 1
            body = body[: len(body) // 2]
        self.wfile.write(body)


@pytest.fixture
def serve():
    running = []

    def start(**options):
        running.append(Server(**options))
        threading.Thread(target=running[-1].serve_forever, daemon=True).start()
        return running[-1]

    yield start
    for server in running:
        server.shutdown()
        server.server_close()


def test_whole_and_broken_transfers(serve, tmp_path):
    waits = []
    for k, (options, said, pauses) in enumerate([
        ({}, "downloaded", []),
        ({"breaks": 3}, "resumed", [2, 4, 8]),
        ({"breaks": 1, "ranges": False}, "resumed", [2]),
        ({"head": False}, "downloaded", []),
    ]):
        server, target = serve(**options), tmp_path / f"{k}.tsv.gz"
        waits.clear()
        assert download.fetch(server.url(), target, wait=waits.append) == said and waits == pauses, options
        assert target.read_bytes() == BODY and not target.with_name(target.name + ".part").exists()
        assert download.fetch(server.url(), target) == "skipped"
    assert download.fetch(server.url(), target, again=True) == "downloaded"


def test_a_part_is_gone_on_with(serve, tmp_path):
    server, target = serve(), tmp_path / "a.gz"
    part = tmp_path / "a.gz.part"
    part.write_bytes(BODY[:100])
    assert download.fetch(server.url(), target) == "resumed" and server.asked == ["bytes=100-"] and target.read_bytes() == BODY
    target.unlink()
    part.write_bytes(BODY + b"too long")
    assert download.fetch(server.url(), target) == "resumed" and target.read_bytes() == BODY


def test_transfers_end_and_faults_are_told(serve, tmp_path):
    waits = []
    with pytest.raises(OSError):
        download.fetch(serve(breaks=99, ranges=False).url(), tmp_path / "b.gz", wait=waits.append)
    assert waits == [2, 4, 8, 16, 30] and not (tmp_path / "b.gz").exists() and (tmp_path / "b.gz.part").stat().st_size == len(BODY) // 2
    with pytest.raises(OSError):
        download.fetch(serve(body=b"not compressed").url(), tmp_path / "c.gz")
    assert not list(tmp_path.glob("c.gz*"))
    assert download.fetch(serve(body=b"").url(), tmp_path / "empty") == "downloaded" and (tmp_path / "empty").read_bytes() == b""
    with pytest.raises(ValueError):
        download.remote_bytes(serve(head=False, ranges=False).url())


def test_datasets_by_name(serve, tmp_path, monkeypatch):
    server = serve()
    said = download.fetch_datasets(server.url(""), tmp_path / "dumps", ["title_ratings", "title.crew"])
    assert said == {"title_ratings": "downloaded", "title_crew": "downloaded"} and (tmp_path / "dumps" / "title.crew.tsv.gz").read_bytes() == BODY
    assert set(download.fetch_datasets(server.url(""), tmp_path / "dumps", ["title_crew"]).values()) == {"skipped"}
    monkeypatch.setattr(download, "HEADROOM", 1e15)
    with pytest.raises(OSError):
        download.fetch_datasets(server.url(""), tmp_path / "dumps", ["title_basics"])


def test_chart_of_a_comparison(spark, tmp_path):
    rows = [("before", 1, 200.0), ("after", 1, 50.0), ("before", 2, 10.0), ("after", 2, 14.0), ("before", 3, 9.0), ("before", 4, 0.0), ("after", 4, 1.0)]
    timings = spark.createDataFrame([(p, s, ms, ms / 1000, 1) for p, s, ms in rows], measure.TIMINGS)
    assert chart.save_chart(measure.compared(timings), tmp_path / "out" / "chart.svg", {1: "a < b"}) == 2
    picture = ET.parse(tmp_path / "out" / "chart.svg").getroot()
    said = [t.text for t in picture.iter("{http://www.w3.org/2000/svg}text")]
    bars = list(picture.iter("{http://www.w3.org/2000/svg}rect"))
    assert {"a < b", "scenario 2", "+75%", "-40%"} <= set(said) and [b.get("fill") for b in bars] == [chart.FASTER, chart.SLOWER]
    ends = [(float(b.get("x")), float(b.get("x")) + float(b.get("width"))) for b in bars]
    assert abs(ends[0][0] - ends[1][1]) < 0.11 and ends[0][1] < chart.WIDTH and ends[1][0] > chart.LABELS
    ET.fromstring(chart.diverging_bars([], "none", ""))


def test_one_holder_at_a_time(spark, tmp_path):
    folder = str(tmp_path / "shared")
    with locks.alone(spark, folder, "setup"):
        assert locks.is_there(spark, f"{folder}/setup.lock")
        with pytest.raises(TimeoutError), locks.alone(spark, folder, "setup", patience=0.2):
            pass
        with locks.alone(spark, folder, "other"):
            pass
    assert not locks.is_there(spark, f"{folder}/setup.lock")
    with pytest.raises(KeyError), locks.alone(spark, folder, "setup"):
        raise KeyError
    inside, most = [], []

    def work():
        with locks.alone(spark, folder, "setup", step=0.01):
            inside.append(1)
            most.append(len(inside))
            inside.pop()

    threads = [threading.Thread(target=work) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert most == [1] * 6 and not locks.is_there(spark, "no_such_table")
    spark.range(1).createOrReplaceTempView("here")
    assert locks.is_there(spark, "here")
