"""Push ingest over HTTP, and a target that posts.

The receiver answers 200 only after a record is a file in the landing folder (written
under a temporary name, then renamed), so what it has acknowledged isn't lost; the
file stream picks up whole files only.
"""

from __future__ import annotations

import http.server
import json
import os
import tempfile
import threading
import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions.uri import ParsedUri
from quillflow.model import META
from quillflow.sources.registry import Registry, Stream

PORT, PATH = 8080, "/ingest"


class HttpReceiver:
    """Listens on 127.0.0.1: POST to the path lands a record, GET /health says ok, GET /events streams what lands."""

    def __init__(self, folder: str, port: int = PORT, path: str = PATH):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.path, self.count = folder, path, 0
        self.landed = threading.Condition()
        self.recent: list[tuple[int, str]] = []
        receiver = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def answer(self, code: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_POST(self) -> None:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.path.split("?")[0] != receiver.path:
                    return self.answer(404, {"error": "not found"})
                try:
                    body = json.loads(raw)
                except ValueError:
                    return self.answer(400, {"error": "invalid JSON"})
                receiver.land(body)
                self.answer(200, {"ok": True})

            def do_GET(self) -> None:
                if self.path == "/health":
                    return self.answer(200, {"status": "ok"})
                if self.path != "/events":
                    return self.answer(404, {"error": "not found"})
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                seen = 0
                try:
                    while not receiver.closed:
                        with receiver.landed:
                            receiver.landed.wait_for(lambda seen=seen: receiver.count > seen or receiver.closed, 1)
                            new = [(n, line) for n, line in receiver.recent if n > seen]
                        for seen, line in new:  # noqa: B007
                            self.wfile.write(f"data: {line}\n\n".encode())
                        self.wfile.flush()
                except OSError:
                    pass

            def log_message(self, *args: object) -> None:
                pass

        self.closed = False
        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]
        self.thread = threading.Thread(target=self.server.serve_forever, daemon=True)
        self.thread.start()

    def land(self, body: object) -> None:
        with self.landed:
            self.count += 1
            line = json.dumps({"seq": time.time_ns(), "item": json.dumps(body)})
            temp = os.path.join(self.folder, f".{uuid.uuid4().hex}.tmp")
            with open(temp, "w") as f:
                f.write(line + "\n")
                f.flush()
                os.fsync(f.fileno())
            os.rename(temp, os.path.join(self.folder, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"))
            self.recent = [*self.recent[-999:], (self.count, line)]
            self.landed.notify_all()

    def close(self) -> None:
        self.closed = True
        self.server.shutdown()
        self.server.server_close()

    def __enter__(self) -> HttpReceiver:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()


@dataclass
class HttpSource:
    """``http://host/path?port=&folder=``: a receiver and the stream of what it lands.

    The folder must be one that the executors see; without one a temporary folder is
    used where the master is local, and reading is an error elsewhere.
    """

    path: str = PATH
    port: int = PORT
    folder: str | None = None
    lifecycle: str = "long-lived"
    own: str | None = field(default=None, init=False)

    def _landing(self) -> str:
        if not self.folder and not self.own:
            self.own = tempfile.mkdtemp(prefix="landing-")
        return self.folder or self.own

    def open(self) -> HttpReceiver:
        return HttpReceiver(self._landing(), self.port, self.path)

    def read(self, spark: SparkSession) -> Stream:
        from quillflow.streaming.micro import landed_stream

        master = spark.sparkContext.master
        if not self.folder and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("name a folder that the driver and all executors share: http://host/path?folder=")
        return Stream(landed_stream(spark, self._landing()))


@dataclass
class HttpTarget:
    """Posts each envelope as JSON from the executors; a failed post fails its task, so posts may repeat."""

    url: str
    timeout_s: float = 30

    def write(self, df: DataFrame) -> None:
        url, timeout = self.url, self.timeout_s

        def post(batches) -> Iterator:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    request = urllib.request.Request(url, line.encode(), {"Content-Type": "application/json"})
                    urllib.request.urlopen(request, timeout=timeout).read()
                yield batch.slice(0, 0)

        df.select(F.to_json(F.struct(*df.columns)).alias("line")).mapInArrow(post, "line string").write.format("noop").mode("overwrite").save()


def register_http(registry: Registry) -> None:
    registry.register_source("http", lambda u: HttpSource(u.path or PATH, int(u.query.get("port", PORT)), *([u.query["folder"]] if "folder" in u.query else [])))
    for scheme in ("http", "https"):
        registry.register_target(scheme, lambda u: HttpTarget(u.raw))


def with_meta(df: DataFrame) -> DataFrame:
    return df.withColumn("meta", F.lit(None).cast(META))
