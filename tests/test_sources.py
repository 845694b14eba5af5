"""Scans that read only what changed: manifests with a hash cache, conditional requests and remote listings."""

import hashlib
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from usagelake.sources import files, poll


def test_manifests_read_only_what_changed_or_is_old(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a").mkdir(parents=True)
    for name, text in (("a/x", "one"), ("a/y", "two"), ("z", "six")):
        (root / name).write_text(text)
    by_name = lambda df: {r.path.rsplit("/", 1)[1]: (r.sha256, r.verified_at) for r in df.collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    first = keep(files.cached_manifest(spark, str(root), None, 1000.0))
    assert by_name(first) == {"x": (digest("one"), 1000.0), "y": (digest("two"), 1000.0), "z": (digest("six"), 1000.0)}
    old = (root / "z").stat()
    (root / "z").write_text("ten")  # of the size and time before: its bytes are not looked at until an hour has gone
    os.utime(root / "z", ns=(old.st_atime_ns, old.st_mtime_ns))
    (root / "a/x").write_text("three")
    (root / "a/y").unlink()
    (root / "new").write_text("n")
    second = keep(files.cached_manifest(spark, str(root), first, 2000.0))
    assert by_name(second) == {"x": (digest("three"), 2000.0), "z": (digest("six"), 1000.0), "new": (digest("n"), 2000.0)}
    assert by_name(files.cached_manifest(spark, str(root), second, 4600.0))["z"] == (digest("ten"), 4600.0)
    assert by_name(files.cached_manifest(spark, str(root), second, 4599.0)) == by_name(second)
    with pytest.raises(ValueError):
        files.cached_manifest(spark, str(root), None, 0.0, max_files=2)


def test_conditional_reads_and_remote_listings(spark):
    bodies, sent = {"/d/a": b"A1", "/d/b": b"B1", "/d/weak": b"W"}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = bodies.get(self.path)
            tag = None if body is None else ("W/" if self.path == "/d/weak" else "") + f'"{hashlib.md5(body).hexdigest()}"'
            self.send_response(404 if body is None else 304 if self.headers.get("If-None-Match") == tag else 200)
            if tag:
                self.send_header("ETag", tag)
            self.end_headers()
            if body is not None and self.headers.get("If-None-Match") != tag:
                sent.append(self.path)
                self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        ask = lambda rows: {r.url.removeprefix(url): r for r in poll.read_if_changed(spark.createDataFrame(rows, "url string, marker string")).collect()}
        got = ask([(url + p, None) for p in (*bodies, "/d/none")])
        assert (bytes(got["/d/a"].body), got["/d/a"].changed, got["/d/weak"].error, got["/d/none"].error) == (b"A1", True, "no strong entity tag", "HTTP 404")
        bodies["/d/b"] = b"B2"
        sent.clear()
        got = ask([(url + p, got[p].marker) for p in ("/d/a", "/d/b")])
        assert (got["/d/a"].changed, got["/d/a"].body, bytes(got["/d/b"].body)) == (False, None, b"B2") and sent == ["/d/b"]
    finally:
        server.shutdown()
    entry = lambda path, tag: f"<D:response><D:href>{path}</D:href><D:propstat><D:prop><D:getetag>{tag}</D:getetag></D:prop></D:propstat></D:response>"
    xml = '<D:multistatus xmlns:D="DAV:">' + entry("/d/", "") + entry("http://h/d/b%20c/", '"2"') + entry("/d/a", "W/1") + entry("/e/x", '"3"') + "</D:multistatus>"
    listed = poll.remote_listing(spark.createDataFrame([("http://h/d", xml)], "url string, body string"))
    assert [tuple(r) for r in listed.collect()] == [("http://h/d", "a", None), ("http://h/d", "b c", '"2"')]
