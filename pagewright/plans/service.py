"""HTTP search service over one session: ``/`` and ``/search`` (a page to search from), ``/health`` and ``/api/search``."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import BoundedSemaphore
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from pagewright.plans.search import MODES, Index, search

LONGEST, MOST, DEFAULT = 512, 50, 10


def parameters(query: str) -> tuple[str, int, str]:
    """Query text, limit (1 to 50) and mode of a query string; ValueError says what is wrong."""
    given = parse_qs(query)
    text = given.get("q", [""])[0].strip()
    if not text:
        raise ValueError("missing query parameter q")
    if len(text) > LONGEST:
        raise ValueError(f"query is longer than {LONGEST} characters")
    limit = min(MOST, max(1, int(given.get("limit", [str(DEFAULT)])[0])))
    mode = given.get("mode", ["auto"])[0]
    if mode not in MODES:
        raise ValueError("mode must be 'all', 'any' or 'auto'")
    return text, limit, mode


#: The page at ``/``: a form, and a list that a few lines of script fill from the API.
PAGE = """<!DOCTYPE html>
<html lang="en"><meta charset="utf-8"><title>Search</title>
<h1>Search</h1>
<form><input name="q" maxlength="512" autofocus> <select name="mode"><option>auto<option>all<option>any</select> <button>Search</button></form>
<p id="state"></p><ol id="found"></ol>
<script>
const form = document.querySelector("form"), asked = new URLSearchParams(location.search);
async function run(q, mode) {
  const reply = await (await fetch("/api/search?" + new URLSearchParams({q, mode}))).json();
  document.getElementById("state").textContent = reply.error || reply.count + " results in " + reply.elapsed_ms + " ms";
  document.getElementById("found").replaceChildren(...(reply.results || []).map(r => {
    const item = document.createElement("li"), link = document.createElement("a"), text = document.createElement("p");
    if (/^https?:/.test(r.url)) link.href = r.url;
    link.textContent = r.title; text.textContent = r.snippet;
    item.append(link, " " + r.display_url, text);
    return item;
  }));
}
if (asked.get("q")) { form.q.value = asked.get("q"); form.mode.value = asked.get("mode") || "auto"; run(form.q.value, form.mode.value); }
</script></html>
"""


def create_server(spark: SparkSession, index: Index, host: str = "127.0.0.1", port: int = 8080, workers: int = 8, verbose: bool = False) -> ThreadingHTTPServer:
    """A server of one thread a request; all share the session and the index, ``workers`` searches run at a time."""
    free = BoundedSemaphore(workers)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict | str) -> None:
            kind = "text/html" if isinstance(body, str) else "application/json"
            raw = (body if isinstance(body, str) else json.dumps(body, ensure_ascii=False)).encode()
            self.send_response(status)
            for name, value in (
                ("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(len(raw))), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff"), ("Referrer-Policy", "strict-origin-when-cross-origin"),
            ):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            parts = urlsplit(self.path)
            if parts.path in ("/", "/search"):
                return self._send(200, PAGE)
            if parts.path == "/health":
                return self._send(200, {"status": "ok", "documents": index.n_documents})
            if parts.path != "/api/search":
                return self._send(404, {"error": "not found"})
            try:
                text, limit, mode = parameters(parts.query)
            except (TypeError, ValueError) as e:
                return self._send(400, {"error": str(e)})
            began = time.perf_counter()
            with free:
                results = [r.asDict() for r in search(spark, index, text, limit, mode).collect()]
            elapsed = round((time.perf_counter() - began) * 1000, 2)
            return self._send(200, {"query": text, "mode": mode, "count": len(results), "elapsed_ms": elapsed, "results": results})

        def log_message(self, *about: object) -> None:
            if verbose:
                super().log_message(*about)

    return ThreadingHTTPServer((host, port), Handler)
