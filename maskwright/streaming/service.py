"""HTTP front end of a job store: /jobs and /jobs/ID with JSON bodies, on the standard library's server."""

from __future__ import annotations

import json
from collections.abc import Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from maskwright.streaming.jobs import BadRequest, JobStore, UnknownJob


def handler(store: JobStore, available: Sequence[str]) -> type[BaseHTTPRequestHandler]:
    """GET and POST on /jobs; GET, PUT and DELETE on /jobs/ID.

    ``available``: the columns that a job may ask for.
    """

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def _answer(self, status: int, body: object = None) -> None:
            data = b"" if body is None else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _body(self) -> dict:
            try:
                found = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError as e:
                raise BadRequest("the body isn't JSON") from e
            if not isinstance(found, dict):
                raise BadRequest("the body isn't an object")
            return found

        def _job_id(self) -> str | None:
            """None for the list; anything else that isn't a job's place is unknown."""
            parts = self.path.split("?")[0].strip("/").split("/")
            if parts == ["jobs"]:
                return None
            if len(parts) == 2 and parts[0] == "jobs" and parts[1].isalnum():
                return parts[1]
            raise UnknownJob(self.path)

        def _run(self, act) -> None:
            try:
                self._answer(*act())
            except UnknownJob as e:
                self._answer(404, {"error": f"no such job: {e.args[0]}"})
            except BadRequest as e:
                self._answer(400, {"error": str(e)})

        def do_GET(self) -> None:
            def act():
                job_id = self._job_id()
                return 200, store.get(job_id).asDict() if job_id else [r.asDict() for r in store.all().orderBy("job_id").collect()]

            self._run(act)

        def do_POST(self) -> None:
            def act():
                if self._job_id() is not None:
                    raise UnknownJob(self.path)
                body = self._body()
                return 201, store.submit(body.get("columns"), body.get("partner_id"), body.get("table_name"), available)

            self._run(act)

        def do_PUT(self) -> None:
            def act():
                job_id, body = self._job_id(), self._body()
                if not job_id:
                    raise UnknownJob(self.path)
                if not body.get("columns"):
                    raise BadRequest("columns are missing")
                return 201, store.update(job_id, body["columns"])

            self._run(act)

        def do_DELETE(self) -> None:
            def act():
                store.delete(self._job_id() or "")
                return 204, None

            self._run(act)

    return Handler


def serve(store: JobStore, available: Sequence[str], host: str = "127.0.0.1", port: int = 5000) -> ThreadingHTTPServer:
    """A server; call ``serve_forever`` on it."""
    return ThreadingHTTPServer((host, port), handler(store, available))
