"""The edge of the engine: requests in, responses out.

A request is (method, path, body); a response is (status, object). The store is read once when the service
starts. Every failure of an answer is reported as status 500 with its text, a request that cannot be
understood as 422, an unknown address as 404.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np

from tessellore.operators import answering, scoring, store
from tessellore.sources.tables import Settings

# Fixed values of the interface.
ASK, HEALTH, CONFIG = ("POST", "/api/query"), ("GET", "/api/health"), ("GET", "/api/config")


@dataclass
class Service:
    """A store, a language model, and the encoder of plain questions."""

    index: store.Store | None
    model: Callable[[str], str]
    encode: Callable[[list[str]], np.ndarray] | None = None
    settings: Settings = Settings()

    def ask(self, question: str) -> answering.Answer:
        hits = store.retrieve(self.index, question, self.settings.retrieval_k, self.encode)
        endpoints = store.gated(self.index, question) if self.index.entries is not None else None
        return answering.answer(question, hits, endpoints, self.model)

    def handle(self, method: str, path: str, body: str = "") -> tuple[int, dict]:
        """The response to a request."""
        match method.upper(), path.rstrip("/"):
            case place if place == ASK:
                try:
                    question = json.loads(body)["query"]
                except (ValueError, KeyError, TypeError):
                    question = None
                if not isinstance(question, str) or not question:
                    return 422, {"detail": "query must be a text of at least one character"}
                try:
                    return 200, asdict(self.ask(question))
                except Exception as failure:  # the edge reports whatever went wrong behind it
                    return 500, {"detail": f"Error processing query: {failure}"}
            case place if place == HEALTH:
                return 200, {"status": "degraded" if self.index is None else "healthy", "rag_system_loaded": self.index is not None}
            case place if place == CONFIG:
                return 200, {"store": self.settings.store, "retrieval_k": self.settings.retrieval_k, "rrf_k": scoring.RRF_K}
        return 404, {"detail": "Not Found"}


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000):
    """An HTTP server for a service; the caller runs ``serve_forever``."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def _respond(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, found = service.handle(self.command, self.path, self.rfile.read(size).decode("utf-8", "replace"))
            out = json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _respond  # noqa: N815

        def log_message(self, *_: object) -> None:
            """Requests are not logged."""

    return ThreadingHTTPServer((host, port), Handler)
