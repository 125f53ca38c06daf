"""Requests as a server would take them: plain dictionaries in, plain dictionaries out.

A transport (a socket, HTTP, Spark Connect's own channel) only has to carry JSON; each of its
connections holds one session, and with it one transaction at most.
"""

from __future__ import annotations

import hmac
import json
import threading
from typing import Any

from tabulon import errors
from tabulon.errors import BusyError, SqlError
from tabulon.session import Engine, Result


class Service:
    def __init__(self, engine: Engine, auth_key: str = ""):
        self.engine, self.auth_key = engine, auth_key
        self.open = 0
        self.lock = threading.Lock()

    def connection(self) -> Connection:
        """A new connection; one too many is turned away at once."""
        most = self.engine.limits.max_connections
        with self.lock:
            if most and self.open >= most:
                raise BusyError("server busy: too many connections")
            self.open += 1
        return Connection(self)


class Connection:
    def __init__(self, service: Service):
        self.service = service
        self.session = service.engine.session()
        self.closed = False

    def close(self) -> None:
        """Gives the place free; a transaction that is open is dropped."""
        with self.service.lock:
            self.service.open -= not self.closed
            self.closed = True
        self.session = self.service.engine.session()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def handle(self, request: dict[str, Any]) -> Any:
        """Answers {sql, params} or {sqls, atomic}, with auth where a key is set; ping needs none.

        A batch gives a list with a result or an error for each statement, an atomic one that fails a
        single error.
        """
        if request.get("ping"):
            return {"status": "ok"}
        key = self.service.auth_key
        given = request.get("auth") or request.get("auth_key") or ""
        if key and not hmac.compare_digest(str(given).encode(), key.encode()):
            return {"error": "unauthorized: invalid or missing auth key", "code": errors.AUTH_FAILED if given else errors.AUTH_REQUIRED}
        try:
            many, params = request.get("sqls"), request.get("params")
            if many:
                if params:
                    raise SqlError("params are only supported on single sql requests", errors.INVALID_REQUEST)
                return [self._answer(r) for r in self.session.batch(many, bool(request.get("atomic")))]
            return self._answer(self.session.execute(request.get("sql", ""), params))
        except SqlError as e:
            return {"error": str(e), "code": e.code}

    def _answer(self, result: Result | SqlError) -> dict[str, Any]:
        try:
            if isinstance(result, SqlError):
                raise result
            return result.as_json()
        except SqlError as e:
            return {"error": str(e), "code": e.code}

    def handle_text(self, raw: bytes) -> bytes:
        """handle() over JSON; a response beyond the byte limit is replaced by an error."""
        try:
            request = json.loads(raw)
            if not isinstance(request, dict):
                raise ValueError("a request is an object")
        except ValueError as e:
            return json.dumps({"error": f"invalid request: {e}", "code": errors.INVALID_REQUEST}).encode()
        out = json.dumps(self.handle(request), ensure_ascii=False).encode()
        most = self.service.engine.limits.max_bytes
        if most and len(out) > most:
            return json.dumps({"error": f"result of {len(out)} bytes exceeds {most}", "code": errors.RESULT_TOO_LARGE}).encode()
        return out
