"""HTTP transport for an endpoint that takes ``{"prompt": …}`` and returns ``{"completion": …}``."""

from __future__ import annotations

import http.client
import json
import socket
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

from promptscore.functions.outcomes import BODY_READ_LIMIT
from promptscore.operators.scoring import Response, Transport
from promptscore.options import Options

_CHUNK = 1 << 16


def http_transport(
    url: str, options: Options, connect: Callable | None = None, calls_in_flight: int = 1
) -> Callable[[], Transport]:
    """Factory for ``score``: one POST per prompt, each done within the request timeout as a whole.

    A task keeps ``calls_in_flight`` connections, each used again while the endpoint keeps it open.
    Whatever goes wrong with a prompt is that prompt's answer and no other's. One byte more than the
    read limit is kept, which is enough for a larger body to be recognised. ``connect`` makes a
    connection like ``http.client``'s from a timeout in seconds.
    """
    parts = urlsplit(url)
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    timeout = options.request_timeout_ms / 1000
    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection

    def make() -> Transport:
        opened = threading.local()
        open_ = connect or (lambda seconds: kind(parts.hostname, parts.port, timeout=seconds))

        def post(prompt: str) -> Response:
            reused = getattr(opened, "connection", None) is not None
            answer, fresh_failure = _post(prompt)
            if fresh_failure and reused:  # the endpoint closed an idle connection before it read the request
                answer, _ = _post(prompt)
            return answer

        def _post(prompt: str) -> tuple[Response, bool]:
            late = time.monotonic() + timeout
            if getattr(opened, "connection", None) is None:
                opened.connection = open_(timeout)
            connection, sent = opened.connection, False
            watch = threading.Timer(timeout, _cut, [connection])
            watch.daemon = True
            watch.start()
            try:
                body = json.dumps({"prompt": prompt}).encode()
                connection.request("POST", target, body, {"Content-Type": "application/json"})
                reply = connection.getresponse()
                sent = True
                text, whole = _read(reply, late)
                if not whole:
                    _drop(opened)
                return Response(reply.status, text, reply.headers.get("Retry-After")), False
            except Exception as error:
                _drop(opened)
                gone = isinstance(error, (http.client.RemoteDisconnected, ConnectionError, BrokenPipeError))
                if time.monotonic() >= late:
                    return Response(error="timed out"), False
                return Response(error=str(error) or type(error).__name__), gone and not sent
            finally:
                watch.cancel()

        if calls_in_flight == 1:
            return lambda prompts: [post(p) for p in prompts]
        pool = ThreadPoolExecutor(calls_in_flight)
        return lambda prompts: list(pool.map(post, prompts))

    return make


def _read(reply, late: float) -> tuple[str, bool]:
    """Body up to the limit, and whether it was read to its end. An error while reading leaves what came."""
    body = b""
    try:
        while len(body) <= BODY_READ_LIMIT:
            chunk = reply.read1(min(_CHUNK, BODY_READ_LIMIT + 1 - len(body)))
            if not chunk:
                return body.decode("utf-8", "replace"), True
            body += chunk
            if time.monotonic() >= late:
                raise TimeoutError("timed out")
    except TimeoutError:
        raise
    except Exception:
        if time.monotonic() >= late:
            raise TimeoutError("timed out") from None
        return body.decode("utf-8", "replace"), False
    return body.decode("utf-8", "replace"), False


def _cut(connection) -> None:
    """End a call that takes too long, wherever it waits."""
    own = getattr(connection, "sock", None)
    if own is not None:
        try:
            own.shutdown(socket.SHUT_RDWR)
        except OSError:
            pass


def _drop(opened) -> None:
    connection, opened.connection = getattr(opened, "connection", None), None
    if connection is not None:
        connection.close()
