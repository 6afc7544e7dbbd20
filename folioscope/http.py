"""The HTTP interface (K14) as a WSGI application: /health, /search, /ask, /ask-agent."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from . import api
from .conf import EngineConf
from .operators import evidence, retrieve


class BadRequest(ValueError):
    """What the caller can mend."""


def body_of(environ: dict) -> dict:
    try:
        size = int(environ.get("CONTENT_LENGTH") or 0)
        given = json.loads(environ["wsgi.input"].read(size) or b"{}")
    except ValueError as e:
        raise BadRequest(f"the body is no JSON: {e}") from e
    if not isinstance(given, dict) or not isinstance(given.get("q", given.get("query", "")), str) or not str(given.get("q", given.get("query", ""))).strip():
        raise BadRequest("q must be a text that is not blank")
    k = given.get("k")
    if k is not None and (not isinstance(k, int) or isinstance(k, bool) or k < 1):
        raise BadRequest("k must be a whole number of at least 1")
    return {"query": given.get("q", given.get("query")), "k": k}


def application(spark: SparkSession, corpus: retrieve.Corpus, conf: EngineConf, folder: str, generate: Callable[[str, str], str] = evidence.stub_answer) -> Callable:
    """The application over a corpus; ``folder`` holds the artefacts that /health looks for.  Bad requests are 400 (422 for values), other paths 404, failures 500."""
    routes = {
        ("GET", "/health"): lambda _: api.health(folder, conf),
        ("POST", "/search"): lambda given: api.search(spark, given["query"], corpus, given["k"], conf),
        ("POST", "/ask"): lambda given: api.ask(spark, given["query"], corpus, generate, given["k"], conf),
        ("POST", "/ask-agent"): lambda given: api.ask_agent(api.one(spark, given["query"], given["k"]), corpus, conf, generate).head().asDict(recursive=True),
    }

    def run(environ: dict, start_response: Callable) -> Iterable[bytes]:
        method, path = environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO", "/")
        try:
            if (method, path) not in routes:
                known = path in {p for _, p in routes}
                status, out = ("405 Method Not Allowed" if known else "404 Not Found"), {"detail": f"no {method} {path}"}
            else:
                status, out = "200 OK", routes[method, path](body_of(environ) if method == "POST" else {})
        except BadRequest as e:
            status, out = "422 Unprocessable Entity", {"detail": str(e)}
        except ValueError as e:
            status, out = "400 Bad Request", {"detail": str(e)}
        except Exception as e:  # noqa: BLE001 - the server goes on
            status, out = "500 Internal Server Error", {"detail": type(e).__name__}
        content = json.dumps(out, ensure_ascii=False, default=str).encode()
        start_response(status, [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(content)))])
        return [content]

    return run
