"""Calls of services: a bounded pool, repeated attempts, availability, and what is done with their replies."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TypeVar
from urllib.parse import urlencode

from ..fixed import ATTEMPTS, CALLS_AT_ONCE, EXT_KIND, RETRY_SECONDS, RETRYABLE

A, B = TypeVar("A"), TypeVar("B")


class Refused(Exception):
    """A service's answer other than success."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


def pooled(call: Callable[[A], B], items: Iterable[A], at_once: int = CALLS_AT_ONCE) -> list[B]:
    """Results in the order of the items, of which ``at_once`` are in flight at most."""
    items = list(items)
    if len(items) < 2:
        return [call(x) for x in items]
    with ThreadPoolExecutor(min(at_once, len(items))) as pool:
        return list(pool.map(call, items))


def retried(call: Callable[[], B], wait: Callable[[float], None] = time.sleep) -> B:
    """The result of ``call``, which is tried ATTEMPTS times where it is :class:`Refused` for the moment (busy or down), each
    time after a longer wait. Other failures are the caller's at once."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return call()
        except Refused as e:
            if e.status not in RETRYABLE or attempt == ATTEMPTS:
                raise
            wait(attempt * RETRY_SECONDS)
    raise AssertionError


def available(provider: str | None, keys: dict[str, str | None]) -> bool:
    """Whether a provider is chosen, is one of those in ``keys``, and has its key."""
    return bool(keys.get((provider or "").lower()))


def without_fences(reply: str) -> str:
    """A model's reply without the code fence around it."""
    return re.sub(r"\s*```$", "", re.sub(r"^```(?:html|json)?\s*", "", reply.strip(), flags=re.I)).strip()


def reconstructed(text: str, designer: Callable[[str], str]) -> str:
    """Plain text as designed, sanitised HTML by a provider. A blank text or reply is an error."""
    from ..sources.html import sanitize_html

    if not text.strip():
        raise ValueError("no text")
    html = sanitize_html(without_fences(designer(text)))
    if not html.strip():
        raise ValueError("empty reply")
    return html


#: Sends (url, headers, body) and returns (status, text of the reply); tests and users bring their own.
Post = Callable[[str, dict[str, str], bytes], tuple[int, str]]


def http_post(url: str, headers: dict[str, str], body: bytes) -> tuple[int, str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, body, headers), timeout=120) as reply:
            return reply.status, reply.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


def _asked(post: Post, url: str, headers: dict[str, str], body: str) -> dict:
    status, reply = post(url, headers, body.encode())
    if not 200 <= status < 300:
        raise Refused(status, f"status {status}: {reply[:300]}")
    return json.loads(reply)


def json_array_provider(complete: Callable[[str, str], str]) -> Callable[[list[str], str], list[str]]:
    """A provider from a language model: ``complete`` gets a task and a JSON array and answers with an array of as many texts, in a
    code fence or not."""

    def provider(texts: list[str], target: str) -> list[str]:
        task = (
            f"Translate each string of the JSON array into the language {target!r}, formally. Answer with a JSON array of {len(texts)} strings "
            "in the same order and nothing else. Numbers, codes, dates and names stay as they are."
        )
        out = json.loads(without_fences(complete(task, json.dumps(texts, ensure_ascii=False))))
        if not isinstance(out, list) or len(out) != len(texts):
            raise ValueError("wrong number of texts")
        return [str(x) for x in out]

    return provider


def message_model(key: str, model: str, url: str, headers: dict[str, str], post: Post = http_post, most_tokens: int = 8000) -> Callable[[str, str], str]:
    """``complete`` for services that take a system text and messages, and answer with a list of content parts."""

    def complete(task: str, text: str) -> str:
        body = {"model": model, "max_tokens": most_tokens, "system": task, "messages": [{"role": "user", "content": text}]}
        reply = _asked(post, url, {"content-type": "application/json", "x-api-key": key, **headers}, json.dumps(body))
        return "".join(part.get("text", "") for part in reply.get("content", []))

    return complete


def form_provider(key: str, url: str, languages: dict[str, str], post: Post = http_post) -> Callable[[list[str], str], list[str]]:
    """For services that take a form with a ``text`` field for each text and answer {translations: [{text}]}."""

    def provider(texts: list[str], target: str) -> list[str]:
        fields = [("text", t) for t in texts] + [("target_lang", languages[target])]
        headers = {"Authorization": f"DeepL-Auth-Key {key}", "content-type": "application/x-www-form-urlencoded"}
        return [t["text"] for t in _asked(post, url, headers, urlencode(fields)).get("translations", [])]

    return provider


def query_provider(key: str, url: str, languages: dict[str, str], post: Post = http_post) -> Callable[[list[str], str], list[str]]:
    """For services that take {q: [...]} and answer {data: {translations: [{translatedText}]}} with entities in the texts."""
    marks = (("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))

    def provider(texts: list[str], target: str) -> list[str]:
        body = json.dumps({"q": texts, "target": languages[target], "format": "text"})
        found = _asked(post, f"{url}?{urlencode({'key': key})}", {"content-type": "application/json"}, body)
        return [reduce(lambda s, m: s.replace(*m), marks, str(t["translatedText"])) for t in found.get("data", {}).get("translations", [])]

    return provider


def first_that_answers(*calls: Callable[[], B]) -> Callable[[], B]:
    """The first of several ways to call a service (headers, addresses) that isn't refused for its authorisation; it is kept from
    then on."""
    ways = list(calls)

    def call() -> B:
        while len(ways) > 1:
            try:
                return ways[0]()
            except Refused as e:
                if e.status not in (401, 403, 404):
                    raise
                ways.pop(0)
        return ways[0]()

    return call


def configuration(provider: str | None, designer: str | None, version: str) -> dict:
    """What a client may know: the providers, the version and the formats in their order; no part of a key."""
    return {"provider": provider or "demo", "designer": designer, "version": version, "formats": list(EXT_KIND)}


def health(render: Callable[[str], bytes] | None) -> dict:
    """Whether a page can be printed, and in how many milliseconds."""
    began = time.monotonic()
    try:
        ok, error = (False, "no renderer") if render is None else (bool(render("<p>ok</p>")), None)
    except Exception as e:
        ok, error = False, str(e)
    return {"ok": ok, "ms": round((time.monotonic() - began) * 1000), "error": error}
