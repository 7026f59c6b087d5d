"""Language models behind HTTP: a generate call, a chat call that asks again, and what a call cost.

A model here is what timeline() takes: a function from a context to a reply. It runs in the workers, once a context.
"""

from __future__ import annotations

import json
import resource
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: Options of a call, and the words that ask a model to answer without thinking.
OPTIONS = {"temperature": 0.1, "num_ctx": 4096, "num_predict": 1536}
NO_THINK = "/no_think\n"


class EmptyReply(RuntimeError):
    """A model that said nothing, or was cut off."""


@dataclass(frozen=True)
class Cost:
    """Seconds of a call, tokens written and their number a second (None if the model does not tell), peak MB of this process."""

    seconds: float
    tokens: int | None
    tokens_per_second: float | None
    peak_mb: float


def post(url: str, payload: dict, timeout: float = 900) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def generated(model: str, prompt: str, url: str, send: Callable[[str, dict], dict] = post) -> str:
    """The reply of a generate call; EmptyReply if it is empty or not done."""
    told = send(url, {"model": model, "prompt": prompt, "stream": False, "options": OPTIONS})
    text = (told.get("response") or "").strip()
    if not text or told.get("done") is False:
        raise EmptyReply(f"{model} gave no whole reply")
    return text


def chatted(model: str, system: str, prompt: str, url: str, send: Callable[[str, dict], dict] = post) -> tuple[str, dict]:
    """(reply, what came with it) of a chat call. An empty reply is asked for once more, without thinking; then EmptyReply."""
    for start in ("", NO_THINK):
        messages = [{"role": "system", "content": system}, {"role": "user", "content": start + prompt}]
        told = send(url, {"model": model, "messages": messages, "stream": False, "think": False, "options": OPTIONS})
        if "error" in told:
            raise RuntimeError(told["error"])
        text = ((told.get("message") or {}).get("content") or "").strip()
        if text:
            return text, told
    raise EmptyReply(f"{model} said nothing: {told.get('done_reason')}")


def measured(call: Callable[[], tuple[str, dict]]) -> tuple[str, Cost]:
    """A reply and what it cost."""
    began = time.perf_counter()
    text, told = call()
    seconds = time.perf_counter() - began
    tokens, spent = told.get("eval_count"), (told.get("eval_duration") or 0) / 1e9
    speed = tokens / (spent or seconds) if tokens and (spent or seconds) else None
    return text, Cost(seconds, tokens, speed, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
