"""A classification service over HTTP, and the documents that are sent to it.

A call has two halves: a prompt (and the document, as a form) is posted and gives a task's name; the task is asked for until it has ended. Calls
of one task run one after the other; what is turned away for now (429, 502, 503) goes to the back of the queue with a time before which it isn't tried
again, so the others needn't wait for it.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable

from ..sources.shared import open_fs

#: Attempts, waits and limits of a call, in seconds.
ATTEMPTS, WAIT, MOST_WAIT, POLL, TIMEOUT, CONNECT, BUSY, OPEN, FAILURES = 3, 4.0, 10.0, 2.0, 120.0, 10, 30.0, 30.0, 5
#: Answers of a server that has no room now.
BUSY_CODES = (429, 502, 503)
File = tuple[str, bytes]


class Busy(Exception):
    """The server has no room now."""


def multipart(prompt: str, name: str, content: bytes) -> tuple[bytes, str]:
    """Body and type of a form with the prompt and the file."""
    edge = f"form-{hashlib.sha256(content + prompt.encode()).hexdigest()[:32]}"
    head = f'--{edge}\r\nContent-Disposition: form-data; name="prompt"\r\n\r\n{prompt}\r\n--{edge}\r\nContent-Disposition: form-data; name="file"; filename="{name.replace(chr(34), "")}"\r\nContent-Type: application/octet-stream\r\n\r\n'
    return head.encode() + content + f"\r\n--{edge}--\r\n".encode(), f"multipart/form-data; boundary={edge}"


def read_document(path: str, most: int) -> bytes:
    """A document of at most so many bytes, by any path that the executors can open. Raises OSError if it can't be read and ValueError if it is larger."""
    system, where = open_fs(path)
    with system.open_input_stream(where) as f:
        content = f.read(most + 1)
    if len(content) > most:
        raise ValueError(f"larger than {most} bytes")
    return content


#: Failures of each service, in this process.
_CIRCUITS: dict[str, dict] = {}


@dataclasses.dataclass(frozen=True)
class Service:
    """A service at a base address."""

    base: str
    token: str
    attempts: int = ATTEMPTS
    wait: float = WAIT
    poll: float = POLL
    timeout: float = TIMEOUT
    open_seconds: float = OPEN
    busy_seconds: float = BUSY

    def _ask(self, path: str, body: bytes | None = None, kind: str = "application/json") -> dict:
        request = urllib.request.Request(self.base + path, body, {"Authorization": f"Bearer {self.token}", "Content-Type": kind})
        try:
            with urllib.request.urlopen(request, timeout=CONNECT) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code in BUSY_CODES:
                raise Busy(str(e.code)) from e
            raise

    def submit(self, prompt: str, file: File | None = None) -> str:
        """Posts a prompt; the name of its task."""
        body, kind = (json.dumps({"prompt": prompt}).encode(), "application/json") if file is None else multipart(prompt, *file)
        return str(self._ask("/api/v2/process", body, kind)["task_id"])

    def result(self, task: str) -> str:
        """The text of a task when it has ended; empty if it failed or took too long."""
        end = time.monotonic() + self.timeout
        while time.monotonic() < end:
            got = self._ask(f"/api/v2/status/{task}")
            if got.get("status") in ("completed", "failed"):
                return str(got.get("result", "")) if got["status"] == "completed" else ""
            time.sleep(self.poll)
        return ""

    def healthy(self) -> bool:
        try:
            self._ask("/api/v2/health")
        except (Busy, OSError, ValueError):
            return False
        return True

    def queued(self, calls: list[Callable[[], str]]) -> list[str]:
        """The results of calls; empty for one that failed in all its attempts. FAILURES in a row open the circuit for a while."""
        state = _CIRCUITS.setdefault(self.base, {"failures": 0, "open_until": 0.0})
        out, queue = [""] * len(calls), deque((0.0, i, 1) for i in range(len(calls)))
        while queue:
            ready, i, attempt = queue.popleft()
            now = time.monotonic()
            if ready > now:
                queue.append((ready, i, attempt))
                soonest = min(queue)
                if soonest[0] > now:  # nothing can be tried yet
                    time.sleep(soonest[0] - now)
                    queue.remove(soonest)
                    queue.appendleft(soonest)
                continue
            if (left := state["open_until"] - now) > 0:
                time.sleep(left)
            try:
                out[i] = calls[i]()
                state["failures"] = 0
            except (Busy, OSError, KeyError, ValueError) as e:
                state["failures"] += 1
                if state["failures"] >= FAILURES:
                    state["open_until"], state["failures"] = time.monotonic() + self.open_seconds, 0
                if attempt < self.attempts:
                    pause = self.busy_seconds if isinstance(e, Busy) else min(MOST_WAIT, self.wait * 2 ** (attempt - 1))
                    queue.append((time.monotonic() + pause, i, attempt + 1))
        return out

    def __call__(self, prompts: list[str], files: list[File | None] | None = None) -> list[str]:
        """Classifies prompts, each with its document if there is one."""
        task_of: dict[int, str] = {}

        def call(i: int) -> str:
            if i not in task_of:  # a document that has been taken isn't sent again
                task_of[i] = self.submit(prompts[i], files[i] if files else None)
            return self.result(task_of[i])

        return self.queued([lambda i=i: call(i) for i in range(len(prompts))])
