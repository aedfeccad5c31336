"""Per-key step functions shared by the batch folds and the streaming processors.

A machine has ``inputs`` (column names it reads after ``ts_ms``), ``outputs`` (its
result columns), ``start()`` giving a JSON-able state, and ``step(state, ts_ms, *inputs)``
that updates the state in place and returns the output values.  A machine whose state means
nothing some time after its last row says so in ``memory_ms``.  One that acts by itself has
``deadline(state)``, the last millisecond before it does, and ``expire(state)``, its output.
"""

from __future__ import annotations

from codelake.operators.runs import SESSION_TRANSITIONS


class RunState:
    """Run status: terminal states absorb, unknown statuses are ignored."""

    inputs = ["status"]
    outputs = "status string, applied boolean"
    known = {"PENDING", "ANALYZING", "MIGRATING", "DONE", "FAILED", "CANCELLED"}
    terminal = {"DONE", "FAILED", "CANCELLED"}

    def start(self):
        return {"status": None}

    def step(self, s, ts_ms, status):
        applied = s["status"] not in self.terminal and status in self.known
        if applied:
            s["status"] = status
        return s["status"], applied


class SessionState:
    """Session status with allowed transitions only; a pause remembers where it came from.

    ``agent_failure`` counts consecutive failures: at the threshold the session pauses,
    below it fails.  ``agent_ok`` resets the count; a resume does not.
    """

    inputs = ["action"]
    outputs = "accepted boolean, status string, paused_from string, errors int"
    # Fixed action names and the status each leads to.
    targets = {
        "begin": "CONTEXT_ANALYSED", "plan": "PLAN_READY", "request": "AWAITING_APPROVAL", "migrate": "MIGRATING",
        "validate": "VALIDATING", "complete": "DONE", "fail": "FAILED", "pause": "PAUSED",
    }

    def __init__(self, threshold: int = 3):
        self.threshold = threshold

    def start(self):
        return {"status": "PENDING", "from": None, "errors": 0}

    def _move(self, s, target):
        if target not in SESSION_TRANSITIONS[s["status"]]:
            return False
        if target == "PAUSED":
            s["from"] = s["status"]
        s["status"] = target
        return True

    #: What a failure leads to, as actions of their own: whoever counts failures otherwise has finitely many states.
    failures = {"failure_pauses": "PAUSED", "failure_fails": "FAILED"}

    def step(self, s, ts_ms, action):
        if action == "resume":
            ok = s["status"] == "PAUSED" and s["from"] is not None
            if ok:
                s["status"], s["from"] = s["from"], None
        elif action in self.failures:
            ok = self._move(s, self.failures[action])
        elif action == "agent_failure":
            s["errors"] += 1
            ok = self._move(s, "PAUSED" if s["errors"] >= self.threshold else "FAILED")
        elif action == "agent_ok":
            s["errors"], ok = 0, True
        else:
            ok = action in self.targets and self._move(s, self.targets[action])
        return ok, s["status"], s["from"], s["errors"]


class AutoPause:
    """Failure streak that only a success resets; at the threshold the run pauses."""

    inputs = ["outcome"]
    outputs = "streak bigint, verdict string"

    def __init__(self, threshold: int = 3):
        self.threshold = threshold

    def start(self):
        return {"n": 0}

    def step(self, s, ts_ms, outcome):
        if outcome == "success":
            s["n"] = 0
        if outcome != "failure":
            return None
        s["n"] += 1
        return s["n"], "PAUSED" if s["n"] >= self.threshold else "FAILED"


class RateLimit:
    """Sliding-window log: only accepted requests are recorded, equal milliseconds collapse."""

    inputs: list[str] = []
    outputs = "accepted boolean"

    def __init__(self, limit: int, window_ms: int):
        self.limit = limit
        self.window_ms = self.memory_ms = window_ms

    def start(self):
        return {"log": []}

    def step(self, s, ts_ms):
        s["log"] = [t for t in s["log"] if t > ts_ms - self.window_ms]
        if len(s["log"]) >= self.limit:
            return (False,)
        if ts_ms not in s["log"]:
            s["log"].append(ts_ms)
        return (True,)


class Lockout:
    """Failure lockout with doubling lock times; all times are milliseconds."""

    inputs = ["success"]
    outputs = "blocked boolean, failures int, lock_seconds bigint"
    # Fixed limits, seconds.
    window, day, base, longest = 300, 86_400, 60, 3_600
    memory_ms = day * 1000

    def __init__(self, max_attempts: int = 5):
        self.max_attempts = max_attempts

    def start(self):
        return {"fails": 0, "fails_end": 0, "lock_end": 0, "locks": 0, "locks_end": 0}

    def step(self, s, ts_ms, success):
        blocked = ts_ms < s["lock_end"]
        if success:
            s["fails"], s["lock_end"] = 0, 0
            return blocked, 0, None
        s["fails"] = (s["fails"] if ts_ms < s["fails_end"] else 0) + 1
        s["fails_end"] = ts_ms + self.window * 1000
        if s["fails"] < self.max_attempts:
            return blocked, s["fails"], None
        locks = s["locks"] if ts_ms < s["locks_end"] else 0
        seconds = min(self.base * 2 ** min(locks, 5), self.longest)
        s["lock_end"] = ts_ms + seconds * 1000
        s["locks"], s["locks_end"] = locks + 1, ts_ms + self.day * 1000
        return blocked, s["fails"], seconds


class TokenReplay:
    """Refresh tokens of one user: using a revoked token revokes the whole family."""

    inputs = ["kind", "token", "new_token", "ttl_ms"]
    outputs = "result string"

    def __init__(self, forget_ms: int | None = None):
        """``forget_ms`` after a token's expiry it is unknown, so a user's map stays bounded; by default none is forgotten."""
        self.forget_ms = forget_ms

    def start(self):
        return {"tokens": {}}

    def step(self, s, ts_ms, kind, token, new_token, ttl_ms):
        if self.forget_ms is not None:
            s["tokens"] = {k: t for k, t in s["tokens"].items() if ts_ms < t[1] + self.forget_ms}
        tokens = s["tokens"]
        if kind == "issue":
            tokens[token] = [False, ts_ms + ttl_ms]
            return ("issued",)
        if kind == "logout":
            for t in tokens.values():
                t[0] = True
            return ("revoked",)
        known = tokens.get(token)
        if known is None:
            return ("unknown",)
        if known[0]:
            for t in tokens.values():
                t[0] = True
            return ("replay",)
        if ts_ms >= known[1]:
            return ("expired",)
        known[0] = True
        tokens[new_token] = [False, ts_ms + ttl_ms]
        return ("rotated",)


class ApprovalTimeout:
    """A run that waits longer than the limit fails; a wait starts anew with each waiting row."""

    inputs = ["status"]
    outputs = "waiting_ms bigint, status string, decided_by string"

    def __init__(self, timeout_ms: int, waiting: str):
        self.timeout_ms, self.waiting = timeout_ms, waiting

    def start(self):
        return {"since": None}

    def step(self, s, ts_ms, status):
        s["since"] = ts_ms if status == self.waiting else None

    def deadline(self, s):
        return None if s["since"] is None else s["since"] + self.timeout_ms

    def expire(self, s):
        since, s["since"] = s["since"], None
        return since, "FAILED", "system:approval-timeout"


class Latest:
    """The status of the newest row."""

    inputs = ["status"]
    outputs = "status string"

    def start(self):
        return {}

    def step(self, s, ts_ms, status):
        return (status,)


class StatusCache:
    """Read-through status cache: a write lives some time, a read gives what lives."""

    inputs = ["is_read", "status"]
    outputs = "cached string"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = self.memory_ms = ttl_ms

    def start(self):
        return {"status": None, "ms": None}

    def step(self, s, ts_ms, is_read, status):
        if not is_read:
            s["status"], s["ms"] = status, ts_ms
            return None
        return (s["status"] if s["ms"] is not None and ts_ms - s["ms"] < self.ttl_ms else None,)
