"""Text services behind transforms: settings, how many requests at once, prompts, and a registry of factories.

Everything foreign is handed in: a factory makes a transform from settings, a transport carries requests, a clock
and a sleeper serve the limiter of one caller. Nothing here opens a connection unless a transport does."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

import pandas as pd

from quire.functions.replies import parse
from quire.plans.transform import Transform, constant

#: Carries a request: address, headers, payload, seconds; gives the reply's object.
Transport = Callable[[str, dict[str, str], dict[str, Any], float], dict[str, Any]]


def number(value: Any, low: float, high: float, default: float, whole: bool = True) -> float:
    """A number from untrusted settings, within bounds."""
    try:
        n = float(default if value is None else value)
        n = int(n) if whole else round(n, 6)
    except (TypeError, ValueError, OverflowError):
        n = default
    return min(max(n, low), high)


@dataclass(frozen=True)
class Settings:
    """Each field is brought into its bounds when it is set."""

    provider: str = "fake"
    base_url: str = ""
    model: str = ""
    api_key: str = ""
    target_language: str = ""
    max_concurrency: int = 3
    request_timeout: float = 300.0
    max_retries: int = 2
    max_requests_per_minute: int = 0
    max_tokens_per_minute: int = 0
    budget_limit: float = 0.0
    input_cost_per_1m_tokens: float = 0.0
    output_cost_per_1m_tokens: float = 0.0
    batch_char_limit: int = 6000
    structured: bool = False
    memory_enabled: bool = True
    adaptive_enabled: bool = True

    def __post_init__(self) -> None:
        bounds = {
            "max_concurrency": (1, 8, 3, True), "request_timeout": (30, 1800, 300, False), "max_retries": (0, 5, 2, True), "max_requests_per_minute": (0, 1_000_000, 0, True),
            "max_tokens_per_minute": (0, 1_000_000, 0, True), "budget_limit": (0, float("inf"), 0, False), "input_cost_per_1m_tokens": (0, float("inf"), 0, False),
            "output_cost_per_1m_tokens": (0, float("inf"), 0, False), "batch_char_limit": (1000, 100_000, 6000, True),
        }
        for name, (low, high, default, whole) in bounds.items():
            object.__setattr__(self, name, number(getattr(self, name), low, high, default, whole))
        if family(self.provider) == "fake":
            object.__setattr__(self, "api_key", "")

    def public(self) -> dict[str, Any]:
        """Without the key, but with whether there is one."""
        return {k: v for k, v in asdict(self).items() if k != "api_key"} | {"has_api_key": bool(self.api_key.strip())}


#: Names of services by family.
FAMILIES = {
    "fake": ("fake", "dry-run", "dry_run"), "local": ("ollama", "local", "local-openai", "local_openai"), "chat": ("openai", "openai-compatible", "openai_compatible", "compatible"),
    "responses": ("openai-responses", "openai_responses", "responses"), "messages": ("anthropic", "claude"), "deepl": ("deepl", "deep-l"), "google": ("google", "google-translate", "google_translate"),
}


def family(provider: str) -> str:
    name = provider.strip().lower()
    for f, names in FAMILIES.items():
        if name in names:
            return f
    raise ValueError(f"unknown service: {provider}")


def loaded(text: str | None) -> dict[str, Any]:
    """Stored settings; nothing where there are none or they cannot be read."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def store(path: str | os.PathLike, settings: Settings) -> None:
    """Settings as a file of the driver's machine, readable by its owner only: written beside the old one, whose place it
    then takes. Fields are within their bounds, and a service without a key keeps none."""
    beside = f"{os.fspath(path)}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(os.open(beside, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, ensure_ascii=False, indent=2)
    os.replace(beside, path)


def kept(path: str | os.PathLike) -> dict[str, Any]:
    """The settings that `store` has written; nothing where there is no file or it cannot be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return loaded(f.read())
    except (OSError, UnicodeDecodeError):
        return {}


def merged(asked: dict[str, Any], stored: dict[str, Any]) -> Settings:
    """What was asked for, gaps filled from what is stored. A key is only taken over for the same service and
    address."""
    blank = lambda v: v is None or (isinstance(v, str) and not v.strip())
    out = {f.name: stored.get(f.name) if blank(asked.get(f.name)) else asked[f.name] for f in fields(Settings)}
    out["provider"] = out["provider"] or "openai-compatible"
    same = out["provider"] == stored.get("provider") and (out["base_url"] or "") == (stored.get("base_url") or "")
    if blank(asked.get("api_key")):
        out["api_key"] = stored.get("api_key", "") if same else ""
    return Settings(**{k: v for k, v in out.items() if v is not None})


def execution(settings: Settings, batch_chars: int, adaptive: bool) -> Settings:
    """How a plan is carried out: by the service's family and the batches' size, or as set."""
    if not adaptive:
        return settings
    f = family(settings.provider)
    if f == "local":
        at_once, seconds = 1, 900.0
    elif f in ("deepl", "google"):
        at_once, seconds = 4, 300.0
    elif batch_chars >= 8000:
        at_once, seconds = 2, 600.0
    else:
        at_once, seconds = 3, 480.0
    return replace(settings, max_concurrency=at_once, request_timeout=seconds, max_retries=2)


def validated(settings: Settings) -> Settings:
    f = family(settings.provider)
    if f in ("chat", "responses", "messages") and not settings.model.strip():
        raise ValueError("model is required")
    if f in ("chat", "responses") and not settings.base_url.strip():
        raise ValueError("base_url is required")
    if f in ("messages", "deepl", "google") and not settings.api_key.strip():
        raise ValueError("api_key is required")
    return settings


class Limiter:
    """Requests and tokens of one caller in windows of a minute that begin with a first request."""

    def __init__(self, requests: int, tokens: int, clock: Callable[[], float] = time.monotonic, sleeper: Callable[[float], None] = time.sleep):
        self.most, self.clock, self.sleeper = (requests, tokens), clock, sleeper
        self.begun, self.used = clock(), (0, 0)

    def acquire(self, tokens: int) -> float:
        """Waits as long as must be, and says how long that was."""
        if not any(self.most):
            return 0.0
        now, delay = self.clock(), 0.0
        if now - self.begun >= 60:
            self.begun, self.used = now, (0, 0)
        if any(m and u + n > m for m, u, n in zip(self.most, self.used, (1, tokens), strict=True)):
            delay = max(0.0, 60 - (now - self.begun))
            if delay:
                self.sleeper(delay)
            self.begun, self.used = self.clock(), (0, 0)
        self.used = (self.used[0] + 1, self.used[1] + tokens)
        return delay


def prompt(rows: pd.DataFrame, glossary: str, context: str, language: str, structured: bool) -> list[dict[str, str]]:
    """Messages that ask for rows of the same ids, in our own words."""
    form = 'one JSON object {"rows": [...]}' if structured else "JSON Lines and nothing else"
    system = f"Rewrite the text of XHTML snippets in {language}. Keep tags, attributes, ids, links and the order of rows. Reply with {form}; each row has exactly id and translated_html, one for every id."
    listed = [{"id": i, "source_html": h} for i, h in zip(rows["id"], rows["source_html"], strict=True)]
    return [{"role": "system", "content": system}, {"role": "user", "content": f"# Terms\n{glossary.strip()}\n\n# Context\n{context.strip()}\n\n# Rows\n{json.dumps(listed, ensure_ascii=False)}"}]


#: The JSON schema of a structured reply.
ROWS_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["rows"],
    "properties": {"rows": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["id", "translated_html"], "properties": {"id": {"type": "string"}, "translated_html": {"type": "string"}}}}},
}


def over_http(address: str, headers: dict[str, str], payload: dict[str, Any], seconds: float) -> dict[str, Any]:
    request = urllib.request.Request(address, json.dumps(payload).encode(), headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=seconds) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"provider HTTP {e.code}: {e.read().decode('utf-8', 'replace')[:500]}") from e
    except TimeoutError as e:
        raise TimeoutError(f"provider timed out after {seconds:g} s") from e


def reply_text(reply: dict[str, Any]) -> str:
    """The text of a reply in any of the forms that services use."""
    if isinstance(reply.get("output_text"), str):
        return reply["output_text"]
    if reply.get("choices"):
        content = reply["choices"][0].get("message", {}).get("content", "")
        return content if isinstance(content, str) else "".join(p.get("text", "") for p in content)
    parts = reply.get("content") or [p for item in reply.get("output", []) for p in item.get("content", [])]
    texts = [p["text"] for p in parts if isinstance(p, dict) and isinstance(p.get("text"), str)]
    if not texts:
        raise ValueError("provider returned no text")
    return "".join(texts)


def chat(settings: Settings, transport: Transport = over_http, glossary: str = "", context: str = "") -> Transform:
    """A transform by a service that answers messages."""
    f = family(settings.provider)
    base = (settings.base_url or ("http://127.0.0.1:11434/v1" if f == "local" else "")).rstrip("/")
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {settings.api_key}"} if settings.api_key else {})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        messages = prompt(rows, glossary, context, settings.target_language, settings.structured)
        payload: dict[str, Any] = {"model": settings.model, "input" if f == "responses" else "messages": messages}
        if settings.structured:
            payload["response_format"] = {"type": "json_schema", "json_schema": {"name": "rows", "schema": ROWS_SCHEMA}}
        got = parse(reply_text(transport(f"{base}/{'responses' if f == 'responses' else 'chat/completions'}", headers, payload, settings.request_timeout)))
        return pd.DataFrame([(x.get("id"), x.get("translated_html")) for x in got], columns=["id", "translated_html"])

    return run


#: Makes a transform from settings, by family. Callers may add their own.
FACTORIES: dict[str, Callable[..., Transform]] = {"fake": lambda settings, **_: constant(), "chat": chat, "responses": chat, "local": chat}


def transform_for(settings: Settings, factories: dict[str, Callable[..., Transform]] | None = None, **given: Any) -> Transform:
    f = family(validated(settings).provider)
    table = FACTORIES | (factories or {})
    if f not in table:
        raise ValueError(f"no factory for the service {settings.provider}: hand one in")
    return table[f](settings, **given)
