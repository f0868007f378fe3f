"""Clients of embedding and language models over HTTP, as the plugs of embedders and answers.

``post`` sends a JSON body to an address and returns the lines of the answer; tests give their
own.  An embedder is a callable from texts to vectors, an answerer one from a prompt to text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.error import URLError
from urllib.request import Request, urlopen

Post = Callable[[str, dict, dict], Iterator[str]]


class ClientError(RuntimeError):
    """A service that cannot be reached or that answers something else."""


def http_post(address: str, body: dict, headers: dict, timeout: float = 120) -> Iterator[str]:
    request = Request(address, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urlopen(request, timeout=timeout) as response:
            yield from (line.decode().rstrip("\n") for line in response)
    except (URLError, TimeoutError) as error:
        raise ClientError(str(error)) from error


def _answer(lines: Iterator[str]) -> dict:
    try:
        return json.loads("\n".join(lines))
    except ValueError as error:
        raise ClientError("the answer is no JSON") from error


def _vectors(rows, n: int) -> list[list[float]]:
    if not isinstance(rows, list) or len(rows) != n or not all(isinstance(v, list) for v in rows):
        raise ClientError("the answer lacks vectors")
    return [[float(x) for x in v] for v in rows]


def openai_embedder(key: str, model: str = "text-embedding-3-small", base: str = "https://api.openai.com/v1", post: Post = http_post) -> Callable[[list[str]], list[list[float]]]:
    def embed(texts: list[str]) -> list[list[float]]:
        got = _answer(post(f"{base}/embeddings", {"model": model, "input": texts}, {"Authorization": f"Bearer {key}"}))
        return _vectors([item.get("embedding") for item in got.get("data", [])], len(texts))

    return embed


def ollama_embedder(base: str = "http://localhost:11434", model: str = "nomic-embed-text", post: Post = http_post) -> Callable[[list[str]], list[list[float]]]:
    """Many texts a call; a server that cannot do that is asked for one at a time."""
    base = base.rstrip("/")

    def embed(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = _answer(post(f"{base}/api/embed", {"model": model, "input": texts}, {}))
        rows = got.get("embeddings")
        if not isinstance(rows, list) or len(rows) != len(texts):
            rows = [_answer(post(f"{base}/api/embeddings", {"model": model, "prompt": t}, {})).get("embedding") for t in texts]
        return _vectors(rows, len(texts))

    return embed


class Ollama:
    """Chat with a local server."""

    provider = "ollama"

    def __init__(self, base: str = "http://localhost:11434", model: str = "gemma3:4b", post: Post = http_post):
        self.base, self.model, self.post = base.rstrip("/"), model, post

    def _send(self, prompt: str, stream: bool, temperature: float, most: int) -> Iterator[str]:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": stream, "options": {"temperature": temperature, "num_predict": most}}
        return self.post(f"{self.base}/api/chat", body, {})

    def __call__(self, prompt: str, temperature: float = 0.3, most: int = 2048) -> str:
        return _answer(self._send(prompt, False, temperature, most)).get("message", {}).get("content", "")

    def stream(self, prompt: str, temperature: float = 0.3, most: int = 2048) -> Iterator[str]:
        for got in _objects(self._send(prompt, True, temperature, most)):
            if text := got.get("message", {}).get("content"):
                yield text


class Groq:
    """Chat with a hosted service of the usual chat interface."""

    provider = "groq"

    def __init__(self, key: str, model: str = "llama-3.3-70b-versatile", base: str = "https://api.groq.com/openai/v1", post: Post = http_post):
        self.key, self.model, self.base, self.post = key, model, base, post

    def _send(self, prompt: str, stream: bool, temperature: float, most: int) -> Iterator[str]:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": temperature, "max_tokens": most, "stream": stream}
        return self.post(f"{self.base}/chat/completions", body, {"Authorization": f"Bearer {self.key}"})

    def __call__(self, prompt: str, temperature: float = 0.3, most: int = 2048) -> str:
        first = (_answer(self._send(prompt, False, temperature, most)).get("choices") or [{}])[0]
        return first.get("message", {}).get("content", "")

    def stream(self, prompt: str, temperature: float = 0.3, most: int = 2048) -> Iterator[str]:
        data = (line[6:] for line in self._send(prompt, True, temperature, most) if line.startswith("data: "))
        for got in _objects(data):
            if text := (got.get("choices") or [{}])[0].get("delta", {}).get("content"):
                yield text


class Nothing:
    """Says nothing: answers keep their own text."""

    provider = model = "none"

    def __call__(self, prompt: str, **_) -> str:
        return ""

    def stream(self, prompt: str, **_) -> Iterator[str]:
        return iter(())


def _objects(lines: Iterator[str]) -> Iterator[dict]:
    """JSON objects, one a line, up to an end mark; lines that are none are left out."""
    for line in lines:
        if line.strip() == "[DONE]":
            return
        try:
            got = json.loads(line)
        except ValueError:
            continue
        if isinstance(got, dict):
            yield got


def answerer(kind: str = "ollama", base: str = "http://localhost:11434", key: str | None = None):
    """The answerer of that name; one that says nothing without a key or for other names."""
    if kind == "groq" and key:
        return Groq(key)
    return Ollama(base) if kind == "ollama" else Nothing()
