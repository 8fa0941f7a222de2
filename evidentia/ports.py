"""What can be plugged in beside connectors: workers, models, skills, channels and tools."""

from __future__ import annotations

from abc import ABC, abstractmethod


class Port(ABC):
    def describe(self) -> dict:
        return {"name": type(self).__name__}


class Worker(Port):
    """Handles a claimed unit of work; raises if it can't."""

    @abstractmethod
    def handle(self, task: dict) -> dict: ...


class Model(Port):
    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]: ...

    @abstractmethod
    def complete(self, request: dict) -> dict: ...


class Skill(Port):
    """Puts an answer into the context's words; the facts stay."""

    @abstractmethod
    def render(self, answer: dict, context: dict) -> str: ...

    def deflection(self, context: dict) -> str:
        return "That is not something I can help with here."


class Channel(Port):
    @abstractmethod
    def send(self, message: dict) -> None: ...


class Tool(Port):
    @abstractmethod
    def invoke(self, action: dict, dry_run: bool = True) -> dict: ...
