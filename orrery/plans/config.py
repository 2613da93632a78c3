"""Settings of a run: nested blocks of key=value; lines, where a block falls back on the one around it."""

from __future__ import annotations

import re


class Config:
    """Values by dotted name. find("a.b.key") looks at a.b.key, then a.key, then key."""

    def __init__(self, values: dict[str, str] | None = None):
        self.values = dict(values or {})

    @classmethod
    def parse(cls, text: str, overrides: list[str] = ()) -> Config:
        """overrides: name=value strings that win over the text, as a command line gives them."""
        values, path = {}, []
        text = re.sub(r"#[^\n]*", "", text)
        for token in re.finditer(r"([\w.]+)\s*\{|([\w.]+)\s*=\s*([^;{}]*);|(\})", text):
            if token.group(1):
                path.append(token.group(1))
            elif token.group(4):
                if not path:
                    raise ValueError("a block is closed that wasn't opened")
                path.pop()
            else:
                values[".".join([*path, token.group(2)])] = token.group(3).strip()
        if path:
            raise ValueError(f"block {path[-1]} isn't closed")
        for o in overrides:
            name, _, value = o.partition("=")
            values[name.strip()] = value.strip()
        return cls(values)

    def find(self, name: str, default: str | None = None) -> str | None:
        *path, key = name.split(".")
        for n in range(len(path), -1, -1):
            if (found := self.values.get(".".join([*path[:n], key]))) is not None:
                return found
        return default

    def names(self, name: str) -> list[str]:
        """A value that lists names by commas."""
        return [x.strip() for x in (self.find(name) or "").split(",") if x.strip()]
