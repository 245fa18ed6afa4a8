"""Text layouts: what the lines of a page mean, as contexts with fields, and the machine that reads a page by them.

A context is tried at the current line. It takes a number of lines, must match its format, and gives its fields, each
taken out of what is left of the text; a missing field that is required makes it invalid. Contexts come in order: one
that repeats stays, one that is optional may be passed over, and a required one that doesn't match ends the layout. A
child line leads back to its parent. Of several layouts the first one that reads a page to its end is that page's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    name: str
    pattern: str
    required: bool = True

    def take(self, text: str) -> tuple[str | None, str]:
        """The value and the text without its first occurrence."""
        m = re.search(self.pattern, text, re.IGNORECASE)
        if not m:
            return None, text
        value = next((g for g in m.groups() if g is not None), m[0]).strip()
        return (value, text.replace(value, "", 1)) if value else (None, text)


@dataclass(frozen=True)
class Context:
    name: str
    format: str
    fields: tuple[Field, ...] = ()
    lines: int = 1
    required: bool = True
    repeat: bool = False
    parent: str | None = None

    def read(self, rows: list[str], at: int = 0) -> dict[str, str | None] | None:
        """The fields, if the lines from at on are this context."""
        text = "\n".join(rows[at : at + self.lines])
        if len(rows) - at < self.lines or not re.search(self.format, text, re.IGNORECASE):
            return None
        found = {}
        for f in self.fields:
            found[f.name], text = f.take(text)
            if f.required and found[f.name] is None:
                return None
        return found


@dataclass(frozen=True)
class Layout:
    name: str
    contexts: tuple[Context, ...] = field(default_factory=tuple)

    def read(self, rows: list[str]) -> list[tuple[str, str, dict[str, str | None]]] | None:
        """(context, key of the parents and itself, fields) for each match; None if a required context is missing or lines are left."""
        out: list[tuple[str, str, dict[str, str | None]]] = []
        at, k, keys, seen = 0, 0, {}, set()
        tried: set[tuple[int, int]] = set()
        while at < len(rows):
            if not rows[at].strip() and not any(c.format == "^$" for c in self.contexts):
                at += 1
                continue
            if k >= len(self.contexts):
                back = next((j for j, c in enumerate(self.contexts) if c.repeat and (at, j) not in tried), None)
                if back is None:
                    return None
                k = back
            context = self.contexts[k]
            fresh = (at, k) not in tried
            tried.add((at, k))
            found = context.read(rows, at) if fresh else None
            if found is None:
                parent = next((j for j, c in enumerate(self.contexts) if c.name == context.parent), None)
                if parent is not None and (at, parent) not in tried and self.contexts[parent].repeat:
                    k = parent
                elif context.required and not context.repeat and context.name not in seen and context.parent is None:
                    return None
                else:
                    k += 1
                continue
            seen.add(context.name)
            own = "|".join(v or "" for v in found.values()) or context.name
            keys[context.name] = own
            out.append((context.name, "/".join([*([keys[context.parent]] if context.parent in keys else []), own]), found))
            at += context.lines
            k = k if context.repeat and not any(c.parent == context.name for c in self.contexts) else k + 1
        missing = [c for c in self.contexts if c.required and c.name not in seen]
        return None if missing else out


def read_page(text: str, layouts: list[Layout]) -> tuple[str | None, list[tuple[str, str, dict[str, str | None]]]]:
    """The first layout that reads the page, and its matches; an empty page is valid for any."""
    rows = re.split(r"\r?\n", text)
    if not text.strip():
        return None, []
    for layout in layouts:
        if (found := layout.read(rows)) is not None:
            return layout.name, found
    return None, []
