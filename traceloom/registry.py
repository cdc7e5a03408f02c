"""The tool registry: what an agent may call, with which arguments, at which node."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from .functions.canon import canonical, version_of

ARGUMENT_TYPES = ("string", "number", "integer", "boolean", "array", "object")
NONE = "none"


@dataclass(frozen=True)
class Argument:
    type: str = "string"
    required: bool = False
    enum: tuple | None = None
    description: str | None = None

    def __post_init__(self):
        if self.type not in ARGUMENT_TYPES:
            raise ValueError(f"argument type {self.type!r} is none of {', '.join(ARGUMENT_TYPES)}")


@dataclass(frozen=True)
class Tool:
    description: str
    arguments: dict[str, Argument] = field(default_factory=dict)
    #: True, False, or None where nobody has said
    side_effecting: bool | None = None
    allow_extra_arguments: bool = False
    preconditions: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.description:
            raise ValueError("a tool needs a description")
        if any(not p.strip() for p in self.preconditions):
            raise ValueError("a precondition can't be blank")


@dataclass(frozen=True)
class Registry:
    tools: dict[str, Tool]
    nodes: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        if not self.tools:
            raise ValueError("a registry needs a tool")
        if NONE in self.tools:
            raise ValueError(f"a tool can't be named {NONE!r}: that stands for no call")
        for node, tools in self.nodes.items():
            if not tools:
                raise ValueError(f"node {node!r} allows nothing")
            if unknown := [t for t in tools if t not in self.tools]:
                raise ValueError(f"node {node!r} allows undeclared tools: {', '.join(unknown)}")

    @classmethod
    def of(cls, data: dict) -> Registry:
        """From a plain dict, as a YAML or JSON file has it."""
        unknown = set(data) - {"tools", "nodes"}
        if unknown:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        tools = {}
        for name, t in (data.get("tools") or {}).items():
            args = {a: Argument(**({k: tuple(v) if k == "enum" and v is not None else v for k, v in (s or {}).items()})) for a, s in (t.get("arguments") or {}).items()}
            tools[name] = Tool(**{**t, "arguments": args, "preconditions": tuple(t.get("preconditions") or ())})
        nodes = {n: tuple((s or {}).get("tools") or ()) for n, s in (data.get("nodes") or {}).items()}
        return cls(tools, nodes)

    def hash(self) -> str:
        return version_of(asdict(self))

    def allowed(self, node: str | None) -> list[str]:
        """Tools allowed at a node (all without one), sorted."""
        return sorted(self.tools if node is None else self.nodes[node])

    def choices(self, node: str | None) -> list[str]:
        return [*self.allowed(node), NONE]

    def catalogue(self, node: str | None = None) -> str:
        """The tools as a prompt lists them: sorted, so that equal prompts stay equal."""
        lines = []
        for name in self.allowed(node):
            tool = self.tools[name]
            args = []
            for a, s in tool.arguments.items():
                kind = "|".join(canonical(e) for e in s.enum) if s.enum else s.type
                args.append(f"{a}{'' if s.required else '?'}: {kind}")
            lines += [f"{name}({', '.join(args)})", f"  {tool.description}"]
        return "\n".join(lines)

    def enum_texts(self, tool: str, argument: str) -> list[str]:
        return [json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for e in self.tools[tool].arguments[argument].enum or ()]
