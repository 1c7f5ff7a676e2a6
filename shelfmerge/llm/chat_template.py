"""A compiler for chat templates: text to syntax tree, folded, to Python closures.

The language is a small, sandboxed one: ``{{ value }}``, ``{% for x in xs %}``
with ``loop.index``, ``loop.index0``, ``loop.first`` and ``loop.last``,
``{% if %}``/``{% elif %}``/``{% else %}``, ``{% set x = value %}``,
``{# remarks #}`` and ``{% generation %}`` ... ``{% endgeneration %}`` around
what a model learns to write. Values are literals, names, ``a.b`` and ``a["b"]``
on mappings and lists, ``+ ~ == != < <= > >= in not and or``, ``x if c else y``
and a fixed set of filters. No Python attribute, call or import can be reached.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """A template that does not follow the language, or a value it cannot take."""


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- words of the language

PARTS = re.compile(r"\{#.*?#\}|\{\{(?P<minus>-?)(?P<value>.*?)(?P<end>-?)\}\}|\{%(?P<lead>-?)(?P<tag>.*?)(?P<tail>-?)%\}", re.S)
TOKENS = re.compile(r"""\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].,|=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


class Reader:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = TOKENS.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at : at + 20]!r}")
            at, kind = m.end(), m.lastgroup
            raw = m[kind]
            if kind == "num":
                raw = int(raw)
            elif kind == "str":
                raw = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], "\\" + e[1]), raw[1:-1], flags=re.S)
            self.tokens.append((kind, raw))
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: str) -> bool:
        kind, raw = self.peek()
        if kind in ("op", "name") and raw in wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, not {self.peek()[1]!r}")

    def name(self) -> str:
        kind, raw = self.peek()
        if kind != "name" or raw in WORDS:
            raise TemplateError(f"a name expected, not {raw!r}")
        self.at += 1
        return raw

    def done(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"nothing expected, not {self.peek()[1]!r}")

    def whole(self) -> Any:
        out = self.value()
        self.done()
        return out

    def value(self) -> Any:
        out = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            out = Op("pick", (condition, out, self.value()))
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Op("and", (out, self.negated()))
        return out

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.joined()
        while True:
            kind, raw = self.peek()
            if kind == "op" and raw in ("==", "!=", "<", "<=", ">", ">="):
                self.at += 1
                out = Op(raw, (out, self.joined()))
            elif self.take("in"):
                out = Op("in", (out, self.joined()))
            elif raw == "not" and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                out = Op("not", (Op("in", (out, self.joined())),))
            else:
                return out

    def joined(self) -> Any:
        out = self.filtered()
        while True:
            kind, raw = self.peek()
            if kind != "op" or raw not in "+-~":
                return out
            self.at += 1
            out = Op(raw, (out, self.filtered()))

    def filtered(self) -> Any:
        out = self.single()
        while self.take("|"):
            name, args = self.name(), [out]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.value())
                    if not self.take(","):
                        self.need(")")
                        break
            out = Filter(name, tuple(args))
        return out

    def single(self) -> Any:
        kind, raw = self.peek()
        if kind in ("num", "str"):
            self.at += 1
            out: Any = Const(raw)
        elif self.take("("):
            out = self.value()
            self.need(")")
        elif kind == "name" and raw in ("true", "false", "none"):
            self.at += 1
            out = Const({"true": True, "false": False, "none": None}[raw])
        else:
            out = Name(self.name())
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.value())
                self.need("]")
            else:
                return out


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[Any] = []
    at, trim = 0, False
    for m in PARTS.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if trim else text
        if m["minus"] or m["lead"]:
            text = text.rstrip()
        if text:
            parts.append(Out(Const(text)))
        at, trim = m.end(), bool(m["end"] or m["tail"])
        if m["value"] is not None:
            parts.append(Out(Reader(m["value"]).whole()))
        elif m["tag"] is not None:
            parts.append(Reader(m["tag"]))
    rest = template[at:].lstrip() if trim else template[at:]
    if rest:
        parts.append(Out(Const(rest)))
    body, left, _ = block(parts, 0, ())
    if left != len(parts):
        raise TemplateError("an end without a start")
    return body


def block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int, Any]:
    """Nodes up to one of the ending words; where they stop, and the reader that stopped them."""
    out: list[Any] = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if not isinstance(part, Reader):
            out.append(part)
            continue
        word = part.name() if part.peek()[1] not in WORDS else part.tokens[0][1]
        if word in ("if", "else"):
            part.at = 1
        if word in ends:
            return tuple(out), at, (word, part)
        if word == "for":
            name = part.name()
            part.need("in")
            over = part.whole()
            body, at, _ = block(parts, at, ("endfor",))
            out.append(For(name, over, body))
        elif word == "if":
            condition, arms, stop = part.whole(), [], "if"
            while stop != "endif":
                body, at, (stop, reader) = block(parts, at, ("elif", "else", "endif"))
                arms.append((condition, body))
                condition = reader.whole() if stop == "elif" else Const(True)
            out.append(If(tuple(arms)))
        elif word == "set":
            name = part.name()
            part.need("=")
            out.append(Assign(name, part.whole()))
        elif word == "generation":
            body, at, _ = block(parts, at, ("endgeneration",))
            out.append(Generation(body))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if ends:
        raise TemplateError(f"no {' or '.join(ends)}")
    return tuple(out), at, None


# ---- operations

#: Strings that mark turns in rendered text; inside texts they are escaped.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"]
ESCAPE = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]|ROLE\]))")
UNESCAPE = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]|ROLE\]))")


def escape(text: Any) -> str:
    """Control strings get a backslash after their first character, escaped ones one more."""
    return ESCAPE.sub(r"\1\\\2", as_text(text))


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def as_text(x: Any) -> str:
    if x is None:
        return ""
    if x is True or x is False:
        return str(x).lower()
    if isinstance(x, str | int):
        return str(x)
    raise TemplateError("only text and numbers can be written")


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "trim": lambda x: as_text(x).strip(),
    "upper": lambda x: as_text(x).upper(),
    "lower": lambda x: as_text(x).lower(),
    "length": len,
    "default": lambda x, other: other if x is None else x,
    "replace": lambda x, old, new: as_text(x).replace(old, new),
}
OPERATIONS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: as_text(a) + as_text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
}


def fold(node: Any) -> Any:
    """The tree with constant values worked out, dead branches gone and neighbouring text joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in node:
            x = fold(x)
            if isinstance(x, If) and isinstance(x.arms[0][0], Const):
                fresh = list(x.arms[0][1])
            else:
                fresh = [x]
            for y in fresh:
                if isinstance(y, Out) and isinstance(y.value, Const):
                    text = as_text(y.value.value)
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        text = out.pop().value.value + text
                    if text:
                        out.append(Out(Const(text)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        if node.name in ("and", "or", "pick"):
            if isinstance(args[0], Const):
                true = bool(args[0].value)
                if node.name == "pick":
                    return args[1] if true else args[2]
                return args[1] if true == (node.name == "and") else args[0]
            return Op(node.name, args)
        return constant(Op(node.name, args), OPERATIONS[node.name], args)
    if isinstance(node, Filter):
        args = tuple(fold(a) for a in node.args)
        return constant(Filter(node.name, args), FILTERS[node.name], args)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        return If(tuple(arms) or ((Const(True), ()),))
    return node


def constant(node: Any, f: Callable, args: tuple) -> Any:
    if not all(isinstance(a, Const) for a in args):
        return node
    try:
        return Const(f(*[a.value for a in args]))
    except (TypeError, ValueError) as e:
        raise TemplateError(f"constant value: {e}") from e


# ---- closures


@dataclass
class Writer:
    """Rendered text with the spans under generation marks."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    inside: int = 0

    def write(self, text: str) -> None:
        if text and self.inside:
            if self.spans and self.spans[-1][1] == self.size and self.joined:
                self.spans[-1] = (self.spans[-1][0], self.size + len(text))
            else:
                self.spans.append((self.size, self.size + len(text)))
            self.joined = True
        self.parts.append(text)
        self.size += len(text)

    joined: bool = False


def compile_value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda names: value
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Item):
        of, key = compile_value(node.of), compile_value(node.key)
        return lambda names: item(of(names), key(names))
    args = [compile_value(a) for a in node.args]
    if isinstance(node, Filter):
        f = FILTERS[node.name]
        return guarded(f, args)
    first, *rest = args
    if node.name == "and":
        return lambda names: first(names) and rest[0](names)
    if node.name == "or":
        return lambda names: first(names) or rest[0](names)
    if node.name == "pick":
        return lambda names: (rest[0] if first(names) else rest[1])(names)
    return guarded(OPERATIONS[node.name], args)


def guarded(f: Callable, args: list[Callable]) -> Callable[[dict], Any]:
    def run(names: dict) -> Any:
        try:
            return f(*[a(names) for a in args])
        except (TypeError, AttributeError) as e:
            raise TemplateError(str(e)) from e

    return run


def item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, list) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def compile_nodes(nodes: tuple) -> Callable[[dict, Writer], None]:
    steps = [compile_node(n) for n in nodes]

    def run(names: dict, out: Writer) -> None:
        for s in steps:
            s(names, out)

    return run


def compile_node(node: Any) -> Callable[[dict, Writer], None]:
    if isinstance(node, Out):
        value = compile_value(node.value)
        return lambda names, out: out.write(as_text(value(names)))
    if isinstance(node, Assign):
        name, value = node.name, compile_value(node.value)

        def assign(names: dict, out: Writer) -> None:
            names[name] = value(names)

        return assign
    if isinstance(node, If):
        arms = [(compile_value(c), compile_nodes(b)) for c, b in node.arms]

        def choose(names: dict, out: Writer) -> None:
            for condition, body in arms:
                if condition(names):
                    body(names, out)
                    return

        return choose
    if isinstance(node, Generation):
        body = compile_nodes(node.body)

        def generate(names: dict, out: Writer) -> None:
            out.inside += 1
            out.joined = False
            body(names, out)
            out.inside -= 1

        return generate
    name, over, body = node.name, compile_value(node.over), compile_nodes(node.body)

    def loop(names: dict, out: Writer) -> None:
        values = over(names) or []
        for k, value in enumerate(values):
            body(names | {name: value, "loop": place(k, k == len(values) - 1)}, out)

    return loop


def place(k: int, last: bool) -> dict:
    return {"index": k + 1, "index0": k, "first": k == 0, "last": last}


class Template:
    """A compiled template over ``messages``.

    Where its one loop over messages stands at the top, a conversation can also
    be rendered message by message, so that one of any length needs no more
    memory than its longest message.
    """

    def __init__(self, text: str):
        self.tree = fold(parse(text))
        self.all = compile_nodes(self.tree)
        at = [k for k, n in enumerate(self.tree) if isinstance(n, For) and n.over == Name("messages")]
        self.streams = len(at) == 1 and not any(isinstance(n, Assign) for n in self.tree)
        if self.streams:
            loop = self.tree[at[0]]
            self.name = loop.name
            self.before, self.body = compile_nodes(self.tree[: at[0]]), compile_nodes(loop.body)
            self.after = compile_nodes(self.tree[at[0] + 1 :])

    def render(self, messages: list[dict], **names: Any) -> Writer:
        out = Writer()
        self.all(names | {"messages": messages}, out)
        return out

    def render_one(self, message: dict, k: int, last: bool, **names: Any) -> Writer:
        """What render() writes for the k-th message, with what stands before the first and after the last."""
        if not self.streams:
            raise TemplateError("this template reads the messages as a whole")
        out = Writer()
        if k == 0:
            self.before(dict(names), out)
        self.body(names | {self.name: message, "loop": place(k, last)}, out)
        if last:
            self.after(dict(names), out)
        return out

    def stream(self, messages: Iterator[dict], **names: Any) -> Iterator[Writer]:
        held, k = None, 0
        for m in messages:
            if held is not None:
                yield self.render_one(held, k, False, **names)
                k += 1
            held = m
        if held is not None:
            yield self.render_one(held, k, True, **names)
