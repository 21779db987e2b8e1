"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` prints, ``{% set %}``, ``{% for %}``, ``{% if %}``, ``{% elif %}``, ``{% else %}`` and ``{% generation %}``
.. ``{% endgeneration %}`` (text that counts for the loss) control.  Expressions know strings, integers, true and false,
names, ``.field``, ``+ == != and or not``, and the filters in ``FILTERS``.  There are no calls, no attribute access
other than of dictionary keys, and loops run over the messages only, so a template cannot reach Python.

Stages: ``parse`` makes a syntax tree, ``fold`` evaluates its constant parts and joins neighbouring text, ``compile_tree``
turns each node into a closure that yields ``(text, counts)`` pieces, one message at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

Piece = tuple[str, bool]
#: The characters that open a control string (``<|im_start|>``, ``</s>``, ``[INST]``) and their names in a text.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_NAMED = {v: k for k, v in ESCAPES.items()} | {"\\n": "\n"}
_SPECIAL = re.compile(r"[\\<\[]")
_NAME = re.compile(r"\\[\\lbn]")


def escape(text: str) -> str:
    """No control string can stand in the result: the characters that open one are replaced by their names."""
    return _SPECIAL.sub(lambda m: ESCAPES[m[0]], text)


def escape_line(text: str) -> str:
    """As ``escape``, and no line end can stand in the result."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _NAME.sub(lambda m: _NAMED[m[0]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """The template is not well formed."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: str


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Put:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_LEXEME = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+.|()=]))""", re.S)
_SLASHED = {"n": "\n", "t": "\t"}


class _Expression:
    """A recursive-descent reader of one expression."""

    def __init__(self, text: str):
        self.parts, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEXEME.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.parts.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.parts[self.at] if self.at < len(self.parts) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind != "string" and value in wanted:
            self.at += 1
            return value
        return None

    def whole(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Apply("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = Apply("and", (tree, self.negated()))
        return tree

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        tree = self.summed()
        while op := self.take("==", "!="):
            tree = Apply(op, (tree, self.summed()))
        return tree

    def summed(self):
        tree = self.filtered()
        while self.take("+"):
            tree = Apply("+", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.atom()
        while op := self.take(".", "|"):
            kind, value = self.peek()
            if kind != "name" or op == "|" and value not in FILTERS:
                raise TemplateError(f"unknown {value!r} after {op}")
            self.at += 1
            tree = Field(tree, value) if op == "." else Apply(value, (tree,))
        return tree

    def atom(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _SLASHED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(value))
        if kind == "name" and value in ("true", "false"):
            return Const(value == "true")
        if kind == "name":
            return Name(value)
        if value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        raise TemplateError(f"unexpected {value or 'end'!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    tags, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            tags.append(("text", source[at : m.start()]))
        tags.append(("print", m[1]) if m[1] is not None else ("do", m[2].strip()))
        at = m.end()
    if at < len(source):
        tags.append(("text", source[at:]))
    place = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        nodes = []
        while place < len(tags):
            kind, value = tags[place]
            place += 1
            if kind == "text":
                nodes.append(Output(Const(value)))
            elif kind == "print":
                nodes.append(Output(_Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(nodes), value
                nodes.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    def condition(rest: str) -> If:
        then, end = block("elif", "else", "endif")
        other: tuple = ()
        if end.startswith("elif"):
            other = (condition(end.partition(" ")[2]),)
        elif end == "else":
            other, _ = block("endif")
        return If(_Expression(rest).whole(), then, other)

    def statement(word: str, rest: str):
        if word == "if":
            return condition(rest)
        if word == "for" and (m := re.fullmatch(r"(\w+) in messages", rest.strip())):
            return For(m[1], block("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"(\w+)\s*=(?!=)(.*)", rest.strip(), re.S)):
            return Put(m[1], _Expression(m[2]).whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"cannot read statement {word} {rest}")

    return block()[0]


_APPLY: dict[str, Callable] = {"+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}", "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a, **FILTERS}


def _fold(node):
    if isinstance(node, Field):
        return Field(_fold(node.of), node.key)
    if isinstance(node, Apply):
        args = tuple(map(_fold, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op in _APPLY and all(isinstance(a, Const) for a in args):
            return Const(_APPLY[node.op](*(a.value for a in args)))
        return Apply(node.op, args)
    return node


def fold(nodes: tuple) -> tuple:
    """Constant expressions become constants, decided branches disappear, neighbouring constant text is joined."""
    out: list = []
    todo = list(reversed(nodes))
    while todo:
        node = todo.pop()
        if isinstance(node, Output):
            node = Output(_fold(node.value))
            if isinstance(node.value, Const):
                text = str(node.value.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    text = str(out.pop().value.value) + text
                if text:
                    out.append(Output(Const(text)))
                continue
        elif isinstance(node, Put):
            node = Put(node.name, _fold(node.value))
        elif isinstance(node, For):
            node = For(node.name, fold(node.body))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body))
        elif isinstance(node, If):
            test = _fold(node.test)
            if isinstance(test, Const):
                todo.extend(reversed(node.then if test.value else node.other))
                continue
            node = If(test, fold(node.then), fold(node.other))
        out.append(node)
    return tuple(out)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name, "")
    if isinstance(node, Field):
        of, key = _value(node.of), node.key

        def field(scope):
            found = of(scope)
            return found.get(key, "") if isinstance(found, dict) else ""

        return field
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    apply = _APPLY[node.op]
    if len(args) == 1:
        one = args[0]
        return lambda scope: apply(one(scope))
    left, right = args
    return lambda scope: apply(left(scope), right(scope))


def _writer(node, counts: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Output):
        value = _value(node.value)

        def output(scope):
            yield str(value(scope)), counts

        return output
    if isinstance(node, Put):
        name, value = node.name, _value(node.value)

        def put(scope):
            scope[name] = value(scope)
            return iter(())

        return put
    if isinstance(node, Generation):
        return _block(node.body, True)
    if isinstance(node, If):
        test, then, other = _value(node.test), _block(node.then, counts), _block(node.other, counts)
        return lambda scope: then(scope) if test(scope) else other(scope)
    name, body = node.name, _block(node.body, counts)

    def loop(scope):
        for message in scope["messages"]:
            scope[name] = message
            yield from body(scope)

    return loop


def _block(nodes: tuple, counts: bool) -> Callable[[dict], Iterator[Piece]]:
    writers = [_writer(n, counts) for n in nodes]

    def block(scope):
        for write in writers:
            yield from write(scope)

    return block


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages to ``(text, counts for the loss)`` pieces; it holds one message at a time."""
    write = _block(fold(parse(source)), False)
    return lambda messages, **names: write({**names, "messages": messages})
