"""A small sandboxed template language, compiled to Python closures.

Text, ``{{ expression }}``, ``{# comment #}`` and the blocks ``for``/``endfor``,
``if``/``elif``/``else``/``endif``, ``set`` and ``generation``/``endgeneration``
(whose output is what a model learns to write).  A ``-`` inside a tag strips
the white space next to it.  Expressions have literals, names, ``a.b`` and
``a['b']`` on mappings and lists, ``not and or``, comparisons, ``in``,
``+ - * %``, ``~`` (text join), ``x if c else y`` and ``|filter``.  There are
no calls, no attributes of Python objects and no names but those given, so a
template can neither run code nor see anything else.

Source is parsed to a tree, constant parts are folded, and each node becomes
a closure that yields (text, generated) pieces; a ``for`` over an iterator
holds one item and the next, so that a conversation of any length renders in
bounded memory.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    pass


# tree ----------------------------------------------------------------------


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
class Apply:
    """An operator or a filter on its arguments."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (test or None, block)


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _numbers(name: str, call: Callable) -> Callable:
    def run(*values: Any) -> Any:
        if not all(isinstance(v, (int, float)) for v in values):
            raise TemplateError(f"{name} is for numbers; texts can be neither repeated nor formatted")
        return call(*values)

    return run


OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": _numbers("*", operator.mul), "%": _numbers("%", operator.mod), "~": lambda a, b: _text(a) + _text(b),
    "in": lambda a, b: a in b, "not": operator.not_, "neg": operator.neg,
}
FILTERS: dict[str, Callable] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "string": _text}
PLAIN = (str, int, float, bool, type(None))

# source to tree -------------------------------------------------------------

TAG = re.compile(r"(\s*\{[{%#]-|\{[{%#])(.*?)(-[}%#]\}\s*|[}%#]\})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+(?:\.\d+)?)|(?P<word>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[-+*%~<>|.\[\]()]))""")
ESCAPES = {"n": "\n", "t": "\t"}


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.source, self.filters, self.tokens, at = source, filters, [], 0
        while source[at:].strip():
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind in ("string", "number") else value

    def take(self, *values: str) -> str | None:
        if self.peek() in values and self.peek() is not None:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected in {self.source!r}")

    def whole(self) -> Any:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return out

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            return Choice(test, value, self.choice() if self.take("else") else Const(None))
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Apply("or", (value, self.both()))
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.take("and"):
            value = Apply("and", (value, self.negated()))
        return value

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        value = self.sum()
        while True:
            if name := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                value = Apply(name, (value, self.sum()))
            elif self.peek() == "not" and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                value = Apply("not", (Apply("in", (value, self.sum())),))
            else:
                return value

    def sum(self) -> Any:
        value = self.product()
        while name := self.take("+", "-", "~"):
            value = Apply(name, (value, self.product()))
        return value

    def product(self) -> Any:
        value = self.signed()
        while name := self.take("*", "%"):
            value = Apply(name, (value, self.signed()))
        return value

    def signed(self) -> Any:
        return Apply("neg", (self.signed(),)) if self.take("-") else self.filtered()

    def filtered(self) -> Any:
        value = self.atom()
        while True:
            if self.take("|"):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
                if kind != "word" or name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                self.at += 1
                value = Apply("|" + name, (value,))
            elif self.take("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, "")
                if kind != "word" or name.startswith("_"):
                    raise TemplateError(f"no field {name!r}")
                self.at += 1
                value = Item(value, Const(name))
            elif self.take("["):
                value = Item(value, self.choice())
                self.need("]")
            else:
                return value

    def atom(self) -> Any:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError(f"an expression ends early: {self.source!r}")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return Const(float(value) if "." in value else int(value))
        if kind == "word":
            fixed = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return Const(fixed[value]) if value in fixed else Name(value)
        raise TemplateError(f"unexpected {value!r} in {self.source!r}")


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    """The tree of a template."""
    pieces, at, strip = [], 0, False
    for tag in TAG.finditer(source):
        text = source[at : tag.start()]
        pieces.append(("text", text.lstrip() if strip else text))
        pieces.append((tag[1].strip()[1], tag[2].strip()))
        strip, at = False, tag.end()
    pieces.append(("text", source[at:]))
    position = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal position
        out: list[Any] = []
        while position < len(pieces):
            kind, value = pieces[position]
            position += 1
            if kind == "text":
                if value:
                    out.append(Out(Const(value)))
            elif kind == "{":
                out.append(Out(Expression(value, filters).whole()))
            elif kind == "%":
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(out), value
                out.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return tuple(out), ""

    def statement(word: str, rest: str) -> Any:
        if word == "for":
            found = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
            if not found:
                raise TemplateError(f"cannot read 'for {rest}'")
            return For(found[1], Expression(found[2], filters).whole(), block(("endfor",))[0])
        if word == "if":
            branches, test = [], Expression(rest, filters).whole()
            while True:
                body, end = block(("endif", "elif", "else"))
                branches.append((test, body))
                if end == "endif":
                    return If(tuple(branches))
                if end == "else":
                    branches.append((None, block(("endif",))[0]))
                    return If(tuple(branches))
                test = Expression(end.partition(" ")[2], filters).whole()
        if word == "set":
            found = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.*)", rest, re.S)
            if not found:
                raise TemplateError(f"cannot read 'set {rest}'")
            return Assign(found[1], Expression(found[2], filters).whole())
        if word == "generation":
            return Generation(block(("endgeneration",))[0])
        raise TemplateError(f"no block {word!r}")

    return block(())[0]


# constant folding ------------------------------------------------------------


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The node with its constant parts worked out; errors are left for render time."""
    again = lambda n: fold(n, filters)
    if isinstance(node, Apply):
        args = tuple(map(again, node.args))
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name not in ("and", "or") and all(isinstance(a, Const) for a in args):
            try:
                return Const((filters[node.name[1:]] if node.name[0] == "|" else OPERATORS[node.name])(*[a.value for a in args]))
            except Exception:
                pass
        return Apply(node.name, args)
    if isinstance(node, Item):
        return Item(again(node.of), again(node.key))
    if isinstance(node, Choice):
        test = again(node.test)
        if isinstance(test, Const):
            return again(node.yes if test.value else node.no)
        return Choice(test, again(node.yes), again(node.no))
    if isinstance(node, Out):
        return Out(again(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, again(node.value))
    if isinstance(node, Generation):
        return Generation(fold_block(node.body, filters))
    if isinstance(node, For):
        return For(node.name, again(node.over), fold_block(node.body, filters))
    if isinstance(node, If):
        branches = []
        for test, body in node.branches:
            test = again(test) if test is not None else None
            if isinstance(test, Const) and not test.value:
                continue
            sure = test is None or isinstance(test, Const)
            branches.append((None if sure else test, fold_block(body, filters)))
            if sure:
                break
        return If(tuple(branches))
    return node


def fold_block(body: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Folded nodes; neighbouring constant texts become one."""
    out: list[Any] = []
    for node in (fold(n, filters) for n in body):
        inner = node.branches[0][1] if isinstance(node, If) and node.branches and node.branches[0][0] is None else () if isinstance(node, If) and not node.branches else (node,)
        for n in inner:
            if isinstance(n, Out) and isinstance(n.value, Const):
                text = _text(n.value.value)
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    out[-1] = Out(Const(out[-1].value.value + text))
                    continue
                n = Out(Const(text))
            out.append(n)
    return tuple(out)


# tree to closures -------------------------------------------------------------

Scope = dict[str, Any]
Piece = tuple[str, bool]


def _expression(node: Any, filters: Mapping[str, Callable]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _expression(node.of, filters), _expression(node.key, filters)

        def item(scope: Scope) -> Any:
            holder, at = of(scope), key(scope)
            if isinstance(holder, Mapping):
                return holder.get(at)
            if isinstance(holder, (list, tuple, str)) and isinstance(at, int):
                return holder[at] if -len(holder) <= at < len(holder) else None
            return None

        return item
    if isinstance(node, Choice):
        test, yes, no = (_expression(n, filters) for n in (node.test, node.yes, node.no))
        return lambda scope: yes(scope) if test(scope) else no(scope)
    args = [_expression(a, filters) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    call = filters[node.name[1:]] if node.name[0] == "|" else OPERATORS[node.name]
    return lambda scope: call(*[a(scope) for a in args])


def _block(body: tuple, filters: Mapping[str, Callable], generated: bool) -> Callable[[Scope], Iterator[Piece]]:
    parts = [_statement(n, filters, generated) for n in body]

    def run(scope: Scope) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope)

    return run


def _statement(node: Any, filters: Mapping[str, Callable], generated: bool) -> Callable[[Scope], Iterator[Piece]]:
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            pieces = ((_text(node.value.value), generated),)
            return lambda scope: iter(pieces)
        value = _expression(node.value, filters)
        return lambda scope: iter(((_text(value(scope)), generated),))
    if isinstance(node, Generation):
        return _block(node.body, filters, True)
    if isinstance(node, Assign):
        name, value = node.name, _expression(node.value, filters)

        def assign(scope: Scope) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, If):
        branches = [(_expression(t, filters) if t is not None else None, _block(b, filters, generated)) for t, b in node.branches]

        def choose(scope: Scope) -> Iterator[Piece]:
            for test, run in branches:
                if test is None or test(scope):
                    return run(scope)
            return iter(())

        return choose
    name, over, body = node.name, _expression(node.over, filters), _block(node.body, filters, generated)

    def loop(scope: Scope) -> Iterator[Piece]:
        items, index, end = iter(over(scope) or ()), 0, object()
        item = next(items, end)
        while item is not end:
            following = next(items, end)
            inner = {**scope, name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": following is end}}
            yield from body(inner)
            item, index = following, index + 1

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        self.filters = {**FILTERS, **(filters or {})}
        self.tree = fold_block(parse(source, self.filters), self.filters)
        self._run = _block(self.tree, self.filters, False)

    def pieces(self, **values: Any) -> Iterator[Piece]:
        """(text, generated) pieces in order."""
        return self._run(dict(values))

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of it that were generated."""
        out, spans, at = [], [], 0
        for text, generated in self.pieces(**values):
            if generated and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


def conversation(rows: Iterable[tuple[str | None, str | None]]) -> Iterator[dict[str, str]]:
    return ({"role": role or "", "text": text or ""} for role, text in rows)
