"""Chat formatting: a template compiler with constant folding and generation markers, and the reader of its output.

The language has ``{{ expression }}``, ``{% for x in messages %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set name = e %}`` and
``{% generation %}...{% endgeneration %}`` (text under the loss mask). Expressions have string and whole-number literals,
names, fields of messages and of ``loop``, ``not and or == != in + ~`` and the filters in FILTERS. Nothing else can be
reached: there are no calls, no attributes of Python objects and no imports. A template is parsed to a syntax tree, constants
are folded, and each node becomes a Python closure that yields pieces, so a conversation is rendered as a stream.

Rows of a conversation are ordered by turn, role, text (nulls first); null role or text is empty; null conv_id is one
conversation of its own; repeated rows are turns of their own. A conversation's text comes in parts of about ``PART``
characters (nearly always one), cut between pieces outside a mask, so no conversation has to fit in memory. An empty
table gives no rows; extra columns are ignored. A digest of a whole conversation is sequential by nature, so each
conversation is read in one task, in constant memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

PART = 1 << 20

#: fixed values: the control strings of the default format
OPEN, CLOSE = "<turn ", "</turn>"
TEMPLATE = (
    "{% for message in messages %}" + OPEN + "{{ message.role | escape_name }}>\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}\n" + CLOSE + "\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """No control string stands in the result: a backslash follows its first character; backslashes are doubled."""
    return text.replace("\\", "\\\\").replace(OPEN, "<\\" + OPEN[1:]).replace(CLOSE, "<\\" + CLOSE[1:])


def escape_name(text: str) -> str:
    return re.sub(r"[\\<>\n]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable] = {"escape": escape, "escape_name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().|+~]))")
_WORDS = {"and", "or", "not", "in", "true", "false"}
_QUOTED = {"n": "\n", "t": "\t"}


def _lex(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"unreadable: {source[at:]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("const", re.sub(r"\\(.)", lambda x: _QUOTED.get(x[1], x[1]), m[1][1:-1], flags=re.S)))
        elif m[2]:
            out.append(("const", int(m[2])))
        elif m[3]:
            out.append(("op", m[3]) if m[3] in _WORDS else ("name", m[3]))
        else:
            out.append(("op", m[4]))
    return out + [("end", "")]


class _Expression:
    """Precedence climbing over or, and, not, comparison, sum, filter."""

    def __init__(self, source: str):
        self.tokens = _lex(source)

    def parse(self):
        tree = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def take(self, *ops: str):
        return self.tokens.pop(0)[1] if self.tokens[0][0] == "op" and self.tokens[0][1] in ops else None

    def either(self):
        left = self.both()
        while self.take("or"):
            left = fold(("or", left, self.both()))
        return left

    def both(self):
        left = self.inverse()
        while self.take("and"):
            left = fold(("and", left, self.inverse()))
        return left

    def inverse(self):
        return fold(("not", self.inverse())) if self.take("not") else self.compared()

    def compared(self):
        left = self.summed()
        while op := self.take("==", "!=", "in"):
            left = fold((op, left, self.summed()))
        return left

    def summed(self):
        left = self.filtered()
        while op := self.take("+", "~"):
            left = fold((op, left, self.filtered()))
        return left

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = fold(("filter", name, tree))
        return tree

    def atom(self):
        kind, value = self.tokens.pop(0)
        if kind == "const":
            return ("const", value)
        if kind == "op" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "op" and value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        tree = ("name", value)
        while self.take("."):
            kind, field = self.tokens.pop(0)
            if kind != "name" or field.startswith("_"):
                raise TemplateError("a field is a plain name")
            tree = ("field", tree, field)
        return tree


_BINARY = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(tree):
    """A node of constants becomes its value; a constant side decides and/or."""
    op = tree[0]
    if op in _BINARY and tree[1][0] == tree[2][0] == "const":
        try:
            return ("const", _BINARY[op](tree[1][1], tree[2][1]))
        except TypeError as e:
            raise TemplateError(str(e)) from e
    if op in ("and", "or") and tree[1][0] == "const":
        return tree[2] if bool(tree[1][1]) == (op == "and") else tree[1]
    if op == "not" and tree[1][0] == "const":
        return ("const", not tree[1][1])
    if op == "filter" and tree[2][0] == "const" and isinstance(tree[2][1], str):
        return ("const", FILTERS[tree[1]](tree[2][1]))
    return tree


def parse(source: str):
    """The template's syntax tree, constants folded and neighbouring texts joined."""
    parts, at = [], 0
    for m in _TAGS.finditer(source):
        parts.append(("text", source[at : m.start()]))
        parts.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))

    def block(stop: tuple[str, ...]):
        nodes = []
        while parts:
            kind, value = parts.pop(0)
            if kind == "text":
                nodes.append(("text", value))
            elif kind == "print":
                tree = _Expression(value).parse()
                nodes.append(("text", str(tree[1])) if tree[0] == "const" else ("print", tree))
            elif value.split()[:1] and value.split()[0] in stop:
                return _joined(nodes), value
            elif m := re.fullmatch(r"for\s+(\w+)\s+in\s+(\w+)", value):
                body, _ = block(("endfor",))
                nodes.append(("for", m[1], m[2], body))
            elif value.startswith("if "):
                nodes.append(branch(value[3:]))
            elif m := re.fullmatch(r"set\s+(\w+)\s*=(.*)", value, re.S):
                nodes.append(("set", m[1], _Expression(m[2]).parse()))
            elif value == "generation":
                nodes.append(("mask", block(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if stop:
            raise TemplateError(f"missing {stop[-1]}")
        return _joined(nodes), ""

    def branch(condition: str):
        test = _Expression(condition).parse()
        yes, end = block(("elif", "else", "endif"))
        no = []
        if end.startswith("elif"):
            no = [branch(end[5:])]
        elif end == "else":
            no, _ = block(("endif",))
        if test[0] == "const":
            return ("block", yes if test[1] else no)
        return ("if", test, yes, no)

    return block(())[0]


def _joined(nodes: list) -> list:
    flat = []
    for n in nodes:
        for x in n[1] if n[0] == "block" else [n]:
            if x[0] == "text" and flat and flat[-1][0] == "text":
                flat[-1] = ("text", flat[-1][1] + x[1])
            elif x != ("text", ""):
                flat.append(x)
    return flat


def _value(tree) -> Callable[[dict], object]:
    op = tree[0]
    if op == "const":
        return lambda env, v=tree[1]: v
    if op == "name":
        return lambda env, n=tree[1]: env.get(n, "")
    if op == "field":
        inner = _value(tree[1])
        return lambda env, f=tree[2]: x.get(f, "") if isinstance(x := inner(env), dict) else ""
    if op == "filter":
        inner, f = _value(tree[2]), FILTERS[tree[1]]
        return lambda env: f(inner(env))
    if op == "not":
        inner = _value(tree[1])
        return lambda env: not inner(env)
    left, right = _value(tree[1]), _value(tree[2])
    if op == "and":
        return lambda env: left(env) and right(env)
    if op == "or":
        return lambda env: left(env) or right(env)
    f = _BINARY[op]
    return lambda env: f(left(env), right(env))


Pieces = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _emit(nodes: list) -> Pieces:
    steps = [_node(n) for n in nodes]

    def run(env: dict, masked: bool):
        for s in steps:
            yield from s(env, masked)

    return run


def _node(node) -> Pieces:
    kind = node[0]
    if kind == "text":

        def run(env, masked, text=node[1]):
            yield text, masked
    elif kind == "print":
        value = _value(node[1])

        def run(env, masked):
            yield str(value(env)), masked
    elif kind == "set":
        value = _value(node[2])

        def run(env, masked):
            env[node[1]] = value(env)
            return iter(())
    elif kind == "mask":
        body = _emit(node[1])

        def run(env, masked):
            yield from body(env, True)
    elif kind == "if":
        test, yes, no = _value(node[1]), _emit(node[2]), _emit(node[3])

        def run(env, masked):
            yield from (yes if test(env) else no)(env, masked)
    else:
        body = _emit(node[3])

        def run(env, masked):
            rows, inner = iter(env.get(node[2], ())), dict(env)
            this, index = next(rows, None), 0
            while this is not None:
                following = next(rows, None)
                inner[node[1]], inner["loop"] = this, {"index": index + 1, "index0": index, "first": index == 0, "last": following is None}
                yield from body(inner, masked)
                this, index = following, index + 1

    return run


def compile_template(source: str) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of messages (any iterable of dicts) that yields pieces of text and whether they are under the loss mask."""
    run = _emit(parse(source))
    return lambda messages, **names: run({**names, "messages": messages}, False)


class Reader:
    """Turns and masked texts read back from formatted parts in order."""

    def __init__(self):
        self.rest, self.base = "", 0

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        at = 0
        while m := re.compile(re.escape(OPEN) + r"((?:[^\\>]|\\.)*)>\n", re.S).match(self.rest, at):
            end = self.rest.find("\n" + CLOSE + "\n", m.end() - 1)
            if end < 0:
                break
            yield unescape(m[1]), unescape(self.rest[m.end() : end]) if end >= m.end() else ""
            at = end + len(CLOSE) + 2
        self.rest = self.rest[at:]


FORMATTED = "conv_id bigint, part bigint, start bigint, text string, loss_starts array<bigint>, loss_ends array<bigint>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _parts(pieces: Iterable[tuple[str, bool]], size: int) -> Iterator[tuple[int, str, list[int], list[int]]]:
    held, n, start, at, starts, ends, under = [], 0, 0, 0, [], [], False
    for text, masked in pieces:
        if n >= size and not masked:
            yield start, "".join(held), starts, ends
            held, n, start, starts, ends = [], 0, at, [], []
            under = False
        if masked and text:
            if under:
                ends[-1] = at + len(text)
            else:
                starts.append(at)
                ends.append(at + len(text))
        under = masked if text else under
        held.append(text)
        n += len(text)
        at += len(text)
    yield start, "".join(held), starts, ends


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, part: int = PART) -> DataFrame:
    """Formatted parts of each conversation in order: conv_id, part, start, text, loss_starts, loss_ends (code points from the conversation's start)."""
    parse(template)

    def run(batches):
        render = compile_template(template)
        out, size = [], 0
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            messages = ({"role": r[2] or "", "text": r[3] or "", "turn": r[1] if r[1] is not None else ""} for r in rows)
            for k, (start, text, starts, ends) in enumerate(_parts(render(messages), part)):
                out.append((conv, k, start, text, starts, ends))
                size += len(text)
                if size >= part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FORMATTED)], schema=_FORMATTED)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FORMATTED)], schema=_FORMATTED)

    rows = conversations.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(role as string) role", "cast(text as string) text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted parts say, one row a conversation; parts stand together and in order, as format_conversations leaves them."""

    def run(batches):
        out, names = [], [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for conv, parts in groupby(_rows(batches), key=lambda r: r[0]):
            reader, turns, loss, n, masked, chars = Reader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, start, text, starts, ends in parts:
                for role, said in reader.feed(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for a, b in zip(starts, ends):
                    said = unescape(text[a - start : b - start])
                    loss.update(said.encode())
                    masked += len(said)
                chars += len(text)
            if reader.rest:
                raise ValueError(f"conversation {conv}: unreadable rest {reader.rest[:80]!r}")
            out.append((conv, n, turns.hexdigest(), masked, loss.hexdigest(), chars))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return formatted.mapInArrow(run, READ)
