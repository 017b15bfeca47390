"""Chat formatting by a compiled template.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that
render a conversation piece by piece, marking which pieces are to be learned. The language has text, ``{{ expr }}``, ``{% for x in y %}``,
``{% if %}/{% elif %}/{% else %}``, ``{% generation %}`` and ``{# comments #}``; expressions have names, fields, string and number
constants, ``==``, ``!=``, ``+``, ``and``, ``or``, ``not``, parentheses, and the filters ``trim``, ``upper``, ``lower`` and ``escape``. There
are no calls, no attributes of Python objects and no imports: a field is looked up in mappings only.

Rendering takes the turns as a stream, so a conversation needs only one turn in memory at a time.

Null role or text: empty. Turns are ordered by (turn, role, text), a null turn first; repeated rows are turns of their own.
A null conversation id makes one conversation of its own. Empty table: no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.frames import NO_ID, public_id
from factspark.session import partitions, ship

#: Strings that the default template uses to mark turns; ``escape`` keeps them out of texts.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[TURN:", "[/TURN]")
TEMPLATE = (
    "{# one turn after another #}{% for m in messages %}"
    "{% if m.role == 'user' %}{{ '<s>' + '[INST] ' }}{{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[TURN:{{ m.role | escape }}]{{ m.text | escape }}[/TURN]{% endif %}{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't of the language, or asks for something outside the sandbox."""


# --- escaping -------------------------------------------------------------------------------------------------------

_ESCAPED = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\e"}
_PLAIN = {v: k for k, v in _ESCAPED.items()}
#: A backslash, the first character of a control string, and a closing bracket, which would end the head of a ``[TURN:`` mark.
_RISKY = re.compile(r"\\|\]|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_CODED = re.compile(r"\\[\\lbe]")


def escape(text: str) -> str:
    return _RISKY.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: _PLAIN[m[0]], text)


# --- syntax tree ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class For:
    var: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition or None, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "escape": escape}
OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}
_PIECE = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+.|()]))""")


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filter, atom."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> object:
        tree = self.chain(("or",), lambda: self.chain(("and",), self.negation))
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def chain(self, ops: tuple[str, ...], below: Callable[[], object]) -> object:
        left = below()
        while self.peek(*ops):
            left = Op(self.take()[1], (left, below()))
        return left

    def negation(self) -> object:
        if self.peek("not"):
            self.take()
            return Op("not", (self.negation(),))
        return self.chain(("==", "!="), lambda: self.chain(("+",), self.filtered))

    def filtered(self) -> object:
        tree = self.atom()
        while self.peek("."):
            self.take()
            kind, name = self.take()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"no field {name!r}")
            tree = Field(tree, name)
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = Filter(name, tree)
        return tree

    def atom(self) -> object:
        kind, value = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(value))
        if value == "(":
            tree = self.chain(("or",), lambda: self.chain(("and",), self.negation))
            if self.take()[1] != ")":
                raise TemplateError("a parenthesis isn't closed")
            return tree
        if kind != "name" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(value, Name(value))


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    items: list[tuple[str, str]] = []
    at = 0
    for m in _PIECE.finditer(source):
        items.append(("text", source[at : m.start()]))
        if m["out"] is not None:
            items.append(("out", m["out"]))
        elif m["tag"] is not None:
            items.append(("tag", m["tag"].strip()))
        at = m.end()
    items.append(("text", source[at:]))
    place = 0

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal place
        body = []
        while place < len(items):
            kind, value = items[place]
            place += 1
            word = value.split(None, 1)[0] if kind == "tag" and value else ""
            if kind == "text":
                body += [Text(value)] if value else []
            elif kind == "out":
                body.append(Output(_Expression(value).whole()))
            elif word in ends:
                return tuple(body), value
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", value, re.S)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                inner, _ = block(("endfor",))
                body.append(For(m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                branches, head = [], value
                while True:
                    inner, stop = block(("elif", "else", "endif"))
                    words = head.split(None, 1)
                    branches.append((_Expression(words[1]).whole() if words[0] != "else" else None, inner))
                    if stop == "endif":
                        break
                    head = stop
                body.append(If(tuple(branches)))
            elif word == "generation":
                inner, _ = block(("endgeneration",))
                body.append(Generation(inner))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return tuple(body), ""

    return block(())[0]


def fold(node):
    """The tree with constant expressions computed, branches that can't run left out and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif not (isinstance(y, Text) and not y.value):
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(OPS[node.kind](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.kind, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](str(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Output):
        expr = fold(node.expr)
        return Text(_string(expr.value)) if isinstance(expr, Const) else Output(expr)
    if isinstance(node, For):
        return For(node.var, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        kept = []
        for condition, body in node.branches:
            condition = None if condition is None else fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            always = condition is None or isinstance(condition, Const)
            kept.append((None if always else condition, fold(body)))
            if always:
                break
        return () if not kept else kept[0][1] if kept[0][0] is None else If(tuple(kept))
    return node


def _string(value: object) -> str:
    return "" if value is None else str(value)


# --- closures -------------------------------------------------------------------------------------------------------


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):

        def name(scope, key=node.name):
            if key not in scope:
                raise TemplateError(f"no name {key!r}")
            return scope[key]

        return name
    if isinstance(node, Field):
        of = _value(node.of)

        def field(scope, key=node.name):
            held = of(scope)
            if not isinstance(held, dict):
                raise TemplateError(f"no field {key!r}")
            return held.get(key)

        return field
    if isinstance(node, Filter):
        of, f = _value(node.of), FILTERS[node.name]
        return lambda scope: f(_string(of(scope)))
    args, f = [_value(a) for a in node.args], OPS[node.kind]
    if node.kind in ("and", "or"):
        a, b, need = *args, node.kind == "and"
        return lambda scope: b(scope) if bool(x := a(scope)) == need else x
    return lambda scope: f(*(a(scope) for a in args))


def _body(nodes: tuple, learned: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    parts = [_part(x, learned) for x in nodes]

    def run(scope):
        for part in parts:
            yield from part(scope)

    return run


def _part(node, learned: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    if isinstance(node, Text):
        return lambda scope, piece=(node.value, learned): iter((piece,))
    if isinstance(node, Output):
        f = _value(node.expr)
        return lambda scope: iter(((_string(f(scope)), learned),))
    if isinstance(node, Generation):
        return _body(node.body, True)
    if isinstance(node, For):
        over, body, var = _value(node.over), _body(node.body, learned), node.var

        def loop(scope):
            for x in over(scope) or ():
                yield from body({**scope, var: x})

        return loop
    branches = [(None if c is None else _value(c), _body(b, learned)) for c, b in node.branches]

    def choose(scope):
        for condition, body in branches:
            if condition is None or condition(scope):
                yield from body(scope)
                return

    return choose


class Template:
    """A compiled template; ``render`` yields (piece, learned?) as the messages come."""

    def __init__(self, source: str = TEMPLATE):
        self.source, self.tree = source, fold(parse(source))
        self._run = _body(self.tree, False)

    def render(self, messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        return self._run({"messages": messages})

    def text(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of it that are to be learned, one for each generation that has text."""
        pieces, spans, at = [], [], 0
        for piece, learned in self.render(messages):
            if learned and piece:
                spans.append((at, at + len(piece)))
            pieces.append(piece)
            at += len(piece)
        return "".join(pieces), spans

    def __reduce__(self):
        return Template, (self.source,)


# --- reading back ---------------------------------------------------------------------------------------------------


class Reader:
    """Takes the formatted text in pieces of any length and gives the turns back; holds the turn that isn't complete."""

    _HEAD, _USER = "[TURN:", "<s>[INST] "

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        out = []
        while (turn := self._one()) is not None:
            out.append(turn)
        return out

    def _one(self) -> tuple[str, str] | None:
        s = self.rest
        if s.startswith(self._USER):
            return self._until("user", len(self._USER), " [/INST]")
        if s.startswith(self._HEAD):
            if (stop := s.find("]", len(self._HEAD))) < 0:
                return None
            return self._until(unescape(s[len(self._HEAD) : stop]), stop + 1, "[/TURN]")
        if self._USER.startswith(s[: len(self._USER)]) or self._HEAD.startswith(s[: len(self._HEAD)]):
            return None  # too short to tell
        return self._until("assistant", 0, "</s>")

    def _until(self, role: str, begin: int, mark: str) -> tuple[str, str] | None:
        stop = self.rest.find(mark, begin)
        if stop < 0:
            return None
        text, self.rest = self.rest[begin:stop], self.rest[stop + len(mark) :]
        return role, unescape(text)


def read_back(text: str) -> list[tuple[str, str]]:
    reader = Reader()
    turns = reader.feed(text)
    if reader.rest:
        raise ValueError("the text doesn't end with a whole turn")
    return turns


# --- operators ------------------------------------------------------------------------------------------------------


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Each conversation's turns in order within one partition; sorting spills, and no conversation is gathered in memory."""
    ship(df.sparkSession)
    rows = df.select(
        F.coalesce(df[conv_col].cast("long"), F.lit(NO_ID)).alias("id"),
        df[turn_col].cast("long").alias("turn"),
        F.coalesce(df[role_col].cast("string"), F.lit("")).alias("role"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition(partitions(df.sparkSession), "id").sortWithinPartitions("id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Groups a sorted stream of turns, lazily."""
    import itertools

    def rows():
        for b in batches:
            yield from zip(b["id"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist(), strict=True)

    for key, group in itertools.groupby(rows(), key=lambda r: r[0]):
        yield key, ({"role": r, "text": t} for _, r, t in group)


def format_conversations(df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, spans): the text of each conversation and the code-point spans to be learned."""
    compiled = Template(template)

    def run(batches):
        for key, messages in _conversations(batches):
            text, spans = compiled.text(messages)
            yield pa.RecordBatch.from_pylist([{"id": key, "formatted": text, "spans": [{"begin": x, "end": y} for x, y in spans]}], schema=arrow)

    arrow = pa.schema([("id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])
    out = _turns(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, "id long, formatted string, spans array<struct<begin:long,end:long>>")
    return out.select(public_id().alias(conv_col), "formatted", "spans")


def format_digests(df: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Digests of what is read back from each formatted conversation, turn by turn, in constant memory."""
    compiled = Template(template)
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(key: int, messages: Iterator[dict]) -> list:
        reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
        n = chars = learned_chars = begun = 0
        held, spans = "", []  # the output from place ``begun`` on, and the spans of the mask in it
        for piece, learned in compiled.render(messages):
            if learned:
                spans.append((chars, chars + len(piece)))
            held, chars = held + piece, chars + len(piece)
            for role, text in reader.feed(piece):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            if not learned:  # no span goes on: what the mask covers is read from the output
                for x, y in spans:
                    plain = unescape(held[x - begun : y - begun])
                    learned_chars += len(plain)
                    loss.update(plain.encode())
                held, begun, spans = "", chars, []
        for x, y in spans:
            plain = unescape(held[x - begun : y - begun])
            learned_chars += len(plain)
            loss.update(plain.encode())
        if reader.rest:
            raise ValueError(f"conversation {key} can't be read back")
        return [key, n, turns.hexdigest(), learned_chars, loss.hexdigest(), chars]

    def run(batches):
        rows = []
        for key, messages in _conversations(batches):
            rows.append(digest(key, messages))
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    schema = "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _turns(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema).select(public_id().alias(conv_col), *names[1:])
