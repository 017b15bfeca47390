"""Instruction streams: a binary transaction, its builder, and its translation to and from intents.

Decoding yields an ``Intent``, which ``streaming.epochs`` evaluates with all others: a failed expectation or a reject leaves no trace. Frames
are small and read on the driver; a folder of them is read by ``frames``, in parallel, as bytes.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from factspark.streaming.epochs import Intent, Temp
from factspark.terms import Entity, Literal, Predicate

# Fixed values of the format: little-endian throughout.
MAGIC, VERSION = b"SISA", 1
LITERAL_BASE, WORLD_TOKEN = 1 << 63, (1 << 32) - 1
EXPECT, ALLOCATE, DISCARD, LOAD, STORE, PUSH, DEFINE, FORGET, REJECT = range(9)
_HEAD, _SLOT, _CELL, _TAIL, _STEP = (struct.Struct("<" + f) for f in ("4sIQ", "II", "QI", "II", "BIQ"))
_COUNT = struct.Struct("<I")


class BadFrame(ValueError):
    """The bytes are no frame of this version, or the frame can't be executed."""


@dataclass(frozen=True)
class Frame:
    namespace: int
    slots: dict[int, str]
    predicates: dict[int, str]
    literals: dict[int, str]
    n_locals: int
    steps: list[tuple[int, int, int]]

    def encode(self) -> bytes:
        out = [_HEAD.pack(MAGIC, VERSION, self.namespace)]
        for entries, entry in ((self.slots, _SLOT), (self.predicates, _CELL), (self.literals, _CELL)):
            out.append(_COUNT.pack(len(entries)))
            for key, text in entries.items():
                raw = text.encode()
                out += [entry.pack(key, len(raw)), raw]
        out.append(_TAIL.pack(self.n_locals, len(self.steps)))
        return b"".join(out + [_STEP.pack(*s) for s in self.steps])

    @staticmethod
    def decode(data: bytes) -> Frame:
        """One frame, which ends where the bytes end."""
        frame, end = Frame.decode_at(data, 0)
        if end != len(data):
            raise BadFrame(f"{len(data) - end} bytes after the frame")
        return frame

    @staticmethod
    def decode_at(data: bytes, at: int) -> tuple[Frame, int]:
        """(the frame at a place, the place after it)."""
        try:
            magic, version, namespace = _HEAD.unpack_from(data, at)
            if magic != MAGIC or version != VERSION:
                raise BadFrame(f"{magic!r} version {version}")
            at += _HEAD.size
            tables = []
            for entry in (_SLOT, _CELL, _CELL):
                (n,) = _COUNT.unpack_from(data, at)
                at += _COUNT.size
                table = {}
                for _ in range(n):
                    key, length = entry.unpack_from(data, at)
                    at += entry.size
                    if at + length > len(data):
                        raise BadFrame("a name is cut off")
                    table[key] = data[at : at + length].decode()
                    at += length
                tables.append(table)
            n_locals, n = _TAIL.unpack_from(data, at)
            at += _TAIL.size
            end = at + n * _STEP.size
            if end > len(data):
                raise BadFrame("the instructions are cut off")
            return Frame(namespace, *tables, n_locals, list(_STEP.iter_unpack(data[at:end]))), end
        except (struct.error, UnicodeDecodeError) as e:
            raise BadFrame(str(e)) from e


@dataclass
class Builder:
    """A transaction written step by step. Names get tokens as they come, or, if ``canonical``, in order of their text."""

    namespace: int = 1
    canonical: bool = False
    ops: list[tuple] = field(default_factory=list)
    n_locals: int = 0

    def allocate(self) -> Temp:
        temp = Temp(self.n_locals)
        self.n_locals += 1
        self.ops.append(("allocate", temp))
        return temp

    def expect_world(self, digest: str) -> Builder:
        self.ops.append(("world", digest))
        return self

    def expect_object(self, slot: str, atom) -> Builder:
        if isinstance(atom, Temp):
            raise ValueError("an expected object is a value that is known, not a new entity")
        self.ops.append(("object", slot, atom))
        return self

    def define(self, slot: str, s, p: Predicate, o) -> Builder:
        for term in (s, o):
            if isinstance(term, Temp) and term.index >= self.n_locals:
                raise ValueError(f"{term} isn't allocated")
        self.ops.append(("define", slot, s, p, o))
        return self

    def forget(self, slot: str) -> Builder:
        self.ops.append(("forget", slot))
        return self

    def reject(self) -> Builder:
        self.ops.append(("reject",))
        return self

    def frame(self) -> Frame:
        slots, predicates, literals = {}, {}, {}
        for op in self.ops:
            if op[0] in ("object", "define", "forget"):
                slots.setdefault(op[1])
            if op[0] == "define":
                predicates.setdefault(op[3].name)
            for term in op[2:]:
                if isinstance(term, Literal):
                    literals.setdefault(term.text)
        order = sorted if self.canonical else list
        tokens, cells, texts = ({name: k + base for k, name in enumerate(order(names))} for names, base in ((slots, 0), (predicates, 0), (literals, LITERAL_BASE)))
        steps = []

        def cell(term) -> int:
            return texts[term.text] if isinstance(term, Literal) else term.id

        def push(term) -> None:
            steps.append((LOAD, term.index, 0) if isinstance(term, Temp) else (PUSH, 0, cell(term)))

        for op in self.ops:
            match op:
                case ("allocate", temp):
                    steps += [(ALLOCATE, 0, 0), (STORE, temp.index, 0)]
                case ("world", digest):
                    steps.append((EXPECT, WORLD_TOKEN, world_cell(digest)))
                case ("object", slot, atom):
                    steps.append((EXPECT, tokens[slot], cell(atom)))
                case ("define", slot, s, p, o):
                    push(s)
                    steps.append((PUSH, 0, cells[p.name]))
                    push(o)
                    steps.append((DEFINE, tokens[slot], 0))
                case ("forget", slot):
                    steps.append((FORGET, tokens[slot], 0))
                case _:
                    steps.append((REJECT, 0, 0))
        return Frame(self.namespace, *({v: k for k, v in t.items()} for t in (tokens, cells, texts)), self.n_locals, steps)


def world_cell(digest: str) -> int:
    """The first 64 bits of a world's digest."""
    return int(digest[:16], 16)


def lower(operations: list[tuple], namespace: int = 1) -> Frame:
    """The canonical frame of operations whose new entities have names: ("allocate", name), ("world", digest), ("object", slot, atom),
    ("define", slot, s, p, o), ("forget", slot), ("reject",); a string in place of an atom is such a name."""
    out, named = Builder(namespace, canonical=True), {}

    def atom(term):
        if not isinstance(term, str):
            return term
        if term not in named:
            raise ValueError(f"{term} isn't allocated")
        return named[term]

    for op in operations:
        if op[0] == "allocate":
            if op[1] in named:
                raise ValueError(f"{op[1]} is allocated twice")
            named[op[1]] = out.allocate()
        elif op[0] == "define":
            out.define(op[1], atom(op[2]), op[3], atom(op[4]))
        elif op[0] == "object":
            out.expect_object(op[1], atom(op[2]))
        else:
            {"world": out.expect_world, "forget": out.forget, "reject": out.reject}[op[0]](*op[1:])
    return out.frame()


def to_intent(frame: Frame) -> Intent:
    """The intent that a frame asks for. Expectations stay in place among the operations and see those before them."""
    out, stack, local = Intent(), [], {}

    def known(table: dict, key: int, what: str) -> str:
        if key not in table:
            raise BadFrame(f"no {what} has the number {key}")
        return table[key]

    def atom(x):
        if isinstance(x, Temp):
            return x
        return Literal(known(frame.literals, x, "literal")) if x >= LITERAL_BASE else Entity(x)

    for code, argument, immediate in frame.steps:
        if code == ALLOCATE:
            stack.append(out.entity())
        elif code == DISCARD:
            out.entity()
        elif code == PUSH:
            stack.append(immediate)
        elif code == LOAD:
            if argument not in local:
                raise BadFrame(f"local {argument} is read before it is written")
            stack.append(local[argument])
        elif code == REJECT:
            out.reject()
        elif code == FORGET:
            out.forget(known(frame.slots, argument, "slot"))
        elif code == EXPECT and argument == WORLD_TOKEN:
            out.ops.append(("expect_world_cell", immediate))
        elif code == EXPECT:
            out.ops.append(("expect_object", known(frame.slots, argument, "slot"), atom(immediate)))
        elif code in (STORE, DEFINE):
            if len(stack) < (1 if code == STORE else 3):
                raise BadFrame("the stack is too short")
            if code == STORE:
                local[argument] = stack.pop()
                continue
            o, p, s = stack.pop(), stack.pop(), stack.pop()
            if isinstance(p, Temp):
                raise BadFrame("a predicate is no entity")
            out.define(known(frame.slots, argument, "slot"), atom(s), Predicate(known(frame.predicates, p, "predicate")), atom(o))
        else:
            raise BadFrame(f"no instruction has the number {code}")
    return out


def of_intent(intent: Intent, namespace: int = 1) -> Frame:
    """The frame of an intent. One that expects a whole fact or an empty slot has none: the format compares objects only."""
    out = Builder(namespace)
    for c in intent.preconditions:
        if c[0] not in ("world", "object"):
            raise ValueError(f"a frame can't expect: {c[0]}")
        out.ops.append(c)
    for op in intent.ops:
        if op[0] == "expect_world_cell":
            raise ValueError("a decoded expectation of a world has lost its digest")
        if op[0] == "allocate":
            out.allocate()
        else:
            out.ops.append(("object", *op[1:]) if op[0] == "expect_object" else op)
    return out.frame()


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the stream files of a folder."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")
