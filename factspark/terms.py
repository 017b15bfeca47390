"""Terms of facts and patterns."""

from __future__ import annotations

from dataclasses import dataclass

MAX_ID = 1 << 63


@dataclass(frozen=True, order=True)
class Entity:
    id: int

    def __post_init__(self):
        if not 0 <= self.id < MAX_ID:
            raise ValueError(f"an entity id is from 0 to 2**63 - 1, not {self.id}")

    def __str__(self):
        return f"Entity_{self.id}"


@dataclass(frozen=True, order=True)
class Literal:
    text: str

    def __str__(self):
        return self.text


@dataclass(frozen=True, order=True)
class Predicate:
    name: str

    def __str__(self):
        return self.name


@dataclass(frozen=True, order=True)
class Variable:
    name: str

    def __post_init__(self):
        if not self.name or self.name.startswith("?"):
            raise ValueError("a variable has a name, without a question mark")

    def __str__(self):
        return f"?{self.name}"


@dataclass(frozen=True, order=True)
class Symbol:
    """A human name; it is replaced by an entity when a pattern is compiled."""

    name: str


Atom = Entity | Literal
Term = Entity | Literal | Variable


@dataclass(frozen=True)
class Fact:
    s: Atom
    p: Predicate
    o: Atom


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Predicate | Variable
    o: Term

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t.name for t in (self.s, self.p, self.o) if isinstance(t, Variable)))

    def constants(self) -> int:
        return sum(not isinstance(t, Variable) for t in (self.s, self.p, self.o))

    def key(self) -> str:
        return f"{self.s} {self.p} {self.o}"
