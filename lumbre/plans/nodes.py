"""What a script says, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple


@dataclass(frozen=True)
class Return:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    condition: object
    then: tuple
    other: tuple = ()


@dataclass(frozen=True)
class Function:
    name: str
    parameters: tuple[str, ...]
    body: tuple


@dataclass
class Load:
    path: str
    arrow: bool = False
    stream: bool = False
    limits: dict[str, float] = field(default_factory=dict)


@dataclass
class Declare:
    name: str
    kind: str
    role: str = "variable"


@dataclass
class Array:
    name: str
    values: list[float] | None
    shape: list[int]


@dataclass
class Statistic:
    op: str
    array: str
    p: float | None = None
    axis: int | None = None
    keep: bool = False


@dataclass
class Shape:
    """What is asked of an array: forma, dimensiones or tamano."""

    what: str
    array: str


@dataclass
class ArrayOperation:
    left: str
    op: str
    right: object


@dataclass
class Variable:
    name: str
    value: object


@dataclass
class Block:
    """A named block of commands: (command, argument), in order."""

    kind: str
    commands: list[tuple[str, str]]
    limits: list[float] = field(default_factory=list)


@dataclass
class StreamFilter:
    column: str
    op: str
    literal: object


@dataclass
class Project:
    columns: list[str]


@dataclass
class StreamSummary:
    metrics: list[tuple[str, str]]
    keys: list[str] = field(default_factory=list)
    spill: list | None = None


@dataclass
class Command:
    name: str
    argument: str


@dataclass
class Save:
    path: str


@dataclass
class Analysis:
    name: str
    items: list


@dataclass
class SqlTable:
    name: str
    columns: list[tuple[str, str]]


@dataclass
class SqlSelect:
    columns: list[str]
    table: str
    where: tuple[str, str, object] | None


@dataclass
class SqlInsert:
    table: str
    columns: list[str]
    values: list


@dataclass
class SqlUpdate:
    table: str
    changes: list[tuple[str, object]]
    where: tuple[str, str, object]


@dataclass
class SqlRaw:
    text: str
    parameters: list
    is_query: bool


@dataclass
class SqlTransaction:
    action: str


@dataclass
class SqlProgram:
    path: str
    limits: dict[str, int]
    statements: list


@dataclass
class Program:
    analyses: list[Analysis] = field(default_factory=list)
    sql: list[SqlProgram] = field(default_factory=list)
    functions: dict[str, Function] = field(default_factory=dict)
    variables: list[Variable] = field(default_factory=list)
    arrays: list[Array] = field(default_factory=list)
    statistics: list = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)
