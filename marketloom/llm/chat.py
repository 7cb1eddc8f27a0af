"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

A fingerprint is a hash of nested field paths, so that one layout has one fingerprint whatever the order
or types of its fields. Each known layout maps to a Spark expression that gives its turns. A frame of one
layout has its fingerprint; in a frame that holds the fields of several, each row has that of the paths
that it fills.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import map_lists

Turn = tuple[str, str]


def field_paths(kind: DataType, at: str = "") -> set[str]:
    """Paths of the leaves: a.b for a struct's field, a[] for an array's element."""
    if isinstance(kind, StructType):
        return {p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}".lstrip("."))}
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """The field paths of a layout, those that a row need not fill, and an expression over them that gives an array of (role, text)."""

    name: str
    paths: frozenset[str]
    turns: str
    rows_are_turns: bool = False
    optional: frozenset[str] = frozenset()

    def prints(self) -> set[str]:
        """Fingerprints of the layout, with and without each of its optional paths."""
        some = sorted(self.optional)
        return {fingerprint(set(self.paths) - set(left)) for k in range(len(some) + 1) for left in combinations(some, k)}


def turn(role: str, text: str) -> str:
    return f"named_struct('role', coalesce({role}, ''), 'text', coalesce({text}, ''))"


#: The names that other layouts give to the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
ROLE_MAP = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in ROLES.items()) + ")"
OWN = f"coalesce(element_at({ROLE_MAP}, lower(x.`from`)), x.`from`)"
LAYOUTS = (
    Layout("turn rows", frozenset({"turn", "role", "text"}), "", rows_are_turns=True),
    Layout("messages", frozenset({"messages[].role", "messages[].content"}), f"transform(messages, x -> {turn('x.role', 'x.content')})"),
    Layout("shared", frozenset({"conversations[].from", "conversations[].value"}), f"transform(conversations, x -> {turn(OWN, 'x.value')})"),
    Layout("prompt", frozenset({"prompt", "response"}), f"array({turn(repr('user'), 'prompt')}, {turn(repr('assistant'), 'response')})"),
    Layout("completion", frozenset({"prompt", "completion"}), f"array({turn(repr('user'), 'prompt')}, {turn(repr('assistant'), 'completion')})"),
    Layout(
        "instruction",
        frozenset({"instruction", "input", "output"}),
        f"array({turn(repr('user'), 'concat_ws(chr(10), instruction, nullif(input, \"\"))')}, {turn(repr('assistant'), 'output')})",
        optional=frozenset({"input"}),
    ),
    Layout("question", frozenset({"system", "question", "answer"}), f"filter(array({turn(repr('system'), 'system')}, {turn(repr('user'), 'question')}, {turn(repr('assistant'), 'answer')}), (x, i) -> i > 0 OR system IS NOT NULL)", optional=frozenset({"system"})),
)
KNOWN = {p: x for x in LAYOUTS for p in x.prints()}


def layouts_of(df: DataFrame, id_col: str) -> list[Layout]:
    """The one known layout whose fingerprint the frame has without its id, or all whose paths it holds among others.

    Raises ValueError where there is none.
    """
    paths = field_paths(df.schema) - {id_col.lower()}
    if (found := KNOWN.get(fingerprint(paths))) is not None:
        return [found]
    within = [x for x in LAYOUTS if x.paths - x.optional <= paths]
    if not within:
        raise ValueError(f"no known layout in {sorted(paths)}")
    return within


def filled(df: DataFrame, path: str) -> Column:
    """Whether a row has the field that a path begins with."""
    names = {c.lower(): c for c in df.columns}
    return F.col(f"`{names[path.replace('[]', '.').split('.')[0]]}`").isNotNull()


def filled_paths(df: DataFrame, layouts: list[Layout]) -> Column:
    """Those of the layouts' paths that a row fills, in order."""
    return F.array_compact(F.array(*(F.when(filled(df, p), F.lit(p)) for p in sorted({p for x in layouts for p in x.paths}))))


def filled_print(df: DataFrame, layouts: list[Layout]) -> Column:
    """A row's fingerprint: the hash of those of the layouts' paths whose field is not null, in order."""
    return F.substring(F.sha2(F.array_join(filled_paths(df, layouts), "\n"), 256), 1, 16)


def gathered(df: DataFrame, id_col: str) -> DataFrame:
    """(conv_id, turns, layout) of turn rows."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("alone")
    own = df.select(F.col(id_col).alias("conv_id"), alone, row.alias("row"))
    rows = own.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.select("conv_id", F.expr("transform(rows, x -> named_struct('role', x.role, 'text', x.text))").alias("turns"), F.lit("turn rows").alias("layout"))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns array of (role, text), layout) a conversation; layout names what it was read by.

    Turn rows are ordered by turn, ties by role and text; repeated rows stay repeated turns. Null roles
    and texts become empty, a null array of turns an empty one. A turn row without an id is a conversation
    of its own. One conversation's turn rows meet in one task. Where a frame holds the fields of several
    layouts, each row is read by the one whose paths it fills, or else by the first that has all paths it fills, and a row that
    fills none but has a turn, a role or a text is a turn row where the frame has those; a conversation then
    has a row for its turn rows and one for each other row. A row that fills nothing has no turns and no layout;
    one whose fields no single layout has is of layout `unclear`, without turns. Extra columns that belong to no layout are not read.
    """
    layouts = layouts_of(df, id_col)
    for p in sorted({p for x in layouts for p in x.optional} - field_paths(df.schema)):
        df = df.withColumn(p, F.lit(None).cast("string"))
    empty = F.expr("cast(array() AS array<struct<role: string, text: string>>)")
    others = [x for x in layouts if not x.rows_are_turns]
    if not others:
        return gathered(df, id_col)
    if len(layouts) == 1:
        return df.select(F.col(id_col).alias("conv_id"), F.coalesce(F.expr(others[0].turns), empty).alias("turns"), F.lit(others[0].name).alias("layout"))
    either = lambda paths: F.coalesce(F.greatest(*(filled(df, p).cast("int") for p in sorted(paths))) == 1, F.lit(False)) if len(paths) > 1 else filled(df, *paths)
    any_other = either({p for x in others for p in x.paths})
    of_turns = either(LAYOUTS[0].paths) if len(others) < len(layouts) else F.lit(False)
    own, paths, turns, name = filled_print(df, others), filled_paths(df, others), F.lit(None), F.lit("unclear")
    within = [(x, F.size(F.array_except(paths, F.array(*map(F.lit, sorted(x.paths))))) == 0) for x in reversed(others)]
    exact = [(x, own.isin(*sorted(x.prints()))) for x in others]
    for x, fits in [(x, f & any_other & ~of_turns) for x, f in within + exact]:  # the last that fits counts
        turns, name = F.when(fits, F.expr(x.turns)).otherwise(turns), F.when(fits, x.name).otherwise(name)
    rest = df.where(any_other | ~of_turns).select(F.col(id_col).alias("conv_id"), F.coalesce(turns, empty).alias("turns"), F.when(any_other | of_turns, name).alias("layout"))
    return rest if len(others) == len(layouts) else rest.unionByName(gathered(df.where(of_turns & ~any_other), id_col))


#: The template's control strings and what stands for each inside a text or a role.
MARK, SPLIT, END = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\\\", "### ": "\\h", "</turn>": "\\e", ": ": "\\c"}
TO_ESCAPE = re.compile("|".join(re.escape(k) for k in ESCAPES))
BACK = {v[1]: k for k, v in ESCAPES.items()}
TO_RESTORE = re.compile(r"\\([\\hec])")
TRAINED = "assistant"


def escape(text: str) -> str:
    return TO_ESCAPE.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return TO_RESTORE.sub(lambda m: BACK[m[1]], text)


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it that are trained on: the assistant's texts."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{MARK}{escape(role)}{SPLIT}", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def read_back(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation; raises ValueError where a control string is missing."""
    parts = formatted.split(END)
    if parts.pop():
        raise ValueError("text after the last turn")
    out = []
    for part in parts:
        head, found, body = part.partition(SPLIT)
        if not found or not head.startswith(MARK):
            raise ValueError("a turn without its mark")
        out.append((unescape(head[len(MARK) :]), unescape(body)))
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of (conv_id, turns). Spans are in code points of the formatted text."""

    def batch(ids: list, many: list) -> tuple:
        done = [render([(t["role"], t["text"]) for t in turns]) for turns in many]
        return ids, [d[0] for d in done], [[{"start": a, "end": b} for a, b in d[1]] for d in done]

    kind = turns.dtypes[0][1]
    return map_lists(turns.select("conv_id", "turns"), batch, f"conv_id {kind}, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold when they are read back."""

    def batch(ids: list, texts: list, spans: list) -> tuple:
        out: list[list] = [[] for _ in range(6)]
        for i, text, own in zip(ids, texts, spans):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in own)
            every = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            for col, v in zip(out, (i, len(turns), every, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                col.append(v)
        return tuple(out)

    kind = formatted.dtypes[0][1]
    return map_lists(formatted, batch, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
